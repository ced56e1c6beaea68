"""Queries over samplers, splits, ranks and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.catalog.base import DOCUMENTS, PARTS, query, sample_documents, sample_parts, table
from veritable.functions.hashing import uniform
from veritable.functions.naming import held_out_join
from veritable.operators import ranking, sampling
from veritable.operators.reports import dropped_report as dropped_report_of
from veritable.plans.splits import SplitPlan, build_splits

SEED = 42


def order_sql(key: str, seed: str = str(SEED)) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


def uniform_sql(key: str, seed: str) -> str:
    digits = f"substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8)"
    return f"(CAST(('0x' || {digits}) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def between_sql(key: str, seed: str, low: int, high: int) -> str:
    return f"CAST(floor({uniform_sql(key, seed)} * {high - low + 1}) + {low} AS INTEGER)"


# ------------------------------------------------------------ random order and samples


@query(f"""
SELECT doc_id, row_number() OVER (ORDER BY {order_sql("doc_id")}) - 1 AS rank FROM documents""")
def shuffle_rank(spark, d):
    return ranking.hash_rank(table(spark, d, "documents").select("doc_id"), "doc_id", SEED)


@query(f"SELECT doc_id, source, lang FROM documents ORDER BY {order_sql('doc_id')} LIMIT 300")
def sample_n(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return sampling.sample_n(docs, 300, "doc_id", SEED)


@query(f"""
SELECT file_name, model FROM ({DOCUMENTS}) AS s WHERE label = 'real' ORDER BY {order_sql("file_name")} LIMIT 20""")
def filename_sample(spark, d):
    real = F.col("label") == "real"
    picked = sampling.filename_sample(sample_documents(spark, d), real, 20, "file_name", SEED)
    return picked.select("file_name", "model")


HELD = ("Brand#1", "Brand#2", "Brand#25")
HELD_FAMILIES = (("Brand#7", "Brand#2"),)
BUCKETS = f"""
SELECT *, CASE WHEN match IS NULL THEN 'pool' WHEN lower(model) <> match THEN 'dropped'
               WHEN label = 'fake' THEN 'held_test' ELSE 'held_real' END AS bucket
FROM (SELECT *, CASE WHEN contains(lower(model), 'brand#25') THEN 'brand#25'
                     WHEN contains(lower(model), 'brand#1') THEN 'brand#1'
                     WHEN contains(lower(model), 'brand#2') THEN 'brand#2'
                     WHEN contains(lower(model), 'brand#7') THEN 'brand#2' END AS match
      FROM ({PARTS}) AS p) AS q"""


def _held(spark, d):
    return sampling.three_way_holdout(sample_parts(spark, d), HELD, HELD_FAMILIES)


@query(f"SELECT file_name, model, label, match, bucket FROM ({BUCKETS}) AS b")
def held_out_split(spark, d):
    return _held(spark, d).select("file_name", "model", "label", "match", "bucket")


@query("""
WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS n FROM pages WHERE contains(url, '/en/')),
     f(part, r, place) AS (VALUES ('.org', 'org', 1), ('.net', 'net', 2), ('example', 'any', 3)),
     m AS (SELECT DISTINCT url FROM pages),
     x AS (SELECT url, n AS r, 0 AS kind, 0 AS place, -length(n) AS l, n AS part FROM m JOIN h ON contains(lower(url), n) WHERE n <> ''
           UNION ALL SELECT url, r, 1, place, 0, part FROM m JOIN f ON contains(lower(url), part)),
     b AS (SELECT url, r, row_number() OVER (PARTITION BY url ORDER BY kind, place, l, part) AS i FROM x)
SELECT page_id, r AS held_out FROM pages LEFT JOIN b ON b.url = pages.url AND i = 1""")
def held_out_hosts(spark, d):
    """Pages by the longest host of English pages that their address contains, a list that grows with the table."""
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.filter(F.contains("url", F.lit("/en/"))).select(F.regexp_extract("url", "://([^/?#]+)", 1).alias("name"))
    families = spark.createDataFrame([(".org", "org", 1), (".net", "net", 2), ("example", "any", 3)], "part string, result string, place int")
    return held_out_join(pages, hosts, families, "url").select("page_id", "held_out")


@query(f"""
SELECT model, match, count(*) AS rows FROM ({BUCKETS}) AS b WHERE bucket = 'dropped'
GROUP BY model, match ORDER BY rows DESC, model LIMIT 10""")
def dropped_report(spark, d):
    return dropped_report_of(_held(spark, d).filter("bucket = 'dropped'"), 10)


# The thresholds sit inside the group sizes of every scale: some groups qualify, some do not.
MIN_POOL, PER_GROUP = 40, 15
HOLDOUT = f"""
WITH p AS ({PARTS}),
     r AS (SELECT *, count(*) OVER (PARTITION BY label, CASE WHEN label = 'fake' THEN model END) AS size,
                  row_number() OVER (PARTITION BY label, CASE WHEN label = 'fake' THEN model END
                                     ORDER BY {order_sql("file_name")}) AS place FROM p),
     t AS (SELECT *, label = 'fake' AND size >= {MIN_POOL} AND place <= {PER_GROUP} AS fake_test FROM r)
SELECT file_name, label, model,
       CASE WHEN fake_test OR (label = 'real' AND place <= (SELECT count(*) FROM t WHERE fake_test))
            THEN 'test' ELSE 'train' END AS split FROM t"""


@query(HOLDOUT)
def holdout_per_group(spark, d):
    split = sampling.holdout_per_group(sample_parts(spark, d), "file_name", MIN_POOL, PER_GROUP, SEED)
    return split.select("file_name", "label", "model", "split")


@query(f"""
WITH p AS ({PARTS}),
     e AS (SELECT greatest(0, count(*) FILTER (label = 'real') - count(*) FILTER (label = 'fake')) AS n FROM p),
     r AS (SELECT *, row_number() OVER (PARTITION BY label = 'real' AND type = 'SMALL'
                                        ORDER BY {order_sql("file_name")}) AS place FROM p)
SELECT file_name, label, type FROM r
WHERE NOT (label = 'real' AND type = 'SMALL' AND place <= (SELECT n FROM e))""")
def balance_by_source(spark, d):
    kept = sampling.balance_by_source(sample_parts(spark, d), "SMALL", "file_name", SEED, model="type")
    return kept.select("file_name", "label", "type")


TRIM = f"""
WITH p AS ({PARTS}), c AS (SELECT model, count(*) AS n FROM p GROUP BY model),
     x AS (SELECT sum(n) - CAST(floor(sum(n) * 0.7) AS BIGINT) AS excess FROM c),
     b AS (SELECT model, n, coalesce(sum(n) OVER (ORDER BY n DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
     q AS (SELECT model, n, greatest(0, least(n, (SELECT excess FROM x) - before)) AS removed FROM b)"""


def _trimmed(spark, d):
    parts = sample_parts(spark, d)
    return sampling.trim_largest(parts, int(sampling.row_count(parts) * 0.7), "model", "file_name", SEED)


@query(f"""{TRIM},
     r AS (SELECT p.*, row_number() OVER (PARTITION BY model ORDER BY {order_sql("file_name")}) AS place FROM p)
SELECT r.file_name, r.model FROM r JOIN q ON r.model = q.model WHERE place <= n - removed""")
def trim_largest(spark, d):
    return _trimmed(spark, d)[0].select("file_name", "model")


@query(f"{TRIM} SELECT model, CAST(removed AS BIGINT) AS removed FROM q WHERE removed > 0")
def trim_largest_report(spark, d):
    return _trimmed(spark, d)[1]


@query(f"""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql("doc_id")}) AS place FROM documents WHERE lang = 'fr'),
     b AS (SELECT doc_id, row_number() OVER (ORDER BY {order_sql("doc_id")}) AS place FROM documents WHERE lang = 'en'),
     s AS (SELECT least(CAST(floor((SELECT count(*) FROM b) / 2) AS BIGINT) // 2, (SELECT count(*) FROM a)) AS first,
                  CAST(floor((SELECT count(*) FROM b) / 2) AS BIGINT) AS n)
SELECT doc_id, 'first' AS pool FROM a WHERE place <= (SELECT first FROM s)
UNION ALL SELECT doc_id, 'second' FROM b WHERE place <= (SELECT n - first FROM s)""")
def pool_quota_sample(spark, d):
    docs = table(spark, d, "documents")
    first = docs.filter(F.col("lang") == "fr").select("doc_id")
    second = docs.filter(F.col("lang") == "en").select("doc_id")
    n = sampling.row_count(second) // 2
    return sampling.pool_quota_sample(first, second, n, "doc_id", SEED)


@query(f"""
WITH e AS (SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size,
                  row_number() OVER (PARTITION BY label ORDER BY {order_sql("vec_id")}) AS place,
                  dense_rank() OVER (ORDER BY label) AS nth FROM embeddings),
     k AS (SELECT CAST(floor(count(*) * 0.96) AS BIGINT) AS n, max(nth) AS labels FROM e),
     q AS (SELECT e.*, place <= n // labels + CASE WHEN nth <= n % labels THEN 1 ELSE 0 END AS first FROM e, k),
     f AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY {order_sql("vec_id", "42/fill")}) AS place2 FROM q)
SELECT vec_id, label FROM f
WHERE first OR place2 <= (SELECT n FROM k) - (SELECT count(*) FROM q WHERE first)""")
def stratified_sample(spark, d):
    vectors = table(spark, d, "embeddings").select("vec_id", "label")
    n = int(sampling.row_count(vectors) * 0.96)
    return sampling.stratified_sample(vectors, "label", n, "vec_id", SEED)


@query(f"""
SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {order_sql("doc_id")})
    <= (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) FROM documents) THEN 'val' ELSE 'train' END AS split
FROM documents""")
def train_val_split(spark, d):
    return sampling.train_val_split(table(spark, d, "documents").select("doc_id"), 0.05, "doc_id", SEED)


@query(f"""
WITH s AS (SELECT count(*) AS n FROM documents),
     e AS (SELECT doc_id, epoch FROM documents, range(3) AS t(epoch)),
     r AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch
             ORDER BY md5('42/' || CAST(epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS r FROM e)
SELECT doc_id, epoch * (SELECT n FROM s) + r AS position FROM r
WHERE epoch * (SELECT n FROM s) + r < (SELECT n * 5 // 2 FROM s)""")
def cycle_prompts(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return sampling.cycle_prompts(docs, sampling.row_count(docs) * 5 // 2, "doc_id", SEED)


@query(f"""
WITH c AS (SELECT doc_id, CASE WHEN {uniform_sql("doc_id", "42/apply")} <= CAST(0.9 AS DOUBLE) THEN
             CASE WHEN {uniform_sql("doc_id", "42/choice")} < CAST(0.45 AS DOUBLE) THEN 'jpeg'
                  WHEN {uniform_sql("doc_id", "42/choice")} < CAST(0.45 AS DOUBLE) + CAST(0.2 AS DOUBLE) THEN 'webp'
                  WHEN {uniform_sql("doc_id", "42/choice")} < CAST(0.45 AS DOUBLE) + CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) THEN 'avif'
                  WHEN {uniform_sql("doc_id", "42/choice")} < CAST(0.45 AS DOUBLE) + CAST(0.2 AS DOUBLE) + CAST(0.1 AS DOUBLE) + CAST(0.1 AS DOUBLE) THEN 'resize_jpeg'
                  ELSE 'none' END END AS codec FROM documents)
SELECT doc_id, codec,
       CASE codec WHEN 'jpeg' THEN {between_sql("doc_id", "42/jpeg", 55, 95)}
                  WHEN 'webp' THEN CASE WHEN {uniform_sql("doc_id", "42/lossless")} >= CAST(0.05 AS DOUBLE) THEN {between_sql("doc_id", "42/webp", 65, 90)} END
                  WHEN 'avif' THEN {between_sql("doc_id", "42/avif", 40, 80)}
                  WHEN 'resize_jpeg' THEN {between_sql("doc_id", "42/resize_jpeg", 65, 85)} END AS quality,
       CASE WHEN codec = 'jpeg' AND {uniform_sql("doc_id", "42/double")} < CAST(0.3 AS DOUBLE) THEN {between_sql("doc_id", "42/second", 50, 85)} END AS second_quality,
       CASE WHEN codec = 'resize_jpeg' THEN {between_sql("doc_id", "42/edge", 720, 1080)} END AS long_edge
FROM c""")
def weighted_choice(spark, d):
    return sampling.compression_plan(table(spark, d, "documents").select("doc_id"), "doc_id", SEED, 0.9)


@query(f"SELECT event_id, {uniform_sql('event_id', '7')} AS u FROM events")
def uniform_draws(spark, d):
    return table(spark, d, "events").select("event_id", uniform(7, "event_id").alias("u"))


# ------------------------------------------------------------ explicit orders

ORDER = ["o_orderdate", "o_orderkey"]


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS index FROM orders")
def global_index(spark, d):
    orders = table(spark, d, "orders").select(*ORDER)
    return ranking.global_index(orders, ORDER).select("o_orderkey", "index")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def head_rows(spark, d):
    return ranking.head_rows(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), 1000, ORDER)


@query("""
SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)
    // (SELECT count(*) // 7 FROM orders), 6) AS INTEGER) AS shard FROM orders""")
def slice_shards(spark, d):
    return ranking.slice_shards(table(spark, d, "orders").select(*ORDER), 7, ORDER).select("o_orderkey", "shard")


@query("SELECT url, CAST((row_number() OVER (ORDER BY url) - 1) % 4 AS INTEGER) AS worker FROM pages")
def round_robin(spark, d):
    return ranking.round_robin(table(spark, d, "pages").select("url"), 4, "url")


@query("""
WITH s AS (SELECT p_brand AS model, min(p_partkey) AS first_seen FROM part WHERE p_size < 3 GROUP BY p_brand),
     k AS (SELECT DISTINCT p_brand AS model FROM part),
     a AS (SELECT k.model, s.first_seen FROM k LEFT JOIN s ON k.model = s.model)
SELECT model, first_seen, CAST(row_number() OVER (ORDER BY first_seen ASC NULLS LAST, model) - 1 AS INTEGER) AS position FROM a""")
def first_seen_order(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("model"), "p_partkey", "p_size")
    return ranking.first_seen_order(part.filter("p_size < 3"), "model", "p_partkey", part)


BLOCKS = ["ECONOMY", "Video"]


@query("""
WITH s AS (SELECT p_brand AS source, min(p_partkey) AS position FROM part GROUP BY p_brand),
     t AS (SELECT source, position, CASE WHEN source LIKE '%1%' THEN 'ECONOMY' WHEN source LIKE '%2%' THEN 'Video'
                  WHEN source LIKE '%3%' THEN 'Three' ELSE source END AS block,
                  CASE WHEN source LIKE '%5' THEN 'ends in 5' ELSE source END AS label FROM s),
     b AS (SELECT block, min(position) AS seen FROM t GROUP BY block),
     f AS (SELECT block, label, string_agg(source, ',' ORDER BY position, source) AS sources FROM t GROUP BY block, label),
     r AS (SELECT f.*, CASE f.block WHEN 'ECONOMY' THEN 0 WHEN 'Video' THEN 1 ELSE 2 + seen END AS rank,
                  count(*) OVER (PARTITION BY f.block) AS size FROM f JOIN b ON f.block = b.block),
     l AS (SELECT *, lag(block) OVER w AS pb, lag(size) OVER w AS ps, row_number() OVER w - 1 AS line FROM r
           WINDOW w AS (ORDER BY rank, lower(label), label))
SELECT CAST(line AS INTEGER) AS line, block, label, sources,
       coalesce(pb <> block AND pb <> 'Video' AND block <> 'Video' AND (ps > 1 OR size > 1), false) AS separator FROM l""")
def display_order(spark, d):
    source = F.col("p_brand")
    rows = (
        table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("position"))
        .select(
            source.alias("source"),
            "position",
            F.when(source.contains("1"), "ECONOMY").when(source.contains("2"), "Video")
            .when(source.contains("3"), "Three").otherwise(source).alias("block"),
            F.when(source.endswith("5"), "ends in 5").otherwise(source).alias("label"),
        )
    )
    return ranking.display_order(rows, "source", "label", "block", "position", BLOCKS)


@query("""
WITH e AS (SELECT event_id, CAST(floor(value) AS INTEGER) AS total FROM events WHERE floor(value) > 0)
SELECT event_id, total, CAST(i AS INTEGER) AS frame,
       CAST(least(i * greatest(1, total // 15), total - 1) AS INTEGER) AS position
FROM e, range(15) AS t(i)""")
def even_frames(spark, d):
    events = table(spark, d, "events").select("event_id", F.floor("value").cast("int").alias("total"))
    return ranking.even_frames(events, "total", 15)


@query("""
WITH e AS (SELECT event_id, CAST(floor(value) AS INTEGER) AS total FROM events WHERE floor(value) > 0),
     f AS (SELECT event_id, total, i, CAST(floor(i * greatest(CAST(1 AS DOUBLE), total / CAST(10 AS DOUBLE))) AS INTEGER) AS position
           FROM e, range(10) AS t(i))
SELECT event_id, total, CAST(i AS INTEGER) AS frame, position FROM f WHERE position < total""")
def even_frames_float(spark, d):
    events = table(spark, d, "events").select("event_id", F.floor("value").cast("int").alias("total"))
    return ranking.even_frames(events, "total", 10, float_step=True)


# ------------------------------------------------------------ the whole split builder


def _plan(spark, d):
    parts = sample_parts(spark, d).withColumn("model", F.when(F.col("label") == "real", F.col("type")).otherwise(F.col("model")))
    docs = table(spark, d, "documents")

    def pool(lang):
        return docs.filter(F.col("lang") == lang).select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file_name"),
            F.lit("real").alias("label"),
            F.col("source").alias("model"),
            F.lit("real").alias("type"),
        )

    plan = SplitPlan(
        held=HELD, families=HELD_FAMILIES, min_pool=MIN_POOL, per_group=PER_GROUP,
        balance_source="SMALL", seed=SEED,
    )
    return build_splits(parts, pool("fr"), pool("es"), plan)


BUILT = f"""
WITH p0 AS ({PARTS}),
     p1 AS (SELECT file_name, label, CASE WHEN label = 'real' THEN type ELSE model END AS model, type FROM p0),
     p2 AS (SELECT *, CASE WHEN contains(lower(model), 'brand#25') THEN 'brand#25'
                           WHEN contains(lower(model), 'brand#1') THEN 'brand#1'
                           WHEN contains(lower(model), 'brand#2') THEN 'brand#2'
                           WHEN contains(lower(model), 'brand#7') THEN 'brand#2' END AS match FROM p1),
     pool AS (SELECT * FROM p2 WHERE match IS NULL),
     r AS (SELECT *, count(*) OVER (PARTITION BY label, CASE WHEN label = 'fake' THEN model END) AS size,
                  row_number() OVER (PARTITION BY label, CASE WHEN label = 'fake' THEN model END
                                     ORDER BY {order_sql("file_name")}) AS place FROM pool),
     t AS (SELECT *, label = 'fake' AND size >= {MIN_POOL} AND place <= {PER_GROUP} AS fake_test FROM r),
     s AS (SELECT *, fake_test OR (label = 'real' AND place <= (SELECT count(*) FROM t WHERE fake_test)) AS test FROM t),
     tr AS (SELECT file_name, label, model, label = 'real' AND model = 'SMALL' AS src FROM s WHERE NOT test),
     ex AS (SELECT greatest(0, count(*) FILTER (label = 'real') - count(*) FILTER (label = 'fake')) AS n FROM tr),
     tb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY {order_sql("file_name")}) AS place FROM tr),
     h AS (SELECT * FROM p2 WHERE match IS NOT NULL AND lower(model) = match AND label = 'fake'),
     a AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file_name, source AS model FROM documents WHERE lang = 'fr'),
     b AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS file_name, source AS model FROM documents WHERE lang = 'es'),
     z AS (SELECT least((SELECT count(*) FROM h), (SELECT count(*) FROM b) + least((SELECT count(*) FROM a), (SELECT count(*) FROM b))) AS target),
     hc AS (SELECT model, count(*) AS n FROM h GROUP BY model),
     hq AS (SELECT model, n - greatest(0, least(n, (SELECT count(*) FROM h) - (SELECT target FROM z)
              - coalesce(sum(n) OVER (ORDER BY n DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM hc),
     hr AS (SELECT h.*, row_number() OVER (PARTITION BY model ORDER BY {order_sql("file_name")}) AS place FROM h),
     ar AS (SELECT *, row_number() OVER (ORDER BY {order_sql("file_name")}) AS place FROM a),
     br AS (SELECT *, row_number() OVER (ORDER BY {order_sql("file_name")}) AS place FROM b),
     k AS (SELECT target, least(target // 2, (SELECT count(*) FROM a)) AS first FROM z)
SELECT 'train' AS split, file_name, label, model FROM tb WHERE NOT (src AND place <= (SELECT n FROM ex))
UNION ALL SELECT 'test_indist', file_name, label, model FROM s WHERE test
UNION ALL SELECT 'test_held', hr.file_name, 'fake', hr.model FROM hr JOIN hq ON hr.model = hq.model WHERE place <= quota
UNION ALL SELECT 'test_held', file_name, 'real', model FROM ar WHERE place <= (SELECT first FROM k)
UNION ALL SELECT 'test_held', file_name, 'real', model FROM br WHERE place <= (SELECT target - first FROM k)"""


@query(BUILT)
def split_builder(spark, d):
    built = _plan(spark, d)
    out = None
    for name in ("train", "test_indist", "test_held"):
        part = built[name].select(F.lit(name).alias("split"), "file_name", "label", "model")
        out = part if out is None else out.unionByName(part)
    return out
