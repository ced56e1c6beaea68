"""Queries over statistics tables, names and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.catalog.base import DOCUMENTS, PARTS, query, sample_documents, sample_parts, table
from veritable.functions import naming, text
from veritable.functions.labels import strip
from veritable.functions.feed import normalize_posts, unwrap_page as unwrap_page_of
from veritable.functions.media import sniff_media as sniff_media_of
from veritable.functions.naming import Rule
from veritable.operators import reports

# ------------------------------------------------------------ statistics


@query(f"""
WITH s AS (SELECT coalesce(label, '') AS label, model FROM ({DOCUMENTS}) AS d)
SELECT 'total' AS level, '' AS value, count(*) AS rows FROM s
UNION ALL SELECT 'label', label, count(*) FROM s GROUP BY label
UNION ALL SELECT 'model', model, count(*) FROM s GROUP BY model""")
def split_summary(spark, d):
    return reports.split_summary(sample_documents(spark, d))


@query(f"""
SELECT model, count(*) AS n, count(*) FILTER (label = 'fake') AS fake,
       count(*) - count(*) FILTER (label = 'fake') AS real,
       count(*) FILTER (label = 'fake') * CAST(100 AS DOUBLE) / count(*) AS fake_pct,
       (count(*) - count(*) FILTER (label = 'fake')) * CAST(100 AS DOUBLE) / count(*) AS real_pct
FROM ({PARTS}) AS p GROUP BY model""")
def label_share(spark, d):
    return reports.label_share(sample_parts(spark, d), ["model"])


@query(f"""
WITH s AS (SELECT coalesce(label, '') AS label, model, type FROM ({DOCUMENTS}) AS d)
SELECT 'label' AS what, label AS value, count(*) AS rows FROM s GROUP BY label
UNION ALL SELECT 'type', type, count(*) FROM s GROUP BY type
UNION ALL SELECT 'distinct model', '', count(DISTINCT model) FROM s""")
def package_summary(spark, d):
    return reports.package_summary(sample_documents(spark, d))


SPLIT_ROWS = """
SELECT p_brand AS model, p_partkey,
       CASE WHEN p_retailprice < 1500 THEN 'train' WHEN p_retailprice < 1700 THEN 'test' ELSE 'held' END AS split,
       CASE WHEN p_size < 8 THEN '2024-0' || CAST(p_size + 1 AS VARCHAR) || '-11' ELSE '' END AS release_date,
       CASE WHEN p_size > 30 THEN p_type ELSE '' END AS type,
       CASE WHEN p_brand IN ('Brand#3', 'Brand#13') THEN 'real' ELSE 'fake' END AS label FROM part"""
STATS = f"""
WITH r AS ({SPLIT_ROWS}),
     s AS (SELECT model, split, count(*) AS n, arg_min(release_date, p_partkey) FILTER (release_date <> '') AS release,
                  arg_min(type, p_partkey) FILTER (type <> '') AS type, arg_min(label, p_partkey) AS label,
                  CASE split WHEN 'train' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS nth FROM r GROUP BY model, split),
     st AS (SELECT model, CAST(sum(n) AS BIGINT) AS count, coalesce(min(release), '') AS release,
                   coalesce(arg_min(type, nth) FILTER (type IS NOT NULL), '') AS type, arg_min(label, nth) AS label
            FROM s GROUP BY model)"""


def _stats(spark, d):
    size, brand, price = F.col("p_size"), F.col("p_brand"), F.col("p_retailprice")
    rows = table(spark, d, "part").select(
        brand.alias("model"),
        "p_partkey",
        F.when(price < 1500, "train").when(price < 1700, "test").otherwise("held").alias("split"),
        F.when(size < 8, F.concat(F.lit("2024-0"), (size + 1).cast("string"), F.lit("-11"))).otherwise("").alias("release_date"),
        F.when(size > 30, F.col("p_type")).otherwise("").alias("type"),
        F.when(brand.isin("Brand#3", "Brand#13"), "real").otherwise("fake").alias("label"),
    )
    return reports.source_stats(rows, "p_partkey", "split", ["train", "test", "held"])


@query(f"{STATS} SELECT * FROM st")
def source_stats(spark, d):
    return _stats(spark, d)


FAMILIES = [Rule("ones", starts=("brand#1",)), Rule("twos", contains_all=("brand", "#2"))]


@query(f"""{STATS},
     f AS (SELECT CASE label WHEN 'real' THEN 'real' ELSE 'synthetic' END AS side,
                  CASE WHEN label = 'real' THEN 'real' WHEN model LIKE 'Brand#1%' THEN 'ones'
                       WHEN model LIKE '%#2%' THEN 'twos' ELSE lower(model) END AS family,
                  model, count, nullif(left(release, 7), '') AS month FROM st)
SELECT 'model' AS level, side, family, model, CAST(sum(count) AS BIGINT) AS count, min(month) AS release, count(*) AS members FROM f GROUP BY side, family, model
UNION ALL SELECT 'family', side, family, NULL, CAST(sum(count) AS BIGINT), min(month), count(*) FROM f GROUP BY side, family
UNION ALL SELECT 'total', side, NULL, NULL, CAST(sum(count) AS BIGINT), NULL, count(*) FROM f GROUP BY side""")
def grouped_stats(spark, d):
    return reports.grouped_stats(_stats(spark, d), naming.family_of("model", FAMILIES))


@query("""
SELECT event_type AS source, count(*) FILTER (user_id % 3 = 0) AS saved, count(*) FILTER (user_id % 3 = 1) AS skipped,
       count(*) FILTER (user_id % 3 = 2) AS errors FROM events GROUP BY event_type""")
def ingest_counters(spark, d):
    status = F.element_at(F.array(F.lit("saved"), F.lit("skipped"), F.lit("errors")), (F.col("user_id") % 3 + 1).cast("int"))
    events = table(spark, d, "events").select(F.col("event_type").alias("source"), status.alias("status"))
    return reports.ingest_counters(events, "source", "status")


# ------------------------------------------------------------ names


BRAND_RULES = [
    Rule("single", equals=("brand#1", "brand#2", "brand#3")),
    Rule("teens", starts=("brand#1",)),
    Rule("fives", contains=("5",)),
]


@query("""
SELECT p_partkey,
       CASE WHEN p_brand = 'Brand#13' THEN 'real' WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'single'
            WHEN p_brand LIKE 'Brand#1%' THEN 'teens' WHEN p_brand LIKE '%5%' THEN 'fives' ELSE lower(p_brand) END AS family,
       starts_with(p_name, 'red') OR starts_with(p_name, 'blue') AS video,
       CASE p_type WHEN 'PROMO' THEN 'FT' WHEN 'SMALL' THEN 'LoRA' WHEN 'LARGE' THEN 'video' WHEN 'MEDIUM' THEN 'image' ELSE 'base' END AS variant
FROM part""")
def source_families(spark, d):
    kind = F.element_at(
        F.create_map(*[F.lit(x) for x in ("PROMO", " Fine-Tune", "SMALL", "lora ", "LARGE", "Video", "MEDIUM", "IMAGE", "ECONOMY", "", "STANDARD", "x")]),
        F.col("p_type"),
    )
    return table(spark, d, "part").select(
        "p_partkey",
        naming.family_of("p_brand", BRAND_RULES, real_sources=["Brand#13"]).alias("family"),
        naming.is_video("p_name", ["red", "blue"]).alias("video"),
        naming.variant_tag(kind).alias("variant"),
    )


@query("""
WITH m AS (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size < 25 THEN '_' ELSE '-' END)
                  || CASE WHEN p_size < 10 THEN '-v2-xl' ELSE '' END AS model FROM part),
     n AS (SELECT DISTINCT replace(p_name, ' ', '-') AS name, upper(p_name) AS display FROM part WHERE p_name LIKE 'red %')
SELECT p_partkey, model, coalesce(a.display, b.display,
       array_to_string(list_transform(string_split(replace(model, '_', '-'), '-'), lambda w: CASE
           WHEN w IN ('sd', 'xl') THEN upper(w) WHEN w = 'v2' THEN w ELSE upper(left(w, 1)) || lower(substr(w, 2)) END), ' ')) AS display
FROM m LEFT JOIN n a ON m.model = a.name LEFT JOIN n b ON replace(m.model, '_', '-') = b.name""")
def display_names(spark, d):
    part = table(spark, d, "part")
    joined = F.when(F.col("p_size") < 25, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(
        F.replace("p_name", F.lit(" "), F.lit("-"))
    )
    models = part.select("p_partkey", F.concat(joined, F.when(F.col("p_size") < 10, "-v2-xl").otherwise("")).alias("model"))
    names = part.filter(F.col("p_name").startswith("red ")).select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"), F.upper("p_name").alias("display")
    )
    return naming.display_names(models, "model", names.distinct())


# ------------------------------------------------------------ texts


@query("""
WITH t AS (SELECT doc_id, text, n_chars % 4 AS k, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM documents)
SELECT doc_id,
       CASE k WHEN 0 THEN upper(left(text, 1)) || substr(text, 2) WHEN 1 THEN bare
              WHEN 2 THEN upper(left(bare, 1)) || substr(bare, 2) ELSE text END AS cleaned,
       CASE k WHEN 0 THEN 'both' WHEN 1 THEN 'human' WHEN 2 THEN 'catastrophe' ELSE 'none' END AS category
FROM t""")
def clean_text(spark, d):
    k = F.col("n_chars") % 4
    whole = F.col("text")
    reply = (
        F.when(k == 0, F.concat(F.lit("The image shows "), whole))
        .when(k == 1, F.concat(F.lit("Prompt: "), whole))
        .when(k == 2, F.concat(F.lit("Prompt: The image depicts "), strip(whole), F.lit(" ")))
        .otherwise(whole)
    )
    verdict = (
        F.when(k == 0, "Humans: YES. Catastrophes: yes").when(k == 1, "humans: yes, Catastrophes: no")
        .when(k == 2, "Humans: no / CATASTROPHES: YES").otherwise("I cannot tell.")
    )
    return table(spark, d, "documents").select(
        "doc_id",
        text.clean_prompt(reply).alias("cleaned"),
        text.parse_verdict(verdict)["category"].alias("category"),
    )


@query("""
WITH t AS (SELECT doc_id, n_chars % 3 AS k, regexp_replace(text, '[^a-zA-Z ]', '', 'g') AS body FROM documents)
SELECT doc_id, trim(body, ' ') AS prompt,
       coalesce(nullif(rtrim(left(trim(replace(body, 'e', '_'), ' .'), 80), ' .'), ''), 'untitled') AS filename FROM t""")
def extract_text(spark, d):
    docs = table(spark, d, "documents").withColumn("body", F.regexp_replace("text", "[^a-zA-Z ]", ""))
    body, k = F.col("body"), F.col("n_chars") % 3
    reply = (
        F.when(k == 0, F.concat(F.lit('{"prompt": " '), body, F.lit(' "}')))
        .when(k == 1, F.concat(F.lit('Sure: {"prompt" : "'), body, F.lit('", "n": 1} done')))
        .otherwise(F.concat(F.lit("\n"), body, F.lit("\t")))
    )
    replies = docs.select(
        "doc_id",
        F.when(F.trim(body) == "", body).otherwise(reply).alias("reply"),
        F.translate(body, "e", ":").alias("title"),
    )
    return replies.select(
        "doc_id", text.extract_prompt("reply").alias("prompt"), text.safe_filename("title").alias("filename")
    )


@query("""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' WHEN 3 THEN '.avif' ELSE '.jpg' END AS extension
FROM pages""")
def sniff_media(spark, d):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E470D0A1A0A", "524946460000000057454250", "0000001C66747970", "3C21")])
    payload = F.concat(F.element_at(heads, (F.col("page_id") % 5 + 1).cast("int")), F.encode("html", "UTF-8"))
    return table(spark, d, "pages").select("page_id", sniff_media_of(payload).alias("extension"))


# ------------------------------------------------------------ feeds


FEED = """
SELECT event_id, event_type, user_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       'https://v.test/' || CAST(event_id AS VARCHAR) AS u FROM events"""


def _feed(spark, d):
    """Events as feed posts; each event type carries its media in another way."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    url = F.concat(F.lit("https://v.test/"), F.col("event_id").cast("string"))
    eid = F.col("event_id").cast("string")
    user = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"))
    kind = F.col("event_type")
    md = F.struct(F.concat(url, F.lit("/md")).alias("path"), k.alias("width"), (k * 2).alias("height"), F.lit(1.5).alias("duration_secs"))
    empty = F.struct(F.lit("").alias("path"), F.lit(9).cast("bigint").alias("width"))
    click = F.struct(eid.alias("id"), F.lit("t").alias("title"), user.alias("user"), F.struct(empty.alias("source"), md.alias("md")).alias("encodings"))
    view = F.struct(eid.alias("gen_id"), F.lit("from text").alias("text"), F.concat(url, F.lit(".mp4")).alias("video_url"), k.alias("width"))
    error = F.struct(eid.alias("id"), F.struct(F.lit("a b").alias("100"), F.lit("c").alias("200")).alias("actions"), F.concat(url, F.lit(".gif")).alias("url"))
    listed = F.array(F.struct(F.lit("image").alias("type"), F.lit("x").alias("url")), F.struct(F.lit("video").alias("type"), url.alias("url")))
    signup = F.struct(eid.alias("post_id"), F.lit("p").alias("prompt"), listed.alias("media"))
    inner = F.struct(eid.alias("id"), F.struct(url.alias("url"), k.alias("width"), F.lit(2.5).alias("duration")).alias("media"))
    purchase = F.struct(F.lit("outer").alias("id"), F.array(inner).alias("generations"))
    chain = None
    for name, body in (("click", click), ("view", view), ("error", error), ("signup", signup), ("purchase", purchase)):
        chain = F.when(kind == name, F.to_json(body)) if chain is None else chain.when(kind == name, F.to_json(body))
    return table(spark, d, "events").select("event_id", "event_type", chain.alias("post"))


@query(f"""
WITH f AS ({FEED})
SELECT event_id, CAST(event_id AS VARCHAR) AS id,
       CASE event_type WHEN 'click' THEN 't' WHEN 'view' THEN 'from text' ELSE '' END AS title,
       CASE event_type WHEN 'view' THEN 'from text' WHEN 'signup' THEN 'p' ELSE '' END AS prompt,
       CASE event_type WHEN 'click' THEN 'u' || CAST(user_id AS VARCHAR) ELSE 'unknown' END AS creator,
       CASE event_type WHEN 'click' THEN u || '/md' WHEN 'view' THEN u || '.mp4' ELSE u END AS video_url,
       CASE event_type WHEN 'click' THEN 'md' ELSE 'unknown' END AS quality,
       CASE WHEN event_type = 'signup' THEN 0 ELSE k END AS width,
       CASE WHEN event_type = 'click' THEN k * 2 ELSE 0 END AS height,
       CASE event_type WHEN 'click' THEN CAST(1.5 AS DOUBLE) WHEN 'purchase' THEN CAST(2.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS duration
FROM f WHERE event_type <> 'error'""")
def normalize_post(spark, d):
    return normalize_posts(_feed(spark, d), "post", hosts=()).drop("created_at", "model", "event_type")


@query(f"""
WITH f AS ({FEED})
SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS posts,
       CASE event_type WHEN 'click' THEN 'c' || CAST(k AS VARCHAR) WHEN 'signup' THEN 'n1' END AS cursor FROM f""")
def unwrap_page(spark, d):
    k = F.get_json_object("props", "$.k")
    two = F.lit('[{"id":"a"},{"id":"b"}]')
    kind = F.col("event_type")
    page = (
        F.when(kind == "click", F.concat(F.lit('{"items":'), two, F.lit(',"next_cursor":"c'), k, F.lit('"}')))
        .when(kind == "view", two)
        .when(kind == "signup", F.concat(F.lit('{"data":'), two, F.lit(',"pagination":{"next":"n1"},"has_more":true}')))
        .when(kind == "purchase", F.concat(F.lit('{"posts":'), two, F.lit(',"cursor":"z","has_more":false}')))
        .otherwise(F.lit('{"error":"none"}'))
    )
    unwrapped = table(spark, d, "events").select("event_id", unwrap_page_of(page).alias("p"))
    return unwrapped.select("event_id", F.size("p.posts").alias("posts"), "p.cursor")
