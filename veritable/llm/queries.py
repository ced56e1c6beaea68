"""The operators as queries over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm import (
    bpe,
    chat,
    conversation_trie,
    filter_audit,
    fingerprint,
    html_extract,
    langid,
    minhash,
    mixing,
    seed_extend,
    spherical_caps,
    suffix_array,
    toxicity,
)
from veritable.llm.common import held_out_fold, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(prepare(spark), folder)

        QUERIES[f.__name__] = run
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


COMPONENT_SQL = """
reach(id, other) AS (
    SELECT id, id FROM nodes
    UNION
    SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


@query(
    f"""
WITH RECURSIVE nodes AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (
    SELECT x.id AS a, y.id AS b FROM nodes x, nodes y
    WHERE x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9
),
{COMPONENT_SQL},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT l.id AS vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, l.id = component_id AS kept
FROM least l LEFT JOIN counts ON a = l.id"""
)
def op1_spherical_caps(spark: SparkSession, folder: str) -> DataFrame:
    return spherical_caps.link(table(spark, folder, "embeddings"), cosine=0.9)


@query()
def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers  # only this query needs it

    tokens = bpe.tokenize(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join("ids", " ")).alias("ids_sha256"),
        digest(F.col("decoded")).alias("decoded_sha256"),
    )


def _escaped_sql(text: str) -> str:
    for first in sorted({c[0] for c in chat.CONTROL}):
        rests = "|".join(
            "".join(f"\\{x}" if x in "[]/<>" else x for x in c[1:]) for c in chat.CONTROL if c[0] == first
        )
        text = rf"regexp_replace({text}, '(\{first}\\*)({rests})', '\1\\\2', 'g')"
    return text


def _marks_sql() -> str:
    known = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b, _) in chat.TEMPLATE.items())
    return f"CASE role {known} ELSE {len(''.join(chat.OTHER))} + length({_escaped_sql('role')}) END"


@query(
    f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped_sql("text")}) + {_marks_sql()}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
)
def op3_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.conversations(chat.format_turns(turns)).withColumn("turns", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(whole).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        digest(lost).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.filter(~held_out_fold(F.col("doc_id"), 5, 0)))
    return toxicity.score(docs, model).select(
        "doc_id",
        held_out_fold(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query(
    rf"""
WITH RECURSIVE listed AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM listed),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM places),
sizes AS (
    SELECT l.doc_id AS id, count(s) AS n FROM listed l LEFT JOIN shingles x ON x.doc_id = l.doc_id GROUP BY l.doc_id
),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
),
links AS (
    SELECT a, b FROM shared JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
    WHERE 100 * common >= 80 * (p.n + q.n - common)
),
nodes AS (SELECT id FROM sizes),
{COMPONENT_SQL}
SELECT sizes.id AS doc_id, n AS n_shingles, component_id, sizes.id = component_id AS kept
FROM sizes JOIN least ON least.id = sizes.id"""
)
def op5_minhash(spark: SparkSession, folder: str) -> DataFrame:
    grouped = minhash.group(table(spark, folder, "documents"), width=4, percent=80)
    return grouped.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs.filter(~held_out_fold(F.col("doc_id"), 4, 2)))
    return langid.predict(docs, model).select(
        "doc_id", held_out_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"
    )


@query(
    r"""
WITH listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
windows AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM listed WHERE len(w) >= 35),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i : i + 34], ' ')) AS n FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM counted WHERE n > 1),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM listed),
left_ AS (
    SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY words.doc_id
)
SELECT listed.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM listed LEFT JOIN left_ ON left_.doc_id = listed.doc_id"""
)
def op7_seed_extend(spark: SparkSession, folder: str) -> DataFrame:
    cut = seed_extend.remove_repeats(table(spark, folder, "documents"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", digest(F.col("kept")).alias("kept_sha256"))


@query()
def op8_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_array.remove_repeats(table(spark, folder, "documents"), window=200)
    runs = F.size("removed").cast("long").alias("n_spans")
    return cut.select("doc_id", "n_bytes", "n_removed", runs, digest(F.col("kept")).alias("kept_sha256"))


@query()
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), weights=(5, 2, 1), share=1.5)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@query()
def op10_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_edits(table(spark, folder, "documents"))


@query(
    r"""
WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
plain AS (
    SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS x FROM articles
),
read AS (
    SELECT page_id, url, regexp_replace(regexp_replace(replace(x, '&nbsp;', ' '), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS x
    FROM plain
),
texts AS (SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM read)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts"""
)
def op11_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.learn(pages))


_BITS = "list_reduce([{x}, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"


@query(
    rf"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL
),
told AS (
    SELECT conv_id AS c, array_agg(length(role) || ':' || role || text ORDER BY n) AS t,
           array_agg(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY n) AS w,
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS letters
    FROM turns GROUP BY conv_id
),
shared AS (
    SELECT c, t, w, CAST(xor(list_reduce(list_prepend(4294967295, letters), lambda s, b: {_BITS.format(x="xor(s, b)")}), 4294967295) % 4 AS BIGINT) AS h
    FROM told
),
built AS (
    SELECT x.c, list_concat(coalesce(y.t[1 : x.h], []), x.t[x.h + 1 :]) AS t,
           list_concat(coalesce(y.w[1 : x.h], []), x.w[x.h + 1 :]) AS w
    FROM shared x LEFT JOIN shared y ON y.c = x.c - x.c % 20
),
places AS (SELECT c, t, w, unnest(range(0, len(t) + 1)) AS d FROM built),
nodes AS (
    SELECT t[1 : d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(coalesce(w[d], 0)) AS last_words,
           coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(t) = d), '') AS ends
    FROM places GROUP BY t[1 : d], d
),
children AS (SELECT p[1 : d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY p[1 : d - 1], d - 1),
full_ AS (
    SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON children.p = nodes.p AND children.d = nodes.d
),
above AS (SELECT p, n_convs, n_children, last_words, unnest(range(0, d + 1)) AS k FROM full_),
sums AS (
    SELECT p[1 : k] AS p, k AS d, sum((n_convs - 1) * last_words) AS saved, count(*) FILTER (n_children = 0) AS leaves
    FROM above GROUP BY p[1 : k], k
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_ f JOIN sums ON sums.p = f.p AND sums.d = f.d LEFT JOIN full_ u ON f.d > 0 AND u.p = f.p[1 : f.d - 1] AND u.d = f.d - 1"""
)
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = conversation_trie.numbered(table(spark, folder, "conversations"))
    return conversation_trie.trie(conversation_trie.rebuilt_paths(turns, family=20, starts=4))


@query(
    r"""
WITH read AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
marks AS (
    SELECT doc_id AS id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
           max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
    FROM labels GROUP BY doc_id
),
flagged AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
           (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END)
           || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
           || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END)
           || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
           || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed
    FROM read LEFT JOIN marks ON id = doc_id
),
counted AS (SELECT part, failed, good, bad, count(*) AS n FROM flagged GROUP BY ALL),
letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, o[s] AS f, o[1 : s - 1] AS before FROM orders, range(1, 6) r(s)),
told AS (
    SELECT part, o, step, n, good, bad, failed, f, contains(failed, f) AS fails,
           translate(failed, before, '') = failed AS here
    FROM counted, steps
),
summed AS (
    SELECT part, o, step, any_value(f) AS f,
           coalesce(sum(n) FILTER (here AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (here AND fails), 0) AS removed,
           coalesce(sum(n) FILTER (fails AND NOT here), 0) AS redundant, coalesce(sum(n) FILTER (failed = f), 0) AS unique_fails,
           coalesce(sum(n) FILTER (here AND fails AND good = 1), 0) AS good_lost,
           coalesce(sum(n) FILTER (here AND fails AND bad = 1), 0) AS toxic_lost
    FROM told GROUP BY part, o, step
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM summed"""
)
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


__all__ = ["QUERIES", "SQL"]
