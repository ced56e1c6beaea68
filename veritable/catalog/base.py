"""Registration of the checked queries and small helpers they share.

A query is a function of (spark, folder) over the driver's tables; its SQL, when the result can
be said in SQL, gives the same rows and column names on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ------------------------------------------------------------ stand-ins for samples and scores


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as predictions: five sources, both labels, many ties, scores saturated at 1."""
    cents = F.least(F.round(F.col("value") * 100), F.lit(10000))
    return table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("file_name"),
        F.col("event_type").alias("model"),
        (F.col("user_id") % 2).cast("int").alias("label"),
        (cents / F.lit(10000.0)).alias("prob_fake"),
        F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("detector"),
        F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "indist").otherwise("ood").alias("split"),
        F.element_at(
            F.array(*[F.lit(q) for q in ("none", "90", "75", "50", "25")]),
            (F.get_json_object("props", "$.k").cast("int") % 5 + 1),
        ).alias("quality"),
    )


PREDICTIONS = """
SELECT CAST(event_id AS VARCHAR) AS file_name, event_type AS model,
       CAST(user_id % 2 AS INTEGER) AS label,
       least(round(value * 100), 10000) / CAST(10000 AS DOUBLE) AS prob_fake,
       'd' || CAST(user_id % 3 AS VARCHAR) AS detector,
       CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'indist' ELSE 'ood' END AS split,
       CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5
            WHEN 0 THEN 'none' WHEN 1 THEN '90' WHEN 2 THEN '75' WHEN 3 THEN '50' ELSE '25' END AS quality
FROM events"""

REAL_SOURCES = ["view", "click"]
REAL_SQL = "('view', 'click')"


def totals_sql(source: str, keys: str = "") -> str:
    """Counts and the rank-sum per key, by ranking; `keys` is a comma list or empty."""
    by = f"PARTITION BY {keys} " if keys else ""
    tied = f"PARTITION BY {keys}, prob_fake" if keys else "PARTITION BY prob_fake"
    head, group = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
    return f"""
SELECT {head} count(*) AS n,
       count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg,
       count(*) FILTER (label = 1 AND prob_fake >= 0.5) AS tp,
       count(*) FILTER (label = 0 AND prob_fake >= 0.5) AS fp,
       CAST(coalesce(sum(r2) FILTER (label = 1), 0) AS BIGINT)
         - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) AS wins2
FROM (SELECT *, 2 * rank() OVER ({by}ORDER BY prob_fake) + count(*) OVER ({tied}) - 1 AS r2
      FROM ({source}) AS s) AS t {group}"""


AUC_SQL = "CASE WHEN pos > 0 AND neg > 0 THEN CAST(wins2 AS DOUBLE) / (CAST(2 AS DOUBLE) * pos * neg) END"
F1_SQL = """CASE WHEN 2 * tp + fp + pos - tp > 0
     THEN CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + pos - tp AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"""


def metrics_sql(source: str, keys: str) -> str:
    return f"""
SELECT {keys}, n,
       CAST(tp + neg - fp AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
       CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE) END AS tpr,
       CASE WHEN neg > 0 THEN CAST(neg - fp AS DOUBLE) / CAST(neg AS DOUBLE) END AS tnr,
       {F1_SQL} AS f1,
       {AUC_SQL} AS roc_auc
FROM ({totals_sql(source, keys)}) AS m"""


def sample_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as samples of many generators; three of the six types play the fake label."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("file_name"),
        F.when(F.col("p_type").isin("ECONOMY", "PROMO", "MEDIUM"), "fake").otherwise("real").alias("label"),
        F.col("p_brand").alias("model"),
        F.col("p_type").alias("type"),
    )


PARTS = """
SELECT CAST(p_partkey AS VARCHAR) AS file_name,
       CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'MEDIUM') THEN 'fake' ELSE 'real' END AS label,
       p_brand AS model, p_type AS type
FROM part"""


def sample_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the labels that cover some of them."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, folder, "labels"), "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("file_name"),
        F.when(F.col("toxic") == 1, "fake").when(F.col("toxic") == 0, "real").alias("label"),
        F.col("source").alias("model"),
        F.col("lang").alias("type"),
        "n_chars",
    )


DOCUMENTS = """
SELECT CAST(d.doc_id AS VARCHAR) AS file_name,
       CASE toxic WHEN 1 THEN 'fake' WHEN 0 THEN 'real' END AS label,
       source AS model, lang AS type, n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
