"""Queries that run batch functions; the scorers are small and exact so SQL can follow them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veritable.catalog.base import metrics_sql, query, table
from veritable.functions.scores import fake_probability
from veritable.operators import scoring
from veritable.plans.prompts import message

# Rounded on both sides: exp() may differ in its last bit between the two engines.
PROB_DIGITS = 9


def _linear():
    """Two logits: the sums of the components at even and at odd places.

    Components are cut to multiples of 2 ** -20, so that sums are exact in any order.
    """

    def call(batch: pd.DataFrame) -> np.ndarray:
        x = np.floor(np.stack(batch["embedding"].to_numpy()).astype("float64") * 2**20) / 2**20
        return np.stack([x[:, 0::2].sum(axis=1), x[:, 1::2].sum(axis=1)], axis=1)

    return call


def _margin_sql(component: str = "x") -> str:
    """Difference of the two logits in SQL, of components changed to `component`."""
    cut = f"floor(CAST({component} AS DOUBLE) * 1048576) / 1048576"
    return f"list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % 2 = 0 THEN {cut} ELSE -({cut}) END))"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(
        F.col("vec_id").cast("string").alias("file_name"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("model"),
        "embedding",
    )


VECTORS = f"""
SELECT CAST(vec_id AS VARCHAR) AS file_name, CAST(label >= 5 AS INTEGER) AS label, 'm' || CAST(label % 3 AS VARCHAR) AS model,
       1 / (1 + exp(-{_margin_sql()})) AS prob
FROM embeddings"""


@query(f"""
SELECT file_name, label, model, round(prob, {PROB_DIGITS}) AS prob_fake, CAST(prob >= 0.5 AS INTEGER) AS pred, NULL AS error
FROM ({VECTORS}) AS v""")
def score_batch(spark, d):
    return scoring.score(_vectors(spark, d), _linear, ["embedding"]).withColumn("prob_fake", F.round("prob_fake", PROB_DIGITS))


@query(metrics_sql(f"SELECT model, label, prob AS prob_fake FROM ({VECTORS}) AS v", "model"))
def evaluate(spark, d):
    return scoring.evaluate(_vectors(spark, d), _linear, ["embedding"])[0]


def _quantise(batch: pd.DataFrame, variant: str) -> pd.DataFrame:
    if variant == "none":
        return batch
    step = float(variant)
    return batch.assign(embedding=[np.floor(np.asarray(e, dtype="float64") * step) / step for e in batch["embedding"]])


SWEPT = " UNION ALL ".join(
    [f"SELECT 'none' AS variant, model, label, prob AS prob_fake FROM ({VECTORS}) AS v"]
    + [
        f"""SELECT '{q}' AS variant, 'm' || CAST(label % 3 AS VARCHAR), CAST(label >= 5 AS INTEGER),
        1 / (1 + exp(-{_margin_sql(f"floor(x * {q}) / {q}")})) FROM embeddings"""
        for q in (64, 16, 4)
    ]
)


@query(metrics_sql(SWEPT, "variant, model"))
def sweep(spark, d):
    return scoring.sweep(_vectors(spark, d), ["none", "64", "16", "4"], _quantise, _linear, ["embedding"])


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
SELECT vec_id, i AS place, round(1 / (1 + exp(-e[i])), 6) AS one,
       round(1 / (1 + exp(-(e[i % len(e) + 1] - e[i]))), 6) AS two FROM v""")
def logit_probabilities(spark, d):
    """Each component as a single logit, and with the component after it as a pair."""
    vector = F.col("embedding").cast("array<double>")
    after = F.concat(F.slice(vector, 2, F.size(vector)), F.slice(vector, 1, 1))
    pairs = F.arrays_zip(vector.alias("a"), after.alias("b"))
    placed = table(spark, d, "embeddings").select("vec_id", F.posexplode(pairs).alias("place", "p"))
    return placed.select(
        "vec_id",
        (F.col("place") + 1).cast("bigint").alias("place"),
        F.round(fake_probability(F.array("p.a")), 6).alias("one"),
        F.round(fake_probability(F.array("p.a", "p.b")), 6).alias("two"),
    )


@query("""
SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN 'A photo of ' || source || ' in ' || lang
                    ELSE 'Sorry: A photo contains a ' || source || '|Describe ' || source END AS generated_prompt
FROM documents""")
def generate_text(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id",
        F.col("source").alias("ClassName"),
        F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("json "), "source", F.lit(" in "), "lang"))
        .otherwise(F.concat(F.lit("A photo contains a "), "source")).alias("lead"),
    )

    def make():
        def call(messages):
            out = []
            for m in messages:
                head, rest = m.split("\n\n", 1)
                if head.startswith("json "):
                    out.append('Here: {"prompt": "A photo of ' + head[5:] + '"}')
                else:
                    out.append(f"  Sorry: {head}|{rest} ")
            return out

        return call

    told = scoring.generate_text(docs, make, message("Describe {target}"))
    return told.select("doc_id", "generated_prompt")


@query("""
WITH t AS (SELECT doc_id, source, contains(lower(text), 'and') AS h, contains(lower(text), 'que') AS c FROM documents)
SELECT doc_id, CASE WHEN h AND c THEN 'both' WHEN h THEN 'human' ELSE 'catastrophe' END AS category,
       upper(left(source, 1)) || substr(source, 2) || ' photograph' AS generated_prompt
FROM t WHERE h OR c""")
def annotate(spark, d):
    def judge():
        def call(batch):
            low = batch["text"].str.lower()
            yes = {True: "yes", False: "no"}
            pairs = zip(low.str.contains("and", regex=False), low.str.contains("que", regex=False), strict=True)
            return [f"Humans: {yes[h]}\nCatastrophes: {yes[c]}" for h, c in pairs]

        return call

    def prompter():
        return lambda batch: [f"Prompt: The image shows {s} photograph" for s in batch["source"]]

    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return scoring.annotate(docs, judge, prompter).select("doc_id", "category", "generated_prompt")
