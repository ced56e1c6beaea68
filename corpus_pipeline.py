"""A training-data pipeline over `documents`: filter, dedup, cut, mix and encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept; all but the
last return the columns of `docs`. `run` writes what a stage returns and reads it again for the next.
A row is a document, equal ids or not; nulls are handled as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.llm import bpe, minhash, mixing, suffix_array, toxicity
from veritable.llm.common import held_out_fold, prepare, settle, text_key

LONGEST_REPEAT = 200  # bytes


def _apart(docs: DataFrame) -> DataFrame:
    """(row, text): all columns but the text in one, so that none can clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~held_out_fold(F.col("doc_id"), 5, 0)))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    scored = toxicity.score(whole, model, id_column="row").filter("score < 0.5")
    return scored.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id (null last); documents
    without words are in no group and stay."""
    grouped = settle(minhash.group(docs), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = (
        grouped.filter("n_shingles > 0")
        .groupBy("group")
        .agg(F.min(order).alias("x"))
        .select(F.col("x.doc_id").alias("id"), F.col("x.text_key").alias("key"))
    )
    plain = grouped.filter("n_shingles = 0").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.lit(True).alias("all"))
    wanted = chosen.withColumn("all", F.lit(False)).union(plain).distinct()
    keyed = docs.select(text_key(F.col("text")).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    place = F.row_number().over(Window.partitionBy("text_key", "row.doc_id").orderBy("text_key"))
    kept = keyed.join(wanted, (F.col("text_key") == F.col("key")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    kept = kept.withColumn("place", place).filter(F.col("all") | (F.col("place") == 1))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the characters in byte strings of LONGEST_REPEAT that start twice."""
    cut = suffix_array.remove_repeats(_apart(docs), LONGEST_REPEAT, id_column="row", whole_characters=True)
    text = F.col("kept").cast("string")
    changed = cut.select("row", text.alias("text"), (F.col("n_removed") > 0).alias("changed"))

    def column(name: str):
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            kind = docs.schema[name].dataType
            return F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return changed.select(*[column(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    mixed = mixing.mix(docs).groupBy("doc_id", "source", "size")
    taken = mixed.agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).toDF("id", "of", "at", "copies", "n")
    sized = docs.withColumns({"_size": mixing.size_of(F.col("text")), "_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])})
    sized = sized.select("_row", "_size")
    same = (
        F.col("_row.doc_id").eqNullSafe(F.col("id"))
        & F.col("_row.source").eqNullSafe(F.col("of"))
        & (F.col("_size") == F.col("at"))
    )
    place = F.row_number().over(Window.partitionBy("_row.doc_id", "_row.source", "_size").orderBy("_row.text"))
    upto = F.floor(F.col("place") * F.col("copies") / F.col("n"))
    own = upto - F.floor((F.col("place") - 1) * F.col("copies") / F.col("n"))
    rows = sized.join(taken, same).withColumn("place", place).withColumn("own", own.cast("int")).filter("own > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and the text that they decode to."""
    import public_tokenizers  # only this stage needs it

    tokens = bpe.tokenize(_apart(docs), public_tokenizers.path("word_bpe_49k.json"), id_column="row")
    others = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("text", "ids", "decoded", "n_tokens")]
    return tokens.select(*others, F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trained scores, components and iterated multipliers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
