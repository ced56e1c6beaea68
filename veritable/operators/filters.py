"""Row filters; each can also report what it leaves out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column
from veritable.functions.models import TERMINAL


def keep_existing(meta: DataFrame, listing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose file is in the listing, rows whose file is not).

    One listing and one semi join instead of a file-system call per row.
    """
    names = listing.select(key)
    return meta.join(names, key, "left_semi"), meta.join(names, key, "left_anti")


def existing_counts(meta: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """The dry run: `total`, `kept`, `missing` in one pass."""
    names = listing.select(key).distinct().withColumn("_there", F.lit(1))
    return meta.select(key).join(names, key, "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count("_there").alias("kept"),
        F.count_if(F.col("_there").isNull()).alias("missing"),
    )


# Fixed value: the reason stored for an adapter whose base model is not named.
NO_BASE = "Missing base model dependency"


def judge_models(
    catalog: DataFrame,
    registry: DataFrame,
    min_downloads: int = 30000,
    blocked_tasks: Sequence[str] = ("audio", "3d"),
    suffix: str = ".safetensors",
) -> DataFrame:
    """The catalogue with `reason` to skip a model, null for eligible ones.

    `catalog` is (`model`, `downloads`, `pipeline_tag`, `files`) and, where `classify_model` has been
    applied, (`type`, `base_id`); `registry` is (`model`, `status`).
    """
    orphan = F.lit(False)
    if {"type", "base_id"} <= set(catalog.columns):
        orphan = (F.col("type") == "LoRA") & (F.coalesce("base_id", F.lit("None")) == "None")
    done = registry.filter(F.col("status").isin(*TERMINAL)).select(
        "model", F.col("status").alias("_done")
    )
    task = F.lower(F.coalesce("pipeline_tag", F.lit("")))
    blocked = F.lit(False)
    for word in blocked_tasks:
        blocked = blocked | task.contains(word)
    has_file = F.exists(
        F.coalesce(F.col("files"), F.array().cast("array<string>")), lambda f: f.endswith(suffix)
    )
    return (
        catalog.join(done, "model", "left")
        .withColumn(
            "reason",
            F.when(F.col("_done").isNotNull(), F.concat(F.lit("already "), "_done"))
            .when(F.coalesce("downloads", F.lit(0)) < min_downloads, "too few downloads")
            .when(~has_file, F.lit(f"No {suffix.lstrip('.')} found"))
            .when(blocked, F.concat(F.lit("Incompatible task: "), "pipeline_tag"))
            .when(orphan, NO_BASE),
        )
        .drop("_done")
    )


def eligible_models(catalog: DataFrame, registry: DataFrame, **options) -> DataFrame:
    return judge_models(catalog, registry, **options).filter("reason is null").drop("reason")


def is_flagged(scores: Column | str, label: str, threshold: float) -> Column:
    """True when any (label, score) element has the label and reaches the threshold."""
    return F.coalesce(
        F.exists(as_column(scores), lambda r: (r["label"] == label) & (r["score"] >= threshold)),
        F.lit(False),
    )


def moderate(
    df: DataFrame, scores: str, label: str = "nsfw", threshold: float = 0.7
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, quarantined rows); nothing is deleted."""
    flag = is_flagged(scores, label, threshold)
    return df.filter(~flag), df.filter(flag)


def min_dimensions(df: DataFrame, width: str, height: str, min_side: int = 64) -> DataFrame:
    return df.filter(F.least(width, height) >= min_side)


def finite_only(df: DataFrame, score: str) -> DataFrame:
    """Rows with a finite score: neither null, NaN nor infinite."""
    return df.filter(is_finite(score))


def is_finite(score: Column | str) -> Column:
    c = as_column(score)
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_counts(df: DataFrame, score: str = "prob_fake") -> DataFrame:
    """One row: `rows`, `kept` and `dropped` of `finite_only`."""
    kept = finite_only(df, score).agg(F.count(F.lit(1)).alias("kept"))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", kept.scalar().alias("kept"), (F.col("rows") - kept.scalar()).alias("dropped")
    )


def drop_blank(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which all the columns are present and not empty."""
    out = df.na.drop(subset=list(columns))
    for c in columns:
        out = out.filter(F.col(c) != "")
    return out


def since_cutoff(
    posts: DataFrame, cutoffs: DataFrame, channel: str, created: str, default: Column
) -> DataFrame:
    """Posts not older than the cutoff of their channel; channels without one use the default.

    `cutoffs` is (`channel` lower-cased, `cutoff`), one line per channel.
    """
    known = cutoffs.select(F.col("channel").alias("_channel"), F.col("cutoff").alias("_cutoff"))
    return (
        posts.join(known, F.lower(channel) == F.col("_channel"), "left")
        .filter(F.col(created) >= F.coalesce("_cutoff", default))
        .drop("_channel", "_cutoff")
    )
