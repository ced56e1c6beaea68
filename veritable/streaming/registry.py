"""The model registry: which models are done, which are tried again, and with what resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.functions.models import TERMINAL


def registry_update(registry: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Registry after a set of outcomes; both are (`model`, `status`, `reason`, `ts`).

    A terminal status is never replaced by a non-terminal one, however late an old outcome
    arrives; otherwise the newest entry counts. `HALT` outcomes leave no entry. One aggregate
    over the union does it, so a model with very many outcomes is combined before the shuffle.
    """
    entry = F.struct("status", "reason", "ts")
    rank = F.struct(F.col("status").isin(*TERMINAL).alias("terminal"), "ts", "status", "reason")
    columns = ["model", "status", "reason", "ts"]
    return (
        registry.select(*columns)
        .unionByName(outcomes.filter(F.col("status") != "HALT").select(*columns))
        .groupBy("model")
        .agg(F.max_by(entry, rank).alias("e"))
        .select("model", "e.*")
    )


def work_list(registry: DataFrame) -> DataFrame:
    """Models to try again; those that ran out of memory get large resources."""
    return registry.filter(~F.col("status").isin(*TERMINAL)).select(
        "model",
        "reason",
        F.when(F.coalesce(F.col("reason").contains("Memory"), F.lit(False)), "large").otherwise("standard").alias("resources"),
    )


def completed(registry: DataFrame) -> DataFrame:
    return registry.filter(F.col("status") == "COMPLETED").select("model")
