"""Binary-classification metrics per group, exact AUC included, and means over metric tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column
from veritable.operators.filters import finite_only
from veritable.operators.ranges import split_points
from veritable.session import settle
from veritable.sources import files


def score_counts(
    preds: DataFrame, keys: Sequence[str] = (), score: str = "prob_fake", label: str = "label"
) -> DataFrame:
    """(keys, score, `_pos`, `_neg`): rows of each label by score. Counts of parts of a table add up."""
    return preds.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )


def add_counts(counts: DataFrame, keys: Sequence[str] = (), score: str = "prob_fake") -> DataFrame:
    """Counts of several parts as those of the whole."""
    return counts.groupBy(*keys, score).agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))


def append_counts(
    preds: DataFrame, folder: str, keys: Sequence[str] = (), score: str = "prob_fake", label: str = "label"
) -> None:
    """Store the counts of new predictions beside those of earlier ones, which are not read."""
    run = uuid.uuid4().hex
    score_counts(finite_only(preds, score), keys, score, label).write.parquet(f"{folder}/.run-{run}")
    if not files.rename(preds.sparkSession, f"{folder}/.run-{run}", f"{folder}/run={run}"):
        raise OSError(f"could not move {folder}/.run-{run} into place")


def stored_totals(
    spark: SparkSession, folder: str, keys: Sequence[str] = (), score: str = "prob_fake", threshold: float = 0.5
) -> DataFrame:
    """`score_totals` of all predictions whose counts are stored in the folder."""
    counts = add_counts(spark.read.parquet(folder), keys, score)
    return totals_of(settle(counts, "counts"), keys, score, threshold)


def score_totals(
    preds: DataFrame,
    keys: Sequence[str] = (),
    score: str = "prob_fake",
    label: str = "label",
    threshold: float = 0.5,
) -> DataFrame:
    """Per key: `n`, `pos`, `neg`, `tp`, `fp` and `wins2`, twice the rank-sum statistic.

    Rows are first counted per (key, score), which Spark combines before the shuffle.
    """
    # Written once, so that the input is evaluated once: split points and totals read the counts.
    return totals_of(settle(score_counts(preds, keys, score, label), "counts"), keys, score, threshold)


def totals_of(counts: DataFrame, keys: Sequence[str] = (), score: str = "prob_fake", threshold: float = 0.5) -> DataFrame:
    """`score_totals` from counts, which are read several times.

    For the ordered part scores are cut into ranges: inside a range a running total of negatives meets
    the positives; between ranges one row per (key, range) is enough. So neither a hot key nor a
    table without keys is ever ordered in one task, and ties count one half exactly.
    """
    keys = list(keys)
    ranged = split_points(counts.select(*keys, score), [score], counts.count()).number(counts, "_range")
    before = Window.unboundedPreceding, -1
    inside = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(*before)
    hit = F.col(score) >= threshold
    pos, neg = F.col("_pos").cast("double"), F.col("_neg").cast("double")
    per_range = (
        ranged.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)).cast("double"))
        .groupBy(*keys, "_range")
        .agg(
            F.sum(pos * (F.lit(2.0) * F.col("_below") + neg)).alias("_wins2"),
            F.sum("_pos").alias("_p"),
            F.sum("_neg").alias("_n"),
            F.sum(F.when(hit, F.col("_pos")).otherwise(0)).alias("_tp"),
            F.sum(F.when(hit, F.col("_neg")).otherwise(0)).alias("_fp"),
        )
    )
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(*before)
    carried = F.coalesce(F.sum("_n").over(lower), F.lit(0)).cast("double")
    totals = per_range.withColumn("_carried", carried).groupBy(*keys).agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("pos"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("neg"),
        F.coalesce(F.sum("_tp"), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("_fp"), F.lit(0)).alias("fp"),
        F.sum(F.col("_wins2") + F.lit(2.0) * F.col("_p") * F.col("_carried")).alias("wins2"),
    )
    return totals.withColumn("n", F.col("pos") + F.col("neg"))


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    """a / b as a double; `undefined` (null by default) when b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(undefined).cast("double"))


def _auc() -> Column:
    return ratio(F.col("wins2"), F.lit(2.0) * F.col("pos") * F.col("neg"))


def _tn() -> Column:
    return F.col("neg") - F.col("fp")


def _fn() -> Column:
    return F.col("pos") - F.col("tp")


def _f1() -> Column:
    return ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + _fn(), 0.0)


def binary_metrics(
    preds: DataFrame, score: str = "prob_fake", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """One row: accuracy, precision, recall, F1 and AUC; zero division and no rows give 0."""
    totals = score_totals(finite_only(preds, score), (), score, label, threshold)
    return totals.select(
        "n",
        ratio(F.col("tp") + _tn(), F.col("n"), 0.0).alias("accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), 0.0).alias("precision"),
        ratio(F.col("tp"), F.col("pos"), 0.0).alias("recall"),
        _f1().alias("f1"),
        _auc().alias("roc_auc"),
    )


def metrics_by(
    preds: DataFrame,
    keys: Sequence[str] = ("model",),
    score: str = "prob_fake",
    label: str = "label",
    threshold: float = 0.5,
) -> DataFrame:
    """Per key: n, accuracy, TPR, TNR, F1, AUC; undefined rates are null, undefined F1 is 0."""
    return rates(score_totals(finite_only(preds, score), keys, score, label, threshold), keys)


def rates(totals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The metrics of `metrics_by` from totals, of predictions or of stored counts."""
    return totals.select(
        *keys,
        "n",
        ratio(F.col("tp") + _tn(), F.col("n"), 0.0).alias("accuracy"),
        ratio(F.col("tp"), F.col("pos")).alias("tpr"),
        ratio(_tn(), F.col("neg")).alias("tnr"),
        _f1().alias("f1"),
        _auc().alias("roc_auc"),
    )


def roc_auc(
    preds: DataFrame, keys: Sequence[str] = (), score: str = "prob_fake", label: str = "label"
) -> DataFrame:
    """Exact AUC per key (or of the table), null for a single class."""
    return score_totals(preds, keys, score, label).select(*keys, _auc().alias("roc_auc"))


# ---------------------------------------------------------------- means over metric tables


def weighted_mean(value: Column | str, weight: Column | str, where: Column | None = None) -> Column:
    """Aggregate expression; null values count in neither sum, weight 0 gives null."""
    value, weight = as_column(value), as_column(weight)
    used = value.isNotNull() if where is None else value.isNotNull() & where
    return F.sum(F.when(used, value * weight)) / F.nullif(F.sum(F.when(used, weight)), F.lit(0))


def macro_mean(value: Column | str, where: Column | None = None) -> Column:
    value = as_column(value)
    return F.avg(value if where is None else F.when(where, value))


def is_real(source: Column | str, real_sources: Sequence[str]) -> Column:
    return F.coalesce(as_column(source).isin(*real_sources), F.lit(False))


def source_metric(source: Column | str, real_sources: Sequence[str]) -> Column:
    """TNR of a real source, TPR of a generator."""
    return F.when(is_real(source, real_sources), F.col("tnr")).otherwise(F.col("tpr"))


def source_rate(
    metrics: DataFrame, group: Sequence[str], real_sources: Sequence[str], source: str = "model"
) -> DataFrame:
    """Rate per display group, weighted by n over its sources."""
    return metrics.groupBy(*group).agg(
        weighted_mean(source_metric(source, real_sources), "n").alias("rate")
    )


def balanced_source_accuracy(
    metrics: DataFrame, keys: Sequence[str], real_sources: Sequence[str], source: str = "model"
) -> DataFrame:
    """Half the mean TNR of real sources plus half the mean TPR of generators, and its error.

    With one side only, the mean of that side. The standard error runs over all sources and is
    0 below two.
    """
    real = is_real(source, real_sources)
    value = source_metric(source, real_sources)
    on_real, on_fake = macro_mean(value, real), macro_mean(value, ~real)
    spread = F.stddev_samp(value) / F.sqrt(F.count(value))
    return metrics.groupBy(*keys).agg(
        F.coalesce((on_real + on_fake) / 2, on_real, on_fake).alias("score"),
        F.when(F.count(value) < 2, F.lit(0.0)).otherwise(spread).alias("standard_error"),
    )


def split_report(
    metrics: DataFrame, keys: Sequence[str], real_sources: Sequence[str], source: str = "model"
) -> DataFrame:
    """Average TPR over generators and overall accuracy, both weighted by n."""
    return metrics.groupBy(*keys).agg(
        weighted_mean("tpr", "n", ~is_real(source, real_sources)).alias("average_tpr"),
        weighted_mean("accuracy", "n").alias("overall_accuracy"),
    )


def sweep_summary(
    metrics: DataFrame, real_sources: Sequence[str], source: str = "model", quality: str = "quality"
) -> DataFrame:
    """Per quality level, untouched first and then best to worst (`place`)."""
    real = is_real(source, real_sources)
    level = F.when(F.col(quality) == "none", F.lit(100)).otherwise(F.col(quality).try_cast("int"))
    return (
        metrics.groupBy(quality)
        .agg(
            weighted_mean("accuracy", "n", ~real).alias("fake_acc"),
            weighted_mean("tnr", "n", real).alias("real_tnr"),
            weighted_mean("accuracy", "n").alias("overall_acc"),
            weighted_mean("f1", "n", ~real).alias("fake_f1"),
        )
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc(level))))
    )
