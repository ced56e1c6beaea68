"""From metric tables of many detectors and test sets to comparison tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veritable.functions.naming import Rule, family_of
from veritable.operators.joins import detector_test_matrix
from veritable.operators.metrics import source_rate, weighted_mean
from veritable.operators.reports import best_per_column


def source_table(
    metrics: DataFrame, rules: Sequence[Rule], real_sources: Sequence[str]
) -> DataFrame:
    """Rate per detector and display row; `metrics` is the metric table with `detector`."""
    named = metrics.withColumn("family", family_of("model", rules, real_sources=real_sources))
    return source_rate(named, ["detector", "family"], real_sources)


def benchmark_table(
    metrics: DataFrame,
    tests: Sequence[str],
    matched: Sequence[tuple[str, str]],
    value: str = "accuracy",
) -> DataFrame:
    """Weighted mean per detector and test set, with matched pairs and best values flagged."""
    means = metrics.groupBy("detector", "test").agg(weighted_mean(value, "n").alias("value"))
    return best_per_column(detector_test_matrix(metrics, tests, means), matched)
