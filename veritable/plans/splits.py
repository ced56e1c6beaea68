"""From pooled metadata to train, in-distribution test and held-out test splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.operators.reports import dropped_report
from veritable.operators.sampling import (
    balance_by_source,
    holdout_per_group,
    max_feasible,
    pool_quota_sample,
    row_count,
    three_way_holdout,
    trim_largest,
)
from veritable.session import settle


@dataclass(frozen=True)
class SplitPlan:
    held: Sequence[str]
    families: Sequence[tuple[str, str]] = ()
    min_pool: int = 2000
    per_group: int = 500
    balance_source: str = "laion"
    seed: int = 42
    key: str = "file_name"
    report_rows: int = 20


def build_splits(
    samples: DataFrame, real_first: DataFrame, real_second: DataFrame, plan: SplitPlan
) -> dict[str, DataFrame]:
    """`train`, `test_indist`, `test_held` and the reports `dropped` and `trimmed`.

    `real_first` and `real_second` are the pools of outside real rows for the held-out test, in
    the columns of `samples`. How many of them there are bounds the held-out fake rows, which
    is worked out before anything is drawn. Metadata rows are narrow, so each input is read once and
    written with its bucket; quotas, cuts and reports read those tables.
    """
    tagged = settle(three_way_holdout(samples, plan.held, plan.families), "tagged")
    real_first, real_second = settle(real_first, "real"), settle(real_second, "real")
    pool = tagged.filter(F.col("bucket") == "pool").drop("match", "bucket")
    dropped = dropped_report(tagged.filter(F.col("bucket") == "dropped"), plan.report_rows)

    split = settle(holdout_per_group(pool, plan.key, plan.min_pool, plan.per_group, plan.seed), "split")
    train = balance_by_source(
        split.filter(F.col("split") == "train").drop("split"), plan.balance_source, plan.key, plan.seed
    )
    test = split.filter(F.col("split") == "test").drop("split")

    held = tagged.filter(F.col("bucket") == "held_test").drop("match", "bucket")
    limit = max_feasible(row_count(real_first), row_count(real_second))
    if limit <= 0:
        raise ValueError("no outside real rows for the held-out test")
    target = min(row_count(held), limit)
    held, trimmed = trim_largest(held, target, "model", plan.key, plan.seed)
    real = pool_quota_sample(real_first, real_second, target, plan.key, plan.seed).drop("pool")
    return {
        "train": train,
        "test_indist": test,
        "test_held": held.unionByName(real),
        "dropped": dropped,
        "trimmed": trimmed,
    }
