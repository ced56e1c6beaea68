"""Runs of consecutive failures in an ordered record sequence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.operators.ranges import split_points, with_range
from veritable.session import settle


class TooManyFailures(RuntimeError):
    """A run of failures reached the limit."""


def failure_runs(df: DataFrame, failed: Column, order: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Every maximal run of consecutive failures: groups, `first`, `last` (order structs), `length`.

    A run is named by the last success before it. Inside a key range that success is a running
    maximum; across ranges it is carried by a table with one row per range. Runs may therefore
    span ranges and no range is ordered together with another.
    """
    order, groups = list(order), list(groups)
    at = F.struct(*order)
    slim = df.select(*groups, *order, F.coalesce(failed, F.lit(True)).alias("_bad"))
    slim = with_range(settle(slim, "outcomes"), order, "_range").select(*groups, "_range", at.alias("_at"), "_bad")
    success = F.when(~F.col("_bad"), F.col("_at"))
    line = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        slim.groupBy(*groups, "_range")
        .agg(F.max(success).alias("_last"))
        .select(*groups, "_range", F.max("_last").over(line).alias("_carried"))
    )
    inside = (
        Window.partitionBy(*groups, "_range")
        .orderBy("_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        slim.join(carried, [*groups, "_range"])
        .withColumn("_since", F.coalesce(F.max(success).over(inside), "_carried"))
        .filter("_bad")
        .groupBy(*groups, "_since")
        .agg(
            F.min("_at").alias("first"),
            F.max("_at").alias("last"),
            F.count(F.lit(1)).alias("length"),
        )
        .drop("_since")
    )


@dataclass
class RunSummary:
    """What an ordered piece says about runs of failures. Summaries of neighbours add up, in any grouping."""

    length: int = 0
    head: int = 0  # failures before the first success
    tail: int = 0  # failures after the last one
    longest: int = 0

    def __add__(self, after: RunSummary) -> RunSummary:
        return RunSummary(
            self.length + after.length,
            self.length + after.head if self.head == self.length else self.head,
            self.tail + after.length if after.tail == after.length else after.tail,
            max(self.longest, after.longest, self.tail + after.head),
        )


def run_summary(df: DataFrame, failed: Column, order: Sequence[str], least: int = 1) -> RunSummary:
    """The summary of all rows in their order; `longest` may be missed where it is below `least`.

    Rows are dealt into key ranges and counted there, not sorted: the first and the last success of a
    range tell its head and tail, and runs over several ranges are sums over a table with one row per
    range. Only ranges with at least `least` failures between successes are looked at row by row.
    """
    order = list(order)
    slim = settle(df.select(*order, F.coalesce(failed, F.lit(True)).alias("_bad")), "outcomes")
    splits = split_points(slim, order, slim.count())
    slim = splits.number(slim, "_range").select("_range", F.struct(*order).alias("_at"), "_bad")
    good = F.when(~F.col("_bad"), F.col("_at"))
    before = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    since = F.max(good).over(before)
    if splits.ranges == 1:
        runs = slim.withColumn("since", since).groupBy("since")
        runs = runs.agg(F.count_if("_bad").alias("bad"), F.count(F.lit(1)).alias("n"))
        found = runs.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.max(F.when(F.col("since").isNull(), F.col("bad"))), F.lit(0)).alias("head"),
            F.coalesce(F.max_by("bad", "since"), F.max("bad"), F.lit(0)).alias("tail"),
            F.coalesce(F.max("bad"), F.lit(0)).alias("longest"),
        ).first()
        return RunSummary(found["n"], found["head"], found["tail"], found["longest"])
    ranges = settle(
        slim.groupBy("_range").agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("_bad").alias("bad"),
            F.min(good).alias("first"),
            F.max(good).alias("last"),
        ),
        "ranges",
    )
    if not ranges.agg(F.sum("bad")).first()[0]:
        return RunSummary(ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    outer = slim.filter("_bad").join(ranges.select("_range", "first", "last"), "_range").groupBy("_range")
    outer = outer.agg(
        F.count_if(F.col("first").isNull() | (F.col("_at") < F.col("first"))).alias("head"),
        F.count_if(F.col("last").isNull() | (F.col("_at") > F.col("last"))).alias("tail"),
    )
    told = settle(ranges.join(outer, "_range", "left").fillna(0, ["head", "tail"]), "heads")
    # A run over the border of ranges: the tail of one with a success, whole ranges, the head of the next with one.
    mixed = F.col("first").isNotNull()
    line = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    block = told.withColumn("block", F.coalesce(F.count_if(mixed).over(line), F.lit(0)))
    parts = F.when(
        mixed,
        F.array(
            F.struct("block", F.col("head").alias("length")),
            F.struct((F.col("block") + 1).alias("block"), F.col("tail").alias("length")),
        ),
    ).otherwise(F.array(F.struct("block", F.col("n").alias("length"))))
    blocks = block.select(F.inline(parts)).groupBy("block").agg(F.sum("length").alias("length"))
    ends = blocks.agg(
        F.min_by("length", "block").alias("head"), F.max_by("length", "block").alias("tail"), F.max("length").alias("longest")
    ).first()
    total = told.agg(F.sum("n")).first()[0]
    between = told.filter(mixed & (F.col("bad") - F.col("head") - F.col("tail") >= least))
    rows = slim.join(between.select("_range", "first", "last"), "_range")
    rows = rows.filter((F.col("_at") >= F.col("first")) & (F.col("_at") <= F.col("last")))
    runs = rows.withColumn("since", since).filter("_bad").groupBy("_range", "since").count()
    inner = runs.agg(F.max("count")).first()[0] if between.take(1) else 0
    return RunSummary(total, ends["head"], ends["tail"], max(ends["longest"], inner or 0))


def check_failures(
    df: DataFrame, failed: Column, order: Sequence[str], limit: int = 100, carried: int = 0
) -> int:
    """Length of the run that is still open at the end; raises when a run reaches the limit.

    `carried` failures came directly before the first row.
    """
    before = RunSummary(carried, carried, carried, carried)
    both = before + run_summary(df, failed, order, limit)
    if both.longest >= limit:
        raise TooManyFailures(f"{both.longest} consecutive failures, limit {limit}")
    return both.tail
