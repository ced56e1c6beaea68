"""Splitting ordered data into key ranges.

An ordered scan over a whole table (running totals, row numbers, runs) must not end up in one
task. The pattern used here: find split points, give each row the number of its range, work
inside ranges in parallel, and combine ranges through a table that has one row per range.
The split points only steer the load; results are exact for any choice of them.

Split points come in levels of at most FANOUT ranges. Those of the first level are one array, which
every row carries for a moment; those of the next are chosen inside a range, from a sample of that range
alone, and reach the rows by a join on its number. So no array, sample or row grows with the table:
three levels do for 10 ** 14 rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.session import settle

SAMPLES_PER_RANGE = 32
ROWS_PER_RANGE = 250_000
FANOUT = 1024


def range_count(rows: int) -> int:
    """A power of two, so that a range holds about ROWS_PER_RANGE rows however many there are."""
    return 1 << max((rows - 1) // ROWS_PER_RANGE, 0).bit_length()


def _fanouts(ranges: int) -> list[int]:
    """Ranges per range of the level above, level by level."""
    fanouts = []
    while ranges > 1:
        fanouts.append(min(ranges, FANOUT))
        ranges = -(-ranges // FANOUT)
    return fanouts


def range_number(value: Column, bounds: Column, ranges: int) -> Column:
    """How many split points are not above `value`, by binary search over the sorted array."""
    steps, step = [], 1
    while step <= 2 * ranges:
        steps.append(step)
        step *= 2
    steps = F.array(*[F.lit(s) for s in reversed(steps)])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.size(bounds)) & (F.get(bounds, at + s - 1) <= value), at + s
        ).otherwise(at),
    )


def _every(sorted_keys: Column, ranges: int) -> Column:
    """Split points of `ranges` ranges out of sorted sampled keys.

    The keys reach the inner lambda as a variable: as an expression they would be sorted again for each of them.
    """

    def chosen(keys: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.size(keys) / F.lit(ranges)).cast("int"))
        return F.filter(keys, lambda _, i: (i % step == 0) & (i > 0))

    return F.get(F.transform(F.array(sorted_keys), chosen), 0)


def narrow_keys(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The order columns alone, written once: counts, samples and offsets are read off this table,
    and the rows themselves are read once more, at the end."""
    return settle(df.select(*order), "keys")


@dataclass
class Splits:
    """Split points of one order. Written once, so branches of a plan agree on them."""

    order: list[str]
    ranges: int
    top: Column | None  # of the first level
    below: list[tuple[DataFrame, int]]  # of the next ones: (_above, _bounds) and the ranges in each

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """Add the number of each row's range: 0 to the number of ranges, ascending with the order."""
        if self.top is None:
            return df.withColumn(name, F.lit(0).cast("long"))
        at = F.struct(*self.order)
        # A subquery may not stand inside a lambda, so the bounds become a column first.
        rows = df.withColumn("_bounds", self.top)
        place = F.coalesce(range_number(at, F.col("_bounds"), min(self.ranges, FANOUT)), F.lit(0))
        rows = rows.withColumn(name, place.cast("long")).drop("_bounds")
        for table, fanout in self.below:
            rows = rows.withColumnRenamed(name, "_above").join(table, "_above", "left")
            place = F.coalesce(range_number(at, F.col("_bounds"), fanout), F.lit(0))
            rows = rows.withColumn(name, F.col("_above") * fanout + place).drop("_above", "_bounds")
        return rows


def split_points(keys: DataFrame, order: Sequence[str], rows: int, ranges: int | None = None) -> Splits:
    """Split points of `keys` (`rows` rows, read several times) by their `order` columns.

    About SAMPLES_PER_RANGE rows a range are drawn, by a hash of all columns of `keys`. The number of
    ranges follows from the rows, if it is not given.
    """
    order, ranges = list(order), ranges or range_count(rows)
    splits = Splits(order, ranges, None, [])
    u = F.xxhash64(*keys.columns) / F.lit(2.0**64) + 0.5
    sampled = 1
    for level, fanout in enumerate(reversed(_fanouts(ranges))):
        sampled *= fanout
        share = min(sampled * SAMPLES_PER_RANGE / max(rows, 1), 1.0)
        drawn = keys.filter(u < F.lit(share)).withColumn("_k", F.struct(*order))
        # A set, so that an order with many equal keys cannot fill the sample.
        chosen = _every(F.array_sort(F.collect_set("_k")), fanout).alias("_bounds")
        if level == 0:
            splits.top = settle(drawn.agg(chosen), "bounds").scalar()
        else:
            splits.below.append((settle(splits.number(drawn, "_at").groupBy(F.col("_at").alias("_above")).agg(chosen), "bounds"), fanout))
    return splits


def with_range(df: DataFrame, order: Sequence[str], name: str = "_range", keys: DataFrame | None = None) -> DataFrame:
    """Add the range number of each row for an ascending order over `order`, by the rows of `keys`
    (`df` itself by default)."""
    keys = df if keys is None else keys
    return split_points(keys, order, keys.count()).number(df, name)
