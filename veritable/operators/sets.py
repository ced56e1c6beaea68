"""Set operations on conformed tables and key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_conformed(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name; columns a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_union(dfs: list[DataFrame], key: str) -> DataFrame:
    """Distinct keys over all tables."""
    return reduce(DataFrame.union, [df.select(key) for df in dfs]).distinct()


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of `a` whose key is not in `b`; duplicates of `a` stay."""
    return a.join(b.select(key), key, "left_anti")
