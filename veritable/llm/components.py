"""Connected components of a link table by alternating stars.

Each round links every node's neighbours to the smallest node around it (large star), then the
smaller neighbours (small star), until nothing changes. A hub with very many links is a minimum per
node, combined before the shuffle, and a join that adaptive execution can split; no component is
ever gathered in one place. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import remove, write


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both), F.col("u") == F.col("w"))
    return joined.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = down.join(_least(down), F.col("u") == F.col("w"))
    own = joined.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that is linked to a smaller one; root is its component's smallest.

    `links`: two columns of longs without nulls; links to itself don't count.
    """
    spark = links.sparkSession
    u, v = links.columns
    plain = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).filter("u <> v")
    edges, path = write(plain.distinct(), "links")
    mark = None
    while True:
        stars, next_path = write(_small_star(_large_star(edges)).filter("u <> v").distinct(), "stars")
        remove(spark, path)
        edges, path = stars, next_path
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), total).first())
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
