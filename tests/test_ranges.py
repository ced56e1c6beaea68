"""Split points in several levels: bounded arrays, ascending ranges, exact results."""

import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from veritable.operators import ranges
from veritable.operators.metrics import score_totals
from veritable.operators.ranking import first_seen_order, global_index, head_rows, slice_shards


@pytest.fixture
def narrow(monkeypatch):
    """Tiny ranges and fan-out, so that a few thousand rows need several levels."""
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ranges, "FANOUT", 4)


def rows(spark, n, seed=1):
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)
    data = [(rng.randint(0, n // 3), i, rng.choice([0, 1]), rng.choice("ab")) for i in order]
    return spark.createDataFrame(data, "a int, b int, label int, g string").repartition(7)


def test_levels(narrow):
    assert ranges.range_count(40) == 1 and ranges.range_count(41) == 2 and ranges.range_count(5000) == 128
    assert ranges._fanouts(1) == [] and ranges._fanouts(64) == [4, 4, 4] and ranges._fanouts(128) == [4, 4, 4, 2]


def test_no_array_grows_with_the_rows(spark, narrow):
    sizes = []
    for n in (400, 6000):
        df = rows(spark, n)
        splits = ranges.split_points(df.select("a", "b"), ["a", "b"], n)
        arrays = [spark.range(1).select(F.size(splits.top).alias("s")).first()["s"]]
        arrays += [t.agg(F.max(F.size("_bounds"))).first()[0] for t, _ in splits.below]
        sizes.append(max(arrays))
        numbered = splits.number(df, "r")
        per_range = numbered.groupBy("r").agg(F.count("*").alias("n"), F.min(F.struct("a", "b")).alias("lo"), F.max(F.struct("a", "b")).alias("hi"))
        spans = sorted((r.r, r.lo, r.hi, r.n) for r in per_range.collect())
        assert all(x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False))
        assert sum(s[3] for s in spans) == n and max(s[3] for s in spans) < 400 and len(spans) > n / 200
    assert max(sizes) <= 3


def test_index_heads_and_slices(spark, narrow):
    df = rows(spark, 3000)
    want = {b: i for i, (_, b) in enumerate(sorted((r.a, r.b) for r in df.collect()))}
    assert {r.b: r["index"] for r in global_index(df, ["a", "b"]).collect()} == want
    assert {r.b for r in head_rows(df, 1234, ["a", "b"]).collect()} == {b for b, i in want.items() if i < 1234}
    sliced = slice_shards(df, 7, ["a", "b"]).groupBy("shard").count()
    assert values(sliced, "shard", "count") == [(i, 428) for i in range(6)] + [(6, 432)]


def test_order_of_appearance(spark, narrow):
    df = rows(spark, 2000).withColumn("k", F.concat(F.lit("k"), (F.col("a") % 500).cast("string")))
    got = {r.k: r.position for r in first_seen_order(df, "k", "b").collect()}
    first = {}
    for r in df.collect():
        first[r.k] = min(r.b, first.get(r.k, r.b))
    assert got == {k: i for i, k in enumerate(sorted(first, key=lambda k: (first[k], k)))}


def test_same_totals_with_and_without_ranges(spark, monkeypatch):
    df = rows(spark, 4000).withColumn("p", (F.col("a") % 997) / 997.0)
    plain = [sorted(map(tuple, score_totals(df, keys, "p").collect())) for keys in ([], ["g"])]
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ranges, "FANOUT", 4)
    assert [sorted(map(tuple, score_totals(df, keys, "p").collect())) for keys in ([], ["g"])] == plain


def test_equal_null_and_no_keys(spark, narrow):
    same = spark.range(500).select(F.lit(None).cast("int").alias("a"), F.lit("x").alias("b"))
    splits = ranges.split_points(same, ["a", "b"], 500)
    assert splits.number(same, "r").count() == 500
    assert global_index(same.limit(0), ["a"]).count() == 0


def test_split_points_sort_their_sample_once(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"))
    keys = F.array_sort(F.collect_set("k"))
    for count, want in ((1, []), (8, list(range(125, 1000, 125))), (5000, list(range(1, 1000)))):
        chosen = df.agg(ranges._every(keys, count).alias("bounds"))
        plan = chosen._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_set(") == 1  # a second one would stand inside the lambda and be sorted for each key
        found = sorted(r.k for r in df.collect())
        assert chosen.first()["bounds"] == [found[i] for i in want]
    assert df.filter("k < 0").agg(ranges._every(keys, 8).alias("bounds")).first()["bounds"] == []
