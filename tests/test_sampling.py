import hashlib
import itertools

import pytest
from helpers import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veritable.operators import ranking, ranges, sampling


def by_hash(keys, seed):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


@pytest.fixture(scope="module")
def pool(spark):
    """One model holds a third of the rows; labels are mixed case."""
    rows = [(i, "hot" if i % 3 == 0 else f"m{i % 7}", "Fake" if i % 5 else "real") for i in range(900)]
    return spark.createDataFrame(rows, "id bigint, model string, label string")


@pytest.mark.parametrize("n", [0, 1, 7, 899, 900, 5000])
def test_sample_n_is_the_head_of_the_hash_order(spark, pool, n):
    want = by_hash(range(900), 3)[:n]
    for parts in (1, 5):
        got = sampling.sample_n(pool.repartition(parts), n, "id", 3)
        assert values(got, "id") == values(spark.createDataFrame([(i,) for i in want], "id bigint"), "id")


def test_ranks_are_contiguous_and_do_not_depend_on_partitions(pool):
    want = {k: i for i, k in enumerate(by_hash(range(900), "s"))}
    for parts in (1, 6):
        got = {r["id"]: r["rank"] for r in ranking.hash_rank(pool.repartition(parts), "id", "s").collect()}
        assert got == want
    grouped = ranking.hash_rank(pool, "id", "s", ["model"]).groupBy("model").agg(
        F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")
    )
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in grouped.collect())


def test_global_index_and_head_with_ties_and_nulls(spark):
    rows = [(None if i % 4 == 0 else i % 3, f"k{i:03d}") for i in range(500)]
    df = spark.createDataFrame(rows, "a int, k string").repartition(7)
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(ranking.global_index(df, ["a", "k"]).collect(), key=lambda r: r["index"])
    assert [(r["a"], r["k"]) for r in got] == want
    assert [r["index"] for r in got] == list(range(500))
    head = ranking.head_rows(df, 130, ["a", "k"])
    assert values(head, "a", "k") == sorted(want[:130], key=repr)


def test_ranges_split_evenly_and_in_order(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 2500)  # tables below one range are not split
    df = spark.range(20000).withColumn("x", F.col("id") * 3)
    got = ranges.with_range(df, ["x"]).groupBy("_range").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    rows = sorted(got.collect(), key=lambda r: r["_range"])
    assert len(rows) >= 8 and max(r["n"] for r in rows) < 20000 / 3
    assert all(a["hi"] < b["lo"] for a, b in itertools.pairwise(rows))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id bigint, model string, label string")
    assert sampling.sample_n(none, 5, "id", 1).count() == 0
    assert ranking.hash_rank(none, "id", 1).count() == 0
    assert ranking.global_index(none, ["id"]).count() == 0
    assert ranking.head_rows(none, 3, ["id"]).count() == 0
    assert sampling.holdout_per_group(none, "id", 1, 1, 1).count() == 0
    assert sampling.stratified_sample(none, "label", 3, "id", 1).count() == 0
    kept, removed = sampling.trim_largest(none, 3, "model", "id", 1)
    assert kept.count() == removed.count() == 0


def test_holdout_quotas(pool):
    split = sampling.holdout_per_group(pool, "id", 80, 10, 9)
    assert split.count() == 900
    sizes = {r["model"]: r["n"] for r in pool.filter("label = 'Fake'").groupBy("model").agg(F.count("*").alias("n")).collect()}
    want = sum(10 for n in sizes.values() if n >= 80)
    got = {(r["label"], r["split"]): r["n"] for r in split.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    assert got[("Fake", "test")] == got[("real", "test")] == want
    per_model = split.filter("label = 'Fake' and split = 'test'").groupBy("model").count().collect()
    assert {r["count"] for r in per_model} == {10}
    again = sampling.holdout_per_group(pool.repartition(3), "id", 80, 10, 9)
    assert values(again, "id", "split") == values(split, "id", "split")


def test_holdout_takes_all_real_rows_when_short(pool):
    scarce = pool.filter("label = 'Fake' or id < 50")
    split = sampling.holdout_per_group(scarce, "id", 10, 50, 9)
    assert split.filter("label = 'real' and split = 'train'").count() == 0


def test_balance(spark):
    rows = [(i, "laion" if i < 30 else "cam", "real") for i in range(100)] + [(i, "g", "fake") for i in range(100, 190)]
    df = spark.createDataFrame(rows, "id bigint, model string, label string")
    kept = sampling.balance_by_source(df, "laion", "id", 1)
    assert kept.filter("label = 'real'").count() == 90
    assert kept.filter("model = 'cam'").count() == 70
    hard = sampling.balance_by_source(df.filter("label = 'real' or id < 110"), "laion", "id", 1)
    assert hard.filter("model = 'laion'").count() == 0 and hard.filter("model = 'cam'").count() == 70
    assert sampling.balance_by_source(df.filter("label = 'fake'"), "laion", "id", 1).count() == 90


def test_stratified(spark):
    rows = [(i, i % 2 if i < 40 else 2) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, label int")
    got = sampling.stratified_sample(df, "label", 100, "id", 5)
    counts = {r["label"]: r["n"] for r in got.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 20, 1: 20, 2: 60}
    assert sampling.stratified_sample(df, "label", 400, "id", 5).count() == 400
    assert sampling.stratified_sample(df.filter("label = 2"), "label", 17, "id", 5).count() == 17
    three = sampling.stratified_sample(df, "label", 32, "id", 5).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in three} == {0: 11, 1: 11, 2: 10}


def test_train_val(pool):
    split = sampling.train_val_split(pool, 0.05, "id", 1)
    assert split.filter("split = 'val'").count() == 45 and split.count() == 900
    assert sampling.train_val_split(pool.limit(3), 0.05, "id", 1).filter("split = 'val'").count() == 1


def waterfall(counts, target):
    """Row by row: drop from the largest group on."""
    excess, out = sum(counts.values()) - target, {}
    for group, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        drop = min(n, max(0, excess))
        excess -= drop
        out[group] = n - drop
    return out


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(1, 30), min_size=1), st.floats(0, 1.2))
def test_trim(spark, sizes, share):
    rows = [(f"{g}{i}", g) for g, n in sizes.items() for i in range(n)]
    target = int(len(rows) * share)
    kept, removed = sampling.trim_largest(spark.createDataFrame(rows, "id string, model string"), target, "model", "id", 1)
    want = waterfall(sizes, target)
    got = {r["model"]: r["count"] for r in kept.groupBy("model").count().collect()}
    assert got == {g: n for g, n in want.items() if n}
    assert {r["model"]: r["removed"] for r in removed.collect()} == {g: sizes[g] - n for g, n in want.items() if n < sizes[g]}


def test_max_feasible_is_the_largest_that_works():
    def works(n, a, b):
        return n - min(n // 2, a) <= b

    for a, b in itertools.product(range(12), range(12)):
        best = max(n for n in range(a + b + 1) if works(n, a, b))
        assert sampling.max_feasible(a, b) == best


def test_pool_quota(spark):
    a = spark.range(0, 10).withColumnRenamed("id", "k")
    b = spark.range(100, 130).withColumnRenamed("id", "k")
    got = sampling.pool_quota_sample(a, b, 40, "k", 1).groupBy("pool").count().collect()
    assert {r["pool"]: r["count"] for r in got} == {"first": 10, "second": 30}
    with pytest.raises(ValueError, match="first=10 second=30 need=41"):
        sampling.pool_quota_sample(a, b, 41, "k", 1)


def test_three_way(spark):
    rows = [("img-2", "fake"), (" IMG-2 ", "Fake"), ("img-2", "real"), ("img-2-ft", "fake"), ("cam", "real"), (None, "real")]
    df = spark.createDataFrame(rows, "model string, label string")
    got = sampling.three_way_holdout(df, ["img-2"]).select("bucket").collect()
    assert [r[0] for r in got] == ["held_test", "held_test", "held_real", "dropped", "pool", "pool"]


def test_cycle(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id bigint")
    got = sampling.cycle_prompts(df, 25, "id", 4).collect()
    rows = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(25))
    passes = [[r["id"] for r in rows[i : i + 10]] for i in (0, 10, 20)]
    assert sorted(passes[0]) == sorted(passes[1]) == list(range(10)) and passes[0] != passes[1]
    assert len(set(passes[2])) == 5


def test_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("k"))
    plan = sampling.compression_plan(df, "k", 1)
    share = {r["codec"]: r["count"] / 4000 for r in plan.groupBy("codec").count().collect()}
    assert all(abs(share[c] - w) < 0.03 for c, w in sampling.CODEC_WEIGHTS.items())
    assert plan.filter("codec = 'none' and quality is not null").count() == 0
    assert plan.filter("codec = 'jpeg' and quality not between 55 and 95").count() == 0
    assert sampling.compression_plan(df, "k", 1, p=0.0).filter("codec is not null").count() == 0
    with pytest.raises(ValueError, match="sum to 1"):
        sampling.weighted_choice("k", {"a": 0.5}, 1)


def test_orders(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "k bigint")
    sizes = ranking.slice_shards(df, 5, ["k"]).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in sizes} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 7}
    dealt = ranking.round_robin(df, 4, "k").collect()
    assert all(r["worker"] == r["k"] % 4 for r in dealt)
    frames = spark.createDataFrame([(0,), (3,), (15,), (100,)], "total int")
    got = {}
    for r in ranking.even_frames(frames, "total", 15).collect():
        got.setdefault(r["total"], []).append(r["position"])
    assert got == {3: [0, 1] + [2] * 13, 15: list(range(15)), 100: [i * 6 for i in range(15)]}
    assert ranking.even_frames(frames.filter("total = 3"), "total", 15, distinct=True).count() == 3
    floats = ranking.even_frames(frames.filter("total = 15"), "total", 10, float_step=True).collect()
    assert [r["position"] for r in floats] == [0, 1, 3, 4, 6, 7, 9, 10, 12, 13]


def test_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("", 0)], "m string, o int")
    known = spark.createDataFrame([("z",), ("a",), ("c",)], "m string")
    got = ranking.first_seen_order(df, "m", "o", known).collect()
    assert [r["m"] for r in sorted(got, key=lambda r: r["position"])] == ["b", "a", "c", "z"]


def test_group_keys_are_told_apart(spark):
    rows = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("-", "x"), ("", "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(ranking.group_key(["a", "b"])).distinct().count() == len(rows)


def test_held_out_names_ignore_white_space(spark):
    df = spark.createDataFrame([("sora-2\n", "fake"), ("\tsora-2 x", "fake"), ("other", "real")], "model string, label string")
    got = sampling.three_way_holdout(df, ["sora-2"])
    assert values(got, "model", "bucket") == sorted([("sora-2\n", "held_test"), ("\tsora-2 x", "dropped"), ("other", "pool")], key=repr)


def test_rows_without_a_side_are_left_out(spark):
    df = spark.createDataFrame([(1, "m", "fake"), (2, "m", "real"), (3, "m", "maybe"), (4, "m", None)], "id int, model string, label string")
    assert values(sampling.holdout_per_group(df, "id", 5, 1, 1), "id", "split") == [(1, "train"), (2, "train")]


def test_shuffle_gives_every_row_its_place(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    ids = [r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()]
    want = {k: i + 1 for i, k in enumerate(by_hash(ids, 42))}
    got = entry.queries()["shuffle_whole"](spark, folder).collect()
    assert len(got) == len(ids) > 50
    assert {r["doc_id"]: r["place"] for r in got} == want


def test_places_over_several_files(spark, tmp_path):
    df = spark.range(5000).repartition(7).withColumnRenamed("id", "k")
    path = str(tmp_path / "s")
    sampling.shuffle(df, "k", 5).write.option("maxRecordsPerFile", 300).parquet(path)
    got = {r["k"]: r["place"] for r in sampling.file_places(spark, path).collect()}
    assert got == {k: i + 1 for i, k in enumerate(by_hash(range(5000), 5))}
