"""The key index of a sink: right answers, and parts read that do not grow with the sink."""

import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from veritable.sources import files
from veritable.streaming import ingest
from veritable.streaming.key_index import FILTER_BITS, KeyIndex, _bits, _is_set


def fill(index, spark, batches, size, start=0):
    """Batches of `size` keys k<i>, one run each."""
    for b in range(start, start + batches):
        keys = spark.range(b * size, (b + 1) * size).select(F.concat(F.lit("k"), "id").alias("k"))
        state = index.state(b)
        index.add(keys, b, state["runs"] if state else [], state)


def test_finds_exactly_what_was_added(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), slot_keys=16, merge_at=3)
    fill(index, spark, 11, 70)
    runs = index.state(11)["runs"]
    assert sum(r["keys"] for r in runs) == 770 and len(runs) <= 7 and max(r["level"] for r in runs) == 2
    asked = [f"k{i}" for i in random.Random(1).sample(range(1600), 300)] + ["x", ""]
    keys = spark.createDataFrame([(k,) for k in asked], "k string")
    known, _ = index.known(keys, runs)
    assert sorted(r.k for r in known.collect()) == sorted(k for k in asked if k[:1] == "k" and int(k[1:]) < 770)
    none, opened = index.known(keys, [])
    assert none.count() == 0 and opened == []


def test_what_a_batch_reads_does_not_grow_with_the_sink(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), slot_keys=64, merge_at=4)
    asked = spark.createDataFrame([(f"k{i}",) for i in range(-4, 4)], "k string")
    read = []
    for batches, size in ((1, 20_000), (1, 160_000)):
        one = KeyIndex(spark, str(tmp_path / f"i{size}"), slot_keys=64)
        fill(one, spark, batches, size)
        runs = one.state(9)["runs"]
        known, opened = one.known(asked, runs)
        assert sorted(r.k for r in known.collect()) == ["k0", "k1", "k2", "k3"]
        read.append((len(opened), sum(files.size(spark, f) for f in opened), sum(files.size(spark, r["path"]) for r in runs)))
    (few, small, whole), (more, large, grown) = read
    assert few <= 8 and more <= 8  # at most one bucket per key
    assert grown > 6 * whole and large < 2 * small
    del index


def test_a_replayed_batch_starts_from_the_state_before_it(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), slot_keys=16, merge_at=2)
    fill(index, spark, 5, 30)
    before = index.state(5)
    for keys in (["a", "b"], ["b", "c"]):  # the second time the batch has other rows
        index.add(spark.createDataFrame([(k,) for k in keys], "k string"), 5, before["runs"], before)
    runs = index.state(6)["runs"]
    asked = spark.createDataFrame([(k,) for k in ("a", "b", "c", "k0", "k149", "k150")], "k string")
    assert sorted(r.k for r in index.known(asked, runs)[0].collect()) == ["b", "c", "k0", "k149"]
    assert len(files.names(spark, str(tmp_path / "i" / "state"))) <= 4


def test_old_runs_are_removed(spark, tmp_path):
    folder = str(tmp_path / "i")
    index = KeyIndex(spark, folder, slot_keys=16, merge_at=2)
    fill(index, spark, 9, 10)
    last = index.state(9)
    held = {r["path"].rsplit("/", 1)[1] for r in last["runs"]} | {p.rsplit("/", 1)[1] for p in last["retired"]}
    assert set(files.names(spark, folder)) == held | {"state"}


def test_runs_of_several_buckets_add_up(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "i"), slot_keys=2, merge_at=2)
    fill(index, spark, 4, 100)
    (run,) = index.state(4)["runs"]
    assert run["slots"] > 32 and run["keys"] == 400 and run["level"] == 2
    asked = [f"k{i}" for i in range(350, 450)]
    known, _ = index.known(spark.createDataFrame([(k,) for k in asked], "k string"), [run])
    assert sorted(r.k for r in known.collect()) == sorted(asked[:50])


@pytest.mark.parametrize("kind", ["string", "long"])
def test_bits_of_the_filter(spark, kind):
    keys = spark.range(300).select(F.col("id").cast(kind).alias("k"))
    marks = keys.select(F.explode(F.array(*_bits(F.col("k")))).alias("bit"))
    filter_ = marks.agg(F.bitmap_construct_agg("bit").alias("f"))
    assert marks.agg(F.min("bit") >= 0, F.max("bit") < FILTER_BITS).first() == (True, True)
    asked = spark.range(6000).select(F.col("id").cast(kind).alias("k"), "id").join(filter_)
    for bit in _bits(F.col("k")):
        asked = asked.filter(_is_set(F.col("f"), bit))
    ids = {r.id for r in asked.select("id").collect()}
    assert set(range(300)) <= ids and len(ids) < 330


def test_ingest_takes_over_a_sink_without_an_index(spark, tmp_path):
    sink, src = str(tmp_path / "sink"), tmp_path / "src"
    schema = "k string, ch string, ts timestamp"
    old = spark.createDataFrame([("a", "x", None)], schema).withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    ingest.write_batch(old, sink, -1)
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("t", "x"), (None, "x")], "k string, ch string")
    rows.withColumn("ts", F.lit("2024-02-02").cast("timestamp")).coalesce(1).write.parquet(str(src))
    cutoffs = spark.createDataFrame([], "channel string, cutoff timestamp")
    stream = spark.readStream.schema(schema).parquet(str(src))
    tracked = spark.createDataFrame([("t",), (None,)], "k string")
    ingest.ingest_posts(
        stream, tracked, cutoffs, sink, str(tmp_path / "c"), "k", "ch", "ts", F.lit("2024-01-01").cast("timestamp")
    ).awaitTermination()
    assert values(spark.read.parquet(sink), "k") == values(spark.createDataFrame([("a",), ("b",), (None,)], "k string"), "k")
    index = KeyIndex(spark, f"{sink}-keys")
    assert sum(r["keys"] for r in index.state(1)["runs"]) == 3
