import random

import pytest
from helpers import values
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veritable.operators import ranges
from veritable.streaming import guard, ingest, registry
from veritable.sources.readers import read_record_stream

SCHEMA = "k string, ch string, ts timestamp, v int"


def feed(spark, folder, rows):
    df = spark.createDataFrame(rows, "k string, ch string, t string, v int")
    df.select("k", "ch", F.col("t").cast("timestamp").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return read_record_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, max_files=1)


def test_ingest_resumes_and_never_repeats(spark, tmp_path):
    src, sink, state = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "state")
    tracked = spark.createDataFrame([("old",)], "k string")
    cutoffs = spark.createDataFrame([("art", "2024-01-10")], "channel string, cutoff string").withColumn("cutoff", F.col("cutoff").cast("timestamp"))
    default = F.lit("2024-01-05").cast("timestamp")

    def run():
        q = ingest.ingest_posts(stream(spark, src), tracked, cutoffs, sink, state, "k", "ch", "ts", default)
        q.awaitTermination()
        return values(spark.read.parquet(sink), "k", "v")

    feed(spark, src, [("a", "Art", "2024-01-10", 1), ("a", "Art", "2024-01-11", 2), ("b", "art", "2024-01-09", 3), ("old", "x", "2024-02-01", 4)])
    assert run() == [("a", 1)]
    feed(spark, src, [("a", "Art", "2024-01-12", 5), ("c", "x", "2024-01-05", 6), ("d", "x", "2024-01-04", 7)])
    feed(spark, src, [("c", "x", "2024-01-06", 8), ("e", "x", "2024-01-06", 9)])
    first = run()
    assert [k for k, _ in first] == ["a", "c", "e"]
    assert run() == first  # nothing new: the checkpoint delivers no batch


def test_batch_replay_replaces_itself(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "k string")
    for _ in range(2):
        ingest.write_batch(df, str(tmp_path / "s"), 3)
    assert ingest.read_sink(df, str(tmp_path / "s")).count() == 1
    assert ingest.read_sink(df, str(tmp_path / "s"), before=3).count() == 0
    assert ingest.read_sink(df, str(tmp_path / "none")).count() == 0


def test_scan_stops_at_the_cap_over_restarts(spark, tmp_path):
    src, sink, state = tmp_path / "src", str(tmp_path / "sink"), str(tmp_path / "state")
    for part in range(4):
        feed(spark, src, [(f"{part}-{i:02d}", "c", "2024-01-01", i) for i in range(20)])

    def run(cap):
        ingest.resumable_scan(stream(spark, src), lambda b: b.filter("v % 2 = 0"), sink, state, ["k"], cap).awaitTermination()
        return spark.read.parquet(sink).count()

    assert run(25) == 25
    feed(spark, src, [(f"9-{i:02d}", "c", "2024-01-01", i) for i in range(20)])
    assert run(25) == 25
    feed(spark, src, [(f"99-{i:02d}", "c", "2024-01-01", i) for i in range(20)])
    assert run(28) == 28


def test_dedup_and_last_seen_match_batch(spark, tmp_path):
    src = tmp_path / "src"
    for part in range(3):
        feed(spark, src, [(f"k{(i * 7 + part) % 11}", "A" if i % 2 else "b", f"2024-01-{1 + i:02d}", i) for i in range(20)])
    whole = spark.read.parquet(str(src))
    unique = ingest.dedup_stream(stream(spark, src), "k", "ts", "60 days")
    out = unique.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "o")), "k") == values(whole.select("k").distinct(), "k")
    seen = ingest.track_last_seen(stream(spark, src), "ch", "ts")
    q = seen.writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = whole.groupBy(F.lower("ch").alias("channel")).agg(F.max("ts").alias("last_seen"))
    assert values(spark.table("seen"), "channel", "last_seen") == values(want, "channel", "last_seen")


def test_buffer_shuffle_keeps_every_row(spark, tmp_path):
    src = tmp_path / "src"
    for part in range(2):
        feed(spark, src, [(f"{part}-{i:02d}", "c", "2024-01-01", i) for i in range(30)])
    ingest.buffer_shuffle(stream(spark, src), str(tmp_path / "o"), str(tmp_path / "c"), "k", 1).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert values(got, "k") == values(spark.read.parquet(str(src)), "k")
    first = [r["v"] for r in got.filter("batch_id = 0").collect()]
    assert sorted(first) == list(range(30)) and first != sorted(first)


def brute_runs(flags):
    out, start = [], None
    for i, bad in enumerate([*flags, False]):
        if bad and start is None:
            start = i
        elif not bad and start is not None:
            out.append((start, i - 1, i - start))
            start = None
    return out


@pytest.mark.parametrize("flags", [[True] * 300, [False] * 50, [i % 7 < 3 for i in range(400)], [i > 90 for i in range(300)]])
def test_runs_span_ranges(spark, flags):
    df = spark.createDataFrame(list(enumerate(flags)), "i int, bad boolean").repartition(5)
    runs = guard.failure_runs(df, F.col("bad"), ["i"])
    got = sorted((r["first"]["i"], r["last"]["i"], r["length"]) for r in runs.collect())
    assert got == brute_runs(flags)


def test_guard_stops_the_stream(spark, tmp_path):
    src = tmp_path / "src"
    feed(spark, src, [(f"{i:03d}", "c", "2024-01-01", i) for i in range(50)])
    bad = F.col("v").between(10, 19)
    ingest.guarded_stream(stream(spark, src), bad, ["k"], str(tmp_path / "o"), str(tmp_path / "c"), limit=11).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 40
    q = ingest.guarded_stream(stream(spark, src), bad, ["k"], str(tmp_path / "o2"), str(tmp_path / "c2"), limit=10)
    with pytest.raises(StreamingQueryException, match="10 consecutive failures"):
        q.awaitTermination()


def test_runs_of_failures_cross_batches(spark, tmp_path):
    src = tmp_path / "src"
    for part in range(3):
        feed(spark, src, [(f"{part}-{i:02d}", "c", "2024-01-01", part * 10 + i) for i in range(10)])

    def run(bad, limit, name):
        one = stream(spark, src).sparkSession.readStream.schema(spark.read.parquet(str(src)).schema)
        one = one.option("maxFilesPerTrigger", 1).parquet(str(src))
        ingest.guarded_stream(one, bad, ["k"], str(tmp_path / name), str(tmp_path / f"{name}-c"), limit=limit).awaitTermination()
        return spark.read.parquet(str(tmp_path / name)).count()

    assert run(F.col("v").between(5, 24), 21, "a") == 10
    with pytest.raises(StreamingQueryException, match="20 consecutive failures"):
        run(F.col("v").between(5, 24), 20, "b")
    assert run(F.col("v").isin(9, 10, 11, 20), 4, "c") == 26


def test_registry_rules(spark):
    cols = "model string, status string, reason string, ts int"
    reg = spark.createDataFrame([("done", "COMPLETED", "", 5), ("retry", "INFRASTRUCTURE_FAULT", "old", 5), ("kept", "MODEL_FAULT", "m", 1)], cols)
    news = spark.createDataFrame(
        [("done", "INFRASTRUCTURE_FAULT", "late", 9), ("retry", "INFRASTRUCTURE_FAULT", "Node/GPU Out of Memory", 6), ("retry", "INFRASTRUCTURE_FAULT", "older", 2),
         ("new", "HALT", "x", 1), ("fresh", "COMPLETED", "", 3), ("kept", "HALT", "x", 9)], cols)
    got = registry.registry_update(reg, news)
    assert values(got, "model", "status", "ts") == [("done", "COMPLETED", 5), ("fresh", "COMPLETED", 3), ("kept", "MODEL_FAULT", 1), ("retry", "INFRASTRUCTURE_FAULT", 6)]
    assert values(registry.work_list(got), "model", "resources") == [("retry", "large")]
    assert values(registry.completed(got), "model") == [("done",), ("fresh",)]


def plain_summary(flags):
    runs, now = [], 0
    for bad in flags:
        now = now + 1 if bad else 0
        runs.append(now)
    head = next((i for i, bad in enumerate(flags) if not bad), len(flags))
    return guard.RunSummary(len(flags), head, runs[-1] if runs else 0, max(runs, default=0))


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 0.97, 1.0])
def test_run_summary_over_ranges(spark, monkeypatch, share):
    monkeypatch.setattr(ranges, "ROWS_PER_RANGE", 30)
    monkeypatch.setattr(ranges, "FANOUT", 4)
    rng = random.Random(int(share * 100))
    flags = [rng.random() < share for _ in range(900)]
    df = spark.createDataFrame([(i // 7, i, f) for i, f in enumerate(flags)], "a int, i int, bad boolean").repartition(5)
    got = guard.run_summary(df, F.col("bad"), ["a", "i"])
    assert got == plain_summary(flags)
    # From `least` on the longest run is exact; below it no run is taken for longer than it is.
    most = got.longest
    assert guard.run_summary(df, F.col("bad"), ["a", "i"], max(most, 1)).longest == most
    assert guard.run_summary(df, F.col("bad"), ["a", "i"], most + 1).longest <= most


def test_summaries_add_up_in_any_grouping():
    rng = random.Random(4)
    for _ in range(200):
        flags = [rng.random() < 0.7 for _ in range(rng.randint(0, 12))]
        i, j = sorted((rng.randint(0, len(flags)), rng.randint(0, len(flags))))
        a, b, c = (plain_summary(x) for x in (flags[:i], flags[i:j], flags[j:]))
        assert (a + b) + c == a + (b + c) == plain_summary(flags)


def test_no_rows_keep_the_open_run(spark):
    empty = spark.createDataFrame([], "i int, bad boolean")
    assert guard.check_failures(empty, F.col("bad"), ["i"], 10, carried=4) == 4
    ones = spark.range(5).select("id", F.lit(True).alias("bad"))
    assert guard.check_failures(ones, F.col("bad"), ["id"], 10, carried=4) == 9
    with pytest.raises(guard.TooManyFailures):
        guard.check_failures(ones, F.col("bad"), ["id"], 9, carried=4)
