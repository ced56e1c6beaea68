"""Several writers into one folder: no number twice, no row twice, none lost."""

from threading import Thread

import pytest
from helpers import values
from pyspark.sql import functions as F

from veritable import schemas
from veritable.plans.packaging import package
from veritable.sources import commits, files, writers
from veritable.sources.commits import CommitLog


def keys(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v"))


def check(spark, folder, start, end, per_shard):
    """Every row once, each number of one size and one file."""
    assert values(spark.read.parquet(folder), "k") == values(keys(spark, start, end), "k")
    rows = spark.read.parquet(folder).withColumn("file", F.col("_metadata.file_name"))
    files_ = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    assert all(r.n <= per_shard and r.files == 1 for r in files_.collect())


def test_a_writer_that_comes_between(spark, tmp_path, monkeypatch):
    folder, real, calls = str(tmp_path / "s"), CommitLog._step, []

    def step(log, version, state, done):
        calls.append(done)
        if len(calls) == 1:  # before the first claim is made, another run claims, writes and commits
            writers.write_shards(keys(spark, 50, 150), folder, "k", 20, 7)
        return real(log, version, state, done)

    monkeypatch.setattr(CommitLog, "_step", step)
    writers.write_shards(keys(spark, 0, 100), folder, "k", 20, 7)
    check(spark, folder, 0, 150, 20)
    assert len(calls) == 5  # one claim failed and was made again
    assert values(writers.shard_sizes(spark, folder, spark.read.parquet(folder).schema["k"].dataType, "k"), "shard", "rows") == (
        [(i, 20) for i in range(7)] + [(7, 10)]
    )


def test_rows_of_an_open_claim_are_left_to_it(spark, tmp_path):
    folder = str(tmp_path / "s")
    log = CommitLog(spark, folder)
    open_ = log.claim(keys(spark, 0, 30).select("k"), 10)
    writers.write_shards(keys(spark, 20, 60), folder, "k", 10, 1)
    assert values(spark.read.parquet(folder).select("shard").distinct(), "shard") == [(3,), (4,), (5,)]
    mine = keys(spark, 0, 60).join(open_.keys, "k", "left_semi")
    log.write(open_, lambda: writers.write_assigned(writers.assign_shards(mine, "k", 10, 1, open_), folder, "k", 1))
    check(spark, folder, 0, 60, 10)
    assert values(spark.read.parquet(folder).select("shard").distinct(), "shard") == [(i,) for i in range(6)]
    assert log.latest()[1]["open"] == {}


def test_rows_and_numbers_of_a_run_that_fails_are_taken_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    real = writers.write_assigned

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(writers, "write_assigned", broken)
    with pytest.raises(RuntimeError, match="lost"):
        writers.write_shards(keys(spark, 0, 30), folder, "k", 10, 1)
    monkeypatch.setattr(writers, "write_assigned", real)
    writers.write_shards(keys(spark, 0, 45), folder, "k", 10, 1)
    check(spark, folder, 0, 45, 10)
    # A run whose driver is gone leaves its claim open; it counts until it is old.
    CommitLog(spark, folder).claim(keys(spark, 45, 55).select("k"), 10)
    writers.write_shards(keys(spark, 0, 55), folder, "k", 10, 1)
    check(spark, folder, 0, 45, 10)
    monkeypatch.setattr(commits, "ABANDONED", -1)
    writers.write_shards(keys(spark, 0, 55), folder, "k", 10, 1)
    check(spark, folder, 0, 55, 10)
    assert values(spark.read.parquet(folder).select("shard").distinct(), "shard") == [(i,) for i in range(6)]


def test_two_runs_at_once(spark, tmp_path):
    folder, meta, errors = str(tmp_path / "s"), str(tmp_path / "m"), []
    row = spark.createDataFrame([("f", "fake", "s", "2024-01-02", "i", "false")], "filename string, label string, subreddit string, post_date string, reddit_id string, packaged string")

    def run(start):
        try:
            writers.write_shards(keys(spark, start, start + 120), folder, "k", 25, 3)
            writers.append_metadata(row, meta, schemas.POSTS)
        except Exception as error:
            errors.append(error)

    threads = [Thread(target=run, args=(start,)) for start in (0, 60, 60)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    writers.write_shards(keys(spark, 0, 180), folder, "k", 25, 3)  # what open claims held back
    check(spark, folder, 0, 180, 25)
    assert spark.read.parquet(meta).count() == 3


def test_packaging_beside_an_open_run(spark, tmp_path):
    folder = str(tmp_path / "out")
    media = spark.createDataFrame([(f"f{i}.jpg", bytes([i])) for i in range(9)], "name string, content binary")
    scores = spark.createDataFrame([], "filename string, scores array<struct<label string, score double>>")
    meta = spark.createDataFrame([(f"f{i}.jpg", False) for i in range(9)], "filename string, packaged boolean")
    CommitLog(spark, folder).claim(meta.limit(0).select("filename").union(spark.createDataFrame([("f0.jpg",)], "f string")), 4, "path")
    out = package(meta, media, scores, folder, rows_per_shard=4)
    assert values(out["shards"], "shard", "rows") == [(1, 4), (2, 4)]
    assert values(out["meta"].filter("not packaged"), "filename") == [("f0.jpg",)]


def test_null_keys_are_written_once(spark, tmp_path):
    folder = str(tmp_path / "s")
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    for _ in range(2):
        writers.write_shards(rows, folder, "k", 10, 1)
    assert spark.read.parquet(folder).count() == 2


def test_small_files(spark, tmp_path):
    path = str(tmp_path / "d" / "one.json")
    assert files.create(spark, path, "ä") and not files.create(spark, path, "b")
    assert files.read_text(spark, path) == "ä" and files.names(spark, str(tmp_path / "d")) == ["one.json"]
    assert files.names(spark, str(tmp_path / "none")) == [] and files.size(spark, path) == 2
