"""Streaming queries, run to the end of what is available; the result is the sink.

Each run gets a fresh sink and checkpoint under the session's shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.catalog.base import query, table
from veritable.session import fresh_path
from veritable.sources.readers import read_record_stream
from veritable.streaming.guard import failure_runs as failure_runs_of
from veritable.streaming import ingest


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    stream = read_record_stream(spark, d, schema, max_files=4, pattern="events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(running) -> None:
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()


CUTS = """
WITH c AS (SELECT event_type AS channel, max(ts) AS cutoff FROM events
           WHERE event_type IN ('click', 'error') AND value > 200 GROUP BY event_type)"""


def _cutoffs(spark, d):
    history = table(spark, d, "events").filter(F.col("event_type").isin("click", "error") & (F.col("value") > 200))
    return history.groupBy(F.col("event_type").alias("channel")).agg(F.max(F.col("ts").cast("timestamp")).alias("cutoff"))


@query(f"""{CUTS},
     r AS (SELECT event_type || '-' || CAST(user_id AS VARCHAR) AS file, event_id, ts FROM events LEFT JOIN c ON event_type = channel
           WHERE ts >= coalesce(cutoff, TIMESTAMP '2024-01-10')),
     o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts, file) AS place FROM r)
SELECT file, event_id FROM o WHERE place = 1
  AND file NOT IN (SELECT event_type || '-' || CAST(user_id AS VARCHAR) FROM events WHERE value > 150)""")
def ingest_posts(spark, d):
    file = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"))
    stream = _event_stream(spark, d).withColumn("file", file).drop("props")
    tracked = table(spark, d, "events").filter("value > 150").select(file.alias("file"))
    sink, checkpoint = fresh_path(spark, "posts"), fresh_path(spark, "posts-state")
    default = F.lit("2024-01-10").cast("timestamp")
    _finish(ingest.ingest_posts(stream, tracked, _cutoffs(spark, d), sink, checkpoint, "file", "event_type", "ts", default))
    return spark.read.parquet(sink).select("file", "event_id")


@query("SELECT DISTINCT user_id FROM events")
def dedup_stream(spark, d):
    unique = ingest.dedup_stream(_event_stream(spark, d).select("user_id", "ts"), "user_id", "ts", "40 days")
    sink, checkpoint = fresh_path(spark, "dedup"), fresh_path(spark, "dedup-state")
    _finish(
        unique.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .option("path", sink).trigger(availableNow=True).start()
    )
    return spark.read.parquet(sink).select("user_id")


@query("SELECT event_type AS channel, max(ts) AS last_seen FROM events GROUP BY event_type")
def track_last_seen(spark, d):
    running = ingest.track_last_seen(_event_stream(spark, d), "event_type", "ts")
    sink, checkpoint = fresh_path(spark, "seen"), fresh_path(spark, "seen-state")

    def keep(batch, batch_id):
        ingest.write_batch(batch, sink, batch_id)

    _finish(
        running.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    seen = spark.read.parquet(sink).groupBy("channel").agg(F.max_by("last_seen", "batch_id").alias("last_seen"))
    return seen.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("SELECT event_id FROM events WHERE value > 100 ORDER BY event_id LIMIT 500")
def resumable_scan(spark, d):
    sink, checkpoint = fresh_path(spark, "scan"), fresh_path(spark, "scan-state")
    _finish(
        ingest.resumable_scan(
            _event_stream(spark, d), lambda batch: batch.filter("value > 100"), sink, checkpoint, ["event_id"], 500
        )
    )
    return spark.read.parquet(sink).select("event_id")


@query("SELECT event_id, value FROM events")
def buffer_shuffle(spark, d):
    sink, checkpoint = fresh_path(spark, "mixed"), fresh_path(spark, "mixed-state")
    _finish(ingest.buffer_shuffle(_event_stream(spark, d), sink, checkpoint, "event_id", 42))
    return spark.read.parquet(sink).select("event_id", "value")


@query("""
WITH e AS (SELECT event_id, event_type IN ('error', 'signup') AS bad FROM events),
     g AS (SELECT *, count(*) FILTER (NOT bad) OVER (ORDER BY event_id) AS since FROM e)
SELECT min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM g WHERE bad GROUP BY since""")
def failure_runs(spark, d):
    bad = F.col("event_type").isin("error", "signup")
    runs = failure_runs_of(table(spark, d, "events"), bad, ["event_id"])
    return runs.select("first.event_id", F.col("last.event_id").alias("last"), "length").withColumnRenamed("event_id", "first")


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def failure_guard(spark, d):
    sink, checkpoint = fresh_path(spark, "good"), fresh_path(spark, "good-state")
    _finish(
        ingest.guarded_stream(
            _event_stream(spark, d), F.col("event_type") == "error", ["event_id"], sink, checkpoint, limit=100
        )
    )
    return spark.read.parquet(sink).select("event_id")
