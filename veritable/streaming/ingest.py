"""Incremental collection with Structured Streaming.

State that the collection scripts of old kept in files is kept by Spark: source offsets and
watermarks in the checkpoint, accepted rows in the sink. Each micro-batch writes the folder
`batch_id=<n>` by overwrite, so a batch that is replayed after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veritable.functions.hashing import order_hash
from veritable.operators.filters import since_cutoff
from veritable.operators.ranking import head_rows
from veritable.streaming.guard import check_failures
from veritable.streaming.key_index import KeyIndex


def read_sink(like: DataFrame, sink: str, before: int | None = None) -> DataFrame:
    """Rows of the sink from batches before `before` (all when None); empty when there is none."""
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
    try:
        rows = like.sparkSession.read.schema(schema).parquet(sink)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = like.sparkSession.createDataFrame([], schema)
    return rows if before is None else rows.filter(F.col("batch_id") < before)


def write_batch(batch: DataFrame, sink: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")


def _start(
    stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], available_now: bool
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def one_per_key(batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first by `order`: a map-side combinable aggregate, no window."""
    whole = F.struct(*[F.col(c) for c in batch.columns])
    return (
        batch.groupBy(key)
        .agg(F.min_by(whole, F.struct(*order)).alias("_row"))
        .select("_row.*")
    )


def ingest_posts(
    stream: DataFrame,
    tracked: DataFrame,
    cutoffs: DataFrame,
    sink: str,
    checkpoint: str,
    key: str,
    channel: str,
    created: str,
    default_cutoff: Column,
    available_now: bool = True,
) -> StreamingQuery:
    """Append posts that are not older than their channel's cutoff and not recorded yet.

    Recorded means in `tracked` or in an earlier batch of the sink; repeats inside a batch are
    dropped too. The anti join against the recorded keys is what decides, not a watermark. These are
    kept in `<sink>-keys` (`key_index`), of which a batch reads what its own hashes point at, however
    large the sink is. `tracked` is read once per start of the query.
    """
    started: list[bool] = []

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, f"{sink}-keys")
        before = index.state(batch_id)
        runs = before["runs"] if before else []
        if not started:
            old = tracked.select(key)
            if before is None:  # a sink from before there was an index
                old = old.unionByName(read_sink(batch, sink, batch_id).select(key))
            runs = index.seed(old, batch_id, runs)
        recent = since_cutoff(batch, cutoffs, channel, created, default_cutoff)
        fresh = one_per_key(recent, key, [created, key]).persist()
        known, _ = index.known(fresh.select(key).filter(F.col(key).isNotNull()), runs)
        write_batch(fresh.join(known, key, "left_anti").select(*batch.columns), sink, batch_id)
        fresh.unpersist()
        written = spark.read.schema(batch.schema).parquet(f"{sink}/batch_id={batch_id}")
        index.add(written.select(key), batch_id, runs, before)
        started.append(True)

    return _start(stream, checkpoint, handle, available_now)


def dedup_stream(stream: DataFrame, key: str, created: str, delay: str) -> DataFrame:
    """Suppress repeats of a key that arrive within the delay."""
    return stream.withWatermark(created, delay).dropDuplicatesWithinWatermark([key])


def track_last_seen(stream: DataFrame, channel: str, created: str) -> DataFrame:
    """Running latest time per lower-cased channel; write in update or complete mode."""
    return stream.groupBy(F.lower(channel).alias("channel")).agg(F.max(created).alias("last_seen"))


def resumable_scan(
    stream: DataFrame,
    accept: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    order: Sequence[str],
    cap: int | None = None,
) -> StreamingQuery:
    """Scan what is available, keep accepted rows, stop accepting at `cap`.

    The position is the checkpoint's; the accepted count is read off the sink, so a restart
    neither rereads nor exceeds the cap. `order` identifies rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        good = accept(batch)
        if cap is not None:
            before = read_sink(good, sink, batch_id).agg(F.count(F.lit(1)).alias("n")).first()["n"]
            if before >= cap:
                return
            good = head_rows(good, cap - before, order)
        write_batch(good, sink, batch_id)

    return _start(stream, checkpoint, handle, True)


def buffer_shuffle(
    stream: DataFrame, sink: str, checkpoint: str, key: str, seed: int, available_now: bool = True
) -> StreamingQuery:
    """Shuffle a stream within bounded buffers; the buffer is the micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.orderBy(order_hash(f"{seed}/{batch_id}", key), key), sink, batch_id)

    return _start(stream, checkpoint, handle, available_now)


def guarded_stream(
    stream: DataFrame,
    failed: Column,
    order: Sequence[str],
    sink: str,
    checkpoint: str,
    limit: int = 100,
    available_now: bool = True,
) -> StreamingQuery:
    """Write good records, skip bad ones, end the query on `limit` consecutive bad ones.

    Batches follow one another in `order`. The run that is open at the end of a batch is kept in
    `<sink>-runs`, one row per batch, so a run counts on whole over the borders of batches.
    """
    states = f"{sink}-runs"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        empty = spark.range(1).select(F.lit(0).cast("long").alias("open"))
        before = read_sink(empty, states).filter(F.col("batch_id") == batch_id - 1).agg(F.max("open")).first()[0]
        open_ = check_failures(batch, failed, order, limit, before or 0)
        write_batch(batch.filter(~F.coalesce(failed, F.lit(True))), sink, batch_id)
        write_batch(empty.select(F.lit(open_).cast("long").alias("open")), states, batch_id)

    return _start(stream, checkpoint, handle, available_now)
