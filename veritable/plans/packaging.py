"""From collected posts to shards ready to publish."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.operators.filters import keep_existing, moderate
from veritable.sources.commits import CommitLog, same, written_rows
from veritable.sources.readers import embed_payload
from veritable.sources.writers import assign_shards, mark_packaged, only_new, shard_sizes, write_assigned


def package(
    meta: DataFrame,
    media: DataFrame,
    scores: DataFrame,
    folder: str,
    key: str = "filename",
    rows_per_shard: int = 500,
    seed: int = 42,
    threshold: float = 0.7,
    label: str = "nsfw",
) -> dict[str, DataFrame]:
    """Moderate, drop rows without a file, embed payloads, write shards, flag what was written.

    `media` is (`name`, `content`); `scores` is (key, `scores`). Only rows no earlier run has
    packaged or written, and no open one has claimed, are taken (`commits`). A row is flagged if its
    key is in the folder, whichever run wrote it.
    """
    spark, kind = meta.sparkSession, meta.schema[key].dataType
    written = written_rows(spark, folder, "path", kind)
    fresh = only_new(meta).join(written.select(F.col("path").alias(key)), key, "left_anti")
    fresh = fresh.join(scores, key, "left")
    passed, quarantine = moderate(fresh, "scores", label, threshold)
    # Shards are dealt among the narrow rows that have a file, before any payload is touched, so
    # payloads move twice at most: to their row and to their shard.
    listing = media.select(F.col("name").alias(key))
    present, missing = keep_existing(passed.drop("scores"), listing, key)
    log = CommitLog(spark, folder)
    claim = log.claim(present.select(key), rows_per_shard, "path")
    mine = claim.keys.distinct().withColumnRenamed(key, "_mine")
    dealt = present.join(mine, same(F.col(key), F.col("_mine")), "left_semi")
    dealt = assign_shards(dealt, key, rows_per_shard, seed, claim)
    embedded, _ = embed_payload(dealt, media, key)
    rows = embedded.withColumn("path", F.col("image.path"))
    log.write(claim, lambda: write_assigned(rows, folder, "path", seed))
    return {
        "shards": shard_sizes(spark, folder, kind, "path"),
        "quarantine": quarantine,
        "missing": missing,
        "meta": mark_packaged(meta, written_rows(spark, folder, "path", kind).select(F.col("path").alias(key)), key),
    }
