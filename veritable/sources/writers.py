"""Writing splits, shards, appended metadata and publish layouts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.hashing import order_hash
from veritable.operators.canonical import conform
from veritable.operators.ranking import global_index, hash_rank
from veritable.operators.reports import label_share
from veritable.sources import files
from veritable.sources.commits import Claim, CommitLog, same, written_rows


def _manifest(spark: SparkSession, path: str, body: dict) -> None:
    row = spark.createDataFrame([(json.dumps(body, sort_keys=True),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(path)


def write_split(df: DataFrame, folder: str, name: str, params: Mapping[str, object]) -> dict:
    """Write `<folder>/<name>.csv` and the manifest `<name>.csv.json` beside it.

    Rows are counted by the write job itself.
    """
    seen = Observation(f"split-{name}")
    (
        df.observe(seen, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .csv(f"{folder}/{name}.csv")
    )
    body = {
        "name": name,
        "rows": seen.get["rows"],
        "timestamp": datetime.now(UTC).isoformat(),
        **params,
    }
    _manifest(df.sparkSession, f"{folder}/{name}.csv.json", body)
    return body


def assign_shards(
    df: DataFrame, key: str, rows_per_shard: int, seed: int, claim: Claim | None = None
) -> DataFrame:
    """Add `shard`: fixed-size slices of the seeded random order, numbered from 0 or as a claim says."""
    slice_ = F.floor(F.col("_rank") / F.lit(rows_per_shard)).cast("long")
    ranked = hash_rank(df, key, seed, name="_rank").withColumn("_slice", slice_).drop("_rank")
    number = F.col("_slice")
    if claim is not None:
        number = number - F.lit(claim.n_gaps) + F.lit(claim.first)
        if claim.n_gaps:
            filled = claim.gaps.select(F.col("slice").cast("long").alias("_slice"), F.col("shard").alias("_gap"))
            ranked, number = ranked.join(filled, "_slice", "left"), F.coalesce(F.col("_gap"), number)
    return ranked.withColumn("shard", number.cast("int")).drop("_slice", "_gap")


def write_shards(df: DataFrame, folder: str, key: str, rows_per_shard: int, seed: int) -> DataFrame:
    """Write each shard as one Parquet file in `shard=<i>`, beside the shards already there.

    Returns the shard sizes. Rows whose key is in the folder are skipped, so a run that is repeated
    adds nothing and a run over grown input adds what is new, under new shard numbers. Several runs may
    write at once: numbers and rows are claimed in the folder's log (`commits`).
    """
    log = CommitLog(df.sparkSession, folder)
    claim = log.claim(df.select(key), rows_per_shard)
    mine = claim.keys.distinct().withColumnRenamed(key, "_mine")
    fresh = df.join(mine, same(F.col(key), F.col("_mine")), "left_semi")
    log.write(claim, lambda: write_assigned(assign_shards(fresh, key, rows_per_shard, seed, claim), folder, key, seed))
    return shard_sizes(df.sparkSession, folder, df.schema[key].dataType, key)


def shard_sizes(spark: SparkSession, folder: str, like: T.DataType, key: str) -> DataFrame:
    return written_rows(spark, folder, key, like).groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))


def write_assigned(df: DataFrame, folder: str, key: str, seed: int) -> None:
    """Write rows that carry their `shard`, of numbers that no other run holds. A shard goes into one
    task whole; it holds a fixed number of rows by construction.

    Overwriting by partition keeps the files of a job in a staging folder of its own, where writers that
    append to one folder would share theirs.
    """
    (
        df.repartition("shard")
        .sortWithinPartitions("shard", order_hash(seed, key))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("shard")
        .parquet(folder)
    )


def append_metadata(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append rows in the fixed schema.

    Each call writes a folder of its own, under a name that readers skip, and moves it to `run=<id>` when
    it is whole: writers into one folder would share its temporary files, and the first to commit
    would remove those of the others.
    """
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    run = uuid.uuid4().hex
    rows.write.parquet(f"{path}/.run-{run}")
    if not files.rename(df.sparkSession, f"{path}/.run-{run}", f"{path}/run={run}"):
        raise OSError(f"could not move {path}/.run-{run} into place")


def pending_batches(
    shards: DataFrame, ledger: DataFrame, batch_size: int, key: str = "name", size: str = "length"
) -> tuple[DataFrame, DataFrame]:
    """(shards not in the ledger with their publish batch from 1, one line per batch).

    Shards of one name come by size, so that reruns agree; those without a name cannot be published.
    """
    rest = shards.filter(F.col(key).isNotNull()).join(ledger.select(key).distinct(), key, "left_anti")
    numbered = global_index(rest, [key, size], "_i").withColumn(
        "batch", (F.floor(F.col("_i") / F.lit(batch_size)) + 1).cast("int")
    ).drop("_i")
    batches = numbered.groupBy("batch").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(size).alias("bytes"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )
    return numbered, batches


def mark_packaged(meta: DataFrame, packaged: DataFrame | None = None, key: str = "filename") -> DataFrame:
    """`packaged` set true for all rows, or only for the keys in `packaged`."""
    if packaged is None:
        return meta.withColumn("packaged", F.lit(True))
    done = packaged.select(key).distinct().withColumn("_done", F.lit(True))
    return (
        meta.join(done, key, "left")
        .withColumn("packaged", F.coalesce("_done", "packaged", F.lit(False)))
        .drop("_done")
    )


def only_new(meta: DataFrame) -> DataFrame:
    """Rows no earlier run has packaged."""
    return meta.filter(~F.coalesce(F.col("packaged"), F.lit(False)))


def write_records(df: DataFrame, folder: str, drop: Sequence[str] = ()) -> None:
    """JSON lines without the raw payload columns."""
    df.drop(*drop).write.mode("overwrite").json(folder)


def publish_layout(
    splits: Mapping[str, DataFrame], config: str, schema: T.StructType, key: str, seed: int
) -> DataFrame:
    """Named splits under one config: conformed with NULL fill, tagged, in seeded random order."""
    out: DataFrame | None = None
    for name, df in splits.items():
        part = conform(df, schema, fill=None).withColumns(
            {"config": F.lit(config), "split": F.lit(name)}
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("_h", order_hash(seed, key))


def write_layout(layout: DataFrame, folder: str, key: str) -> None:
    """Partition by config and split; rows inside a partition are range-sorted by the hash."""
    (
        layout.repartitionByRange("config", "split", "_h", key)
        .sortWithinPartitions("config", "split", "_h", key)
        .drop("_h")
        .write.mode("overwrite")
        .partitionBy("config", "split")
        .parquet(folder)
    )


def layout_shares(layout: DataFrame) -> DataFrame:
    return label_share(layout, ["config", "split"])
