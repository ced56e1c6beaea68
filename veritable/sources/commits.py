"""A log of the runs that write numbered shards into one folder.

A run claims its shard numbers and its rows before it writes and commits them after. The log is a
sequence of small files `_commits/<version>.json`, each the state after one step: the next free number and
the claims that are open. A step is made by creating the next version, which only one of several
writers can; the others read the new state and try again. So two runs never hold one number, and a row
that an open claim holds is left to that run. A claim that fails is dropped, one that is silent for
`ABANDONED` hours counts as dropped; its rows and numbers are taken by the next run.

Numbers without rows below the next one (shards that were taken away, or a run that ended between
its files) are filled first, by a run that finds no other claim open. They are joined to the slices that
get them; no list of numbers or keys reaches the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.operators.ranking import global_index
from veritable.session import settle
from veritable.sources import files

ABANDONED = 24
EMPTY = {"next": 0, "open": {}}


@dataclass
class Claim:
    run: str
    keys: DataFrame  # of the rows that the run is to write; one column, repeated as the rows are
    rows: int
    first: int  # of the numbers behind the last one
    fresh: int
    gaps: DataFrame | None  # (slice, shard): numbers that had no rows, for the first slices
    n_gaps: int


def written_rows(spark: SparkSession, folder: str, key: str, like: T.DataType) -> DataFrame:
    """(key, `shard`) of the rows already there; none when the folder does not exist yet."""
    try:
        return spark.read.parquet(folder).select(key, F.col("shard").cast("int"))
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        schema = T.StructType([T.StructField(key, like), T.StructField("shard", T.IntegerType())])
        return spark.createDataFrame([], schema)


def same(left: Column, right: Column) -> Column:
    """Equal keys; null is a key like any other."""
    return left.eqNullSafe(right)


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder, f"{folder}/_commits"

    def latest(self) -> tuple[int, dict]:
        """(version, state); version 0 before the first step."""
        versions = [n for n in files.names(self.spark, self.log) if n.endswith(".json") and not n.startswith(".")]
        if not versions:
            return 0, EMPTY
        return int(versions[-1][:20]), json.loads(files.read_text(self.spark, f"{self.log}/{versions[-1]}"))

    def _step(self, version: int, state: dict, done: dict) -> bool:
        text = json.dumps({**state, "done": {**done, "at": datetime.now(UTC).isoformat()}}, sort_keys=True)
        return files.create(self.spark, f"{self.log}/{version + 1:020d}.json", text)

    def claim(self, keys: DataFrame, rows_per_shard: int, key: str | None = None) -> Claim:
        """Claim those of the rows that are not written or claimed yet, and numbers for them.

        `keys` has one column, one row per row to write; `key` is its name in the folder.
        """
        spark, (column,) = self.spark, keys.columns
        key, run = key or column, uuid.uuid4().hex
        keys = settle(keys, "keys")
        own = f"{self.log}/keys/{run}"
        while True:
            version, state = self.latest()
            limit = (datetime.now(UTC) - timedelta(hours=ABANDONED)).isoformat()
            open_ = {r: c for r, c in state["open"].items() if c["at"] >= limit}
            # Read after the state: what is committed in between makes the step below fail.
            written = settle(written_rows(spark, self.folder, key, keys.schema[column].dataType), "written")
            taken = written.select(F.col(key).alias("_taken"))
            for claim in open_.values():
                taken = taken.union(spark.read.parquet(claim["keys"]))
            keys.join(taken, same(F.col(column), F.col("_taken")), "left_anti").write.mode("overwrite").parquet(own)
            rest = spark.read.parquet(own)
            rows = rest.count()
            shards = written.select("shard").distinct()
            last = shards.agg(F.max("shard")).first()[0]
            next_ = max(state["next"], 0 if last is None else last + 1)
            gaps, n_gaps = None, 0
            if next_ and not open_:
                every = spark.range(next_).select(F.col("id").cast("int").alias("shard"))
                gaps = settle(global_index(every.join(shards, "shard", "left_anti"), ["shard"], "slice"), "gaps")
                n_gaps = gaps.count()
            fresh = max(-(-rows // rows_per_shard) - n_gaps, 0)
            mine = {"first": next_, "fresh": fresh, "gaps": n_gaps, "rows": rows, "keys": own, "at": datetime.now(UTC).isoformat()}
            if self._step(version, {"next": next_ + fresh, "open": {**open_, run: mine}}, {"claimed": run}):
                return Claim(run, rest, rows, next_, fresh, gaps, n_gaps)

    def _close(self, run: str, kind: str) -> None:
        while True:
            version, state = self.latest()
            mine = state["open"].get(run)
            rest = {r: c for r, c in state["open"].items() if r != run}
            if self._step(version, {"next": state["next"], "open": rest}, {kind: run, "claim": mine}):
                return

    def write(self, claim: Claim, job: Callable[[], None]) -> None:
        """Run the writing job of a claim, and commit the claim or drop it."""
        try:
            job()
        except BaseException:
            self._close(claim.run, "dropped")
            raise
        self._close(claim.run, "committed")
