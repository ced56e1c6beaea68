"""An index of the keys that a sink holds, read in parts that do not grow with the sink.

Keys are kept in runs. A run is a Parquet table of slots of about SLOT_KEYS keys each: the slot of a
key is given by the first bits of its hash, a Bloom filter of 32 768 bits stands beside the keys of a
slot, and SLOTS_PER_BUCKET slots are one folder `bucket=<i>`; a run that fits one bucket is a plain list. A batch of keys is looked up by opening
the folders of its own hashes alone, and there the column of filters; only slots whose filter lets a
key through have their keys read and compared. So what a batch reads follows from its own size.

Each batch adds a run. MERGE_AT runs of one level become one run of the next, so the number of runs
grows with the logarithm of the number of batches and a key is rewritten as often. Which runs count is
said by a small state file per batch: a batch that is replayed starts from the state before it and
overwrites its own run.

Null keys are not indexed.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.session import settle
from veritable.sources import files

SLOT_KEYS = 2048
SLOTS_PER_BUCKET = 32
FILTER_BITS = 32_768  # what bitmap_construct_agg holds
HASHES = 4
MERGE_AT = 8
#: Batches with more keys than this read the filters of all buckets.
FEW_KEYS = 200_000


def _slot(key: Column, slots: int) -> Column:
    bits = slots.bit_length() - 1
    return F.shiftrightunsigned(F.xxhash64(key), 64 - bits).cast("int") if bits else F.lit(0)


def _bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(FILTER_BITS)) for i in range(HASHES)]


def _is_set(filter_: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(filter_, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1


class KeyIndex:
    def __init__(self, spark: SparkSession, folder: str, slot_keys: int = SLOT_KEYS, merge_at: int = MERGE_AT):
        self.spark, self.folder, self.slot_keys, self.merge_at = spark, folder, slot_keys, merge_at

    # ------------------------------------------------------------------ state

    def _state_path(self, batch_id: int) -> str:
        return f"{self.folder}/state/{batch_id:020d}.json"

    def state(self, before: int) -> dict | None:
        """The state that the last batch before this one left; None if there was none."""
        earlier = [n for n in files.names(self.spark, f"{self.folder}/state") if n.endswith(".json") and int(n[:20]) < before]
        return json.loads(files.read_text(self.spark, f"{self.folder}/state/{earlier[-1]}")) if earlier else None

    def _commit(self, batch_id: int, runs: list[dict], retired: list[str], previous: dict | None) -> None:
        files.replace(self.spark, self._state_path(batch_id), json.dumps({"batch": batch_id, "runs": runs, "retired": retired}))
        if previous is None:
            return
        # The batch before is done for good once this one is, so what it put aside is read no more.
        files.delete(self.spark, *previous["retired"])
        for name in files.names(self.spark, f"{self.folder}/state"):
            if name.endswith(".json") and int(name[:20]) < previous["batch"]:
                files.delete(self.spark, f"{self.folder}/state/{name}")

    # ------------------------------------------------------------------ runs

    def _write_run(self, keys: DataFrame, name: str, level: int) -> dict | None:
        """`keys`: one column, distinct and not null. A run of one bucket is its keys alone."""
        (column,) = keys.columns
        path = f"{self.folder}/{name}"
        keys.select(F.col(column).alias("key")).write.mode("overwrite").parquet(f"{path}-keys")
        keys = self.spark.read.parquet(f"{path}-keys")
        n = keys.count()
        if not n:
            files.delete(self.spark, f"{path}-keys")
            return None
        slots = 1 << max((n - 1) // self.slot_keys, 0).bit_length()
        if slots <= SLOTS_PER_BUCKET:
            return {"path": f"{path}-keys", "level": level, "slots": slots, "keys": n}
        key = F.col("key")
        rows = keys.select(key.alias("key"), _slot(key, slots).alias("slot"))
        rows = rows.withColumn("bucket", F.floor(F.col("slot") / SLOTS_PER_BUCKET).cast("int")).repartition("bucket")
        marks = rows.select("bucket", "slot", "key", F.posexplode(F.array(*_bits(F.col("key")))).alias("i", "bit"))
        table = marks.groupBy("bucket", "slot").agg(
            F.bitmap_construct_agg("bit").alias("filter"),
            F.collect_list(F.when(F.col("i") == 0, F.col("key"))).alias("keys"),
        )
        table.sortWithinPartitions("bucket", "slot").write.mode("overwrite").partitionBy("bucket").parquet(path)
        files.delete(self.spark, f"{path}-keys")
        return {"path": path, "level": level, "slots": slots, "keys": n}

    def _keys_of(self, runs: list[dict], column: str) -> DataFrame:
        found = None
        for run in runs:
            one = self.spark.read.parquet(run["path"])
            one = one.select((F.col("key") if run["slots"] <= SLOTS_PER_BUCKET else F.explode("keys")).alias(column))
            found = one if found is None else found.unionByName(one)
        return found

    def add(self, keys: DataFrame, batch_id: int, runs: list[dict], previous: dict | None) -> None:
        """Record the keys of a batch (distinct, in none of `runs`) and the state after it."""
        (column,) = keys.columns
        own = self._write_run(keys.filter(F.col(column).isNotNull()), f"run-{batch_id}-0", 0)
        runs, retired, level = [*runs, *([own] if own else [])], [], 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.merge_at:
            merged = self._write_run(self._keys_of(full, column), f"run-{batch_id}-{level + 1}", level + 1)
            runs = [r for r in runs if r["level"] != level] + [merged]
            retired += [r["path"] for r in full]
            level += 1
        self._commit(batch_id, runs, retired, previous)

    def seed(self, keys: DataFrame, batch_id: int, runs: list[dict]) -> list[dict]:
        """`runs` and one with those of the keys that are in none of them, from before the batch."""
        (column,) = keys.columns
        fresh = keys.filter(F.col(column).isNotNull()).distinct()
        if runs:
            known, _ = self.known(fresh, runs)
            fresh = fresh.join(known, column, "left_anti")
        run = self._write_run(fresh, f"seed-{batch_id}", 1)
        return [*runs, run] if run else runs

    # ------------------------------------------------------------------ look-up

    def _read(self, run: dict, buckets: list[int] | None, columns: list[str]) -> DataFrame | None:
        """Columns of the slots in some buckets (all when None)."""
        path = run["path"]
        if buckets is None:
            return self.spark.read.parquet(path).select(*columns)
        if not buckets:
            return None
        # Folders by name: neither listed nor read are those of other hashes. A bucket without keys has none.
        held = (f"{path}/bucket={b}" for b in buckets)
        there = list(held) if run["keys"] > 50 * run["slots"] else [p for p in held if files.exists(self.spark, p)]
        return self.spark.read.option("basePath", path).parquet(*there).select(*columns) if there else None

    def _touched(self, keys: DataFrame, runs: list[dict], column: str) -> list[list[int] | None]:
        """Per run the buckets that the keys' hashes fall in, all (None) for many keys."""
        if not runs:
            return []
        bucket = [F.floor(_slot(F.col(column), r["slots"]) / SLOTS_PER_BUCKET).cast("int") for r in runs]
        sets = [F.collect_set(F.when(F.col("_few"), b)).alias(f"b{i}") for i, b in enumerate(bucket)]
        few = keys.select(column).limit(FEW_KEYS + 1).count() <= FEW_KEYS
        found = keys.withColumn("_few", F.lit(few)).agg(*sets).first()
        return [sorted(found[i]) if few else None for i in range(len(runs))]

    def known(self, keys: DataFrame, runs: list[dict]) -> tuple[DataFrame, list[str]]:
        """(the keys that some run holds, the files that were opened to tell).

        `keys`: one column; it is read several times.
        """
        (column,) = keys.columns
        key = F.col(column)
        opened, near, found = [], None, keys.filter(F.lit(False))
        small = [r for r in runs if r["slots"] <= SLOTS_PER_BUCKET]
        if small:  # one bucket each, compared as it is
            held = self._keys_of(small, column)
            opened += held.inputFiles()
            found = keys.join(held, column, "left_semi")
        runs = [r for r in runs if r["slots"] > SLOTS_PER_BUCKET]
        for i, (run, buckets) in enumerate(zip(runs, self._touched(keys, runs, column), strict=True)):
            filters = self._read(run, buckets, ["slot", "filter"])
            if filters is None:
                continue
            opened += filters.inputFiles()
            tested = keys.select(column, _slot(key, run["slots"]).alias("slot")).join(filters, "slot")
            for bit in _bits(key):
                tested = tested.filter(_is_set(F.col("filter"), bit))
            one = tested.select(F.lit(i).alias("run"), column, "slot")
            near = one if near is None else near.unionByName(one)
        if near is None:
            return found, opened
        near = settle(near, "near")
        bucket = F.floor(F.col("slot") / SLOTS_PER_BUCKET).cast("int")
        where = near.groupBy("run").agg(F.collect_set(bucket).alias("buckets"), F.count("*").alias("n")).collect()
        for row in where:
            run = runs[row["run"]]
            listed = self._read(run, sorted(row["buckets"]) if row["n"] <= FEW_KEYS else None, ["slot", "keys"])
            mine = near.filter(F.col("run") == row["run"]).join(listed, "slot")
            found = found.unionByName(mine.filter(F.array_contains("keys", key)).select(column))
        return found, opened
