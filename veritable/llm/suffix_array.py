"""Suffix-array dedup of long repeated byte strings, with a logarithmic family of indexes.

Suffixes that start at the seeds of `repeats` are indexed, about one in eighty-five; every window holds
one. A level of the `Family` is a table of suffixes in byte order: the first `SEED` bytes (`head`), the
text and the place, one row for all suffixes of one head, which says whether they are several. A new
batch is put in byte order, by ranges of heads, and each suffix is compared with its neighbour: where
their common length is the whole head, it repeats. The batch is then scanned against every level, both
merged in byte order, for heads that they share, and becomes a level of its own. Two levels of equal
size merge to one of twice the size by the same scan, so a suffix is rewritten a logarithmic number
of times. A family with a folder keeps its levels and their texts there, and batches that come later
meet them; without one it goes when the places are found.

Heads found twice lead to the long matches. The suffixes of such a head form a suffix array by their
bytes up to the length of a window, and their beginnings, reversed, a second one. Neighbours' common
lengths cut both into classes that agree in `d` bytes, so a window that starts `o` bytes before the
suffix is repeated if two suffixes share the class of `o` bytes before and of `window - o` bytes
after. No hash decides here.

Heads with more than `repeats.HOT` places are not gathered in one task: their windows are told apart by
one 64-bit hash of 200 bytes each and counted, which Spark combines before it shuffles. Two different
ones of n such windows agree by chance with odds below n * n / 2 ** 65, 3e-8 for a million.

Defined results: a null text is empty; shorter texts than a window lose nothing; each row counts as a
document, equal ids or not, so a repeated row of a window or more loses all; an empty table gives an
empty result. Only id and text are read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritable.llm import repeats
from veritable.llm.common import prepare, remove, rows_in_batches, schema, settle, write
from veritable.operators.ranges import Splits, split_points
from veritable.session import fresh_path
from veritable.sources import files

SEED = 32
#: The third batch is the first before which two levels merge.
BATCHES = 3
#: Suffixes of a range of heads, and rows that are put in order at once.
RANGE_ROWS = 200_000
#: Suffixes are short rows: more of them than of texts go to a task's Python at once.
BATCH_ROWS = 10_000
#: Borders of so many ranges are sent to the tasks, some 2 MB; more are joined to the rows.
MOST_BORDERS = 1 << 16

_ENTRY = "head binary, text_key binary, place int, several boolean"


def _scan(head: np.ndarray, key: np.ndarray, low: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in byte order of their heads, the first of each head, and whether it is one of several.

    Neighbours whose heads differ within their common length end a run.
    """
    bytes_ = head.view(np.uint8).reshape(len(head), -1)
    differs = bytes_[1:] != bytes_[:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), bytes_.shape[1])
    new = np.concatenate([[True], common < bytes_.shape[1]])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    other = (key != key[first][run]) | (low != low[first][run]) | several
    return first, np.bincount(run, other, minlength=len(first)) > 0


def _fixed(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Binary values of one width as numpy bytes; equal bytes are equal there, and in byte order."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view(f"S{width}")


def _fold(table: pa.Table) -> pa.Table:
    """One row per head of rows in byte order: its first suffix and whether there are others."""
    head, key = _fixed(table["head"], len(table["head"][0].as_py())), _fixed(table["text_key"], 16)
    first, many = _scan(head, key, table["place"].to_numpy(), table["several"].to_numpy())
    return table.take(pa.array(first)).set_column(3, table.schema.field("several"), pa.array(many))


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of RANGE_ROWS rows at a time, keep two of each head, others of which are told by `several`, so that
    a head that very many suffixes have moves as a few rows. In: _ENTRY and `seed`, a hash of the head."""
    waiting: list[pa.RecordBatch] = []

    def thinned() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        seed = table["seed"].to_numpy()
        order = np.argsort(seed, kind="stable")
        same = seed[order][1:] == seed[order][:-1]
        # Rows with an equal one on both sides stand in the middle of three or more.
        middle = np.concatenate([[False], same]) & np.concatenate([same, [False]])
        if middle.any():
            several = table["several"].to_numpy().copy()
            run = np.cumsum(np.concatenate([[True], ~same])) - 1
            key = _fixed(table["text_key"], 16)[order]
            low = table["place"].to_numpy()[order]
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            other = (key != key[start][run]) | (low != low[start][run]) | several[order]
            several[order] |= (np.bincount(run, other) > 0)[run]
            table = table.set_column(3, table.schema.field("several"), pa.array(several)).take(pa.array(np.sort(order[~middle])))
        yield from table.drop_columns(["seed"]).to_batches()

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= RANGE_ROWS:
            yield from thinned()
            waiting.clear()
    if waiting:
        yield from thinned()


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold rows that come in byte order; the last head of a batch waits for the next one."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        folded = _fold(pa.concat_tables([rest, table]) if rest is not None else table)
        rest = folded.slice(folded.num_rows - 1)
        yield from folded.slice(0, folded.num_rows - 1).to_batches()
    if rest is not None:
        yield from rest.to_batches()


def _splits(entries: DataFrame) -> Splits:
    """Borders of ranges of heads of RANGE_ROWS rows."""
    rows = entries.count()
    return split_points(entries.select("head"), ["head"], rows, max(-(-rows // RANGE_ROWS), 1))


def _borders(spark: SparkSession, splits: Splits) -> list[bytes]:
    """The split points of all levels, in byte order."""
    found = [] if splits.top is None else spark.range(1).select(splits.top.alias("_bounds")).collect()
    for table, _ in splits.below:
        found += table.select("_bounds").collect()
    return sorted(bytes(point["head"]) for row in found for point in row["_bounds"])


def _numbering(borders: list[bytes], thin: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Add the number of each row's range, how many borders are not above its head."""

    def run(batches):
        for batch in _thin(batches) if thin else batches:
            if batch.num_rows:
                number = np.zeros(batch.num_rows, dtype=np.int64)
                if borders:
                    width = len(borders[0])
                    number = np.searchsorted(np.array(borders, dtype=f"S{width}"), _fixed(batch.column("head"), width), side="right")
                yield batch.append_column("range", pa.array(number, pa.int64()))

    return run


def _in_byte_order(entries: DataFrame, splits: Splits) -> DataFrame:
    """The suffix array of entries: ranges of heads, in order and one row per head."""
    thin = "seed" in entries.columns
    if splits.ranges <= MOST_BORDERS:
        numbered = entries.mapInArrow(_numbering(_borders(entries.sparkSession, splits), thin), f"{_ENTRY}, range long")
    else:
        numbered = splits.number(entries.mapInArrow(_thin, _ENTRY) if thin else entries, "range")
    dealt = numbered.repartition(splits.ranges, "range")
    return dealt.sortWithinPartitions("head").drop("range").mapInArrow(_scan_batches, _ENTRY)


class Family:
    """Levels of suffixes in byte order, (rank, path), largest first; with a folder they stay there."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder
        self.levels: list[tuple[int, str]] = []
        self.texts: list[str] = []
        if folder and files.exists(spark, f"{folder}/state.json"):
            state = json.loads(files.read_text(spark, f"{folder}/state.json"))
            self.levels, self.texts = [tuple(level) for level in state["levels"]], state["texts"]

    def _path(self, label: str) -> str:
        return f"{self.folder}/{label}-{uuid.uuid4().hex}" if self.folder else fresh_path(self.spark, label)

    def _write(self, df: DataFrame, label: str) -> str:
        path = self._path(label)
        df.write.parquet(path)
        return path

    def level(self, path: str) -> DataFrame:
        return self.spark.read.schema(_ENTRY).parquet(path)

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Index a batch of suffixes (seed, head, text_key, places); the heads that it holds more than once or
        shares with a level, each as a written table of (head)."""
        with rows_in_batches(self.spark, BATCH_ROWS):
            return self._add(batch)

    def _add(self, batch: DataFrame) -> list[DataFrame]:
        put_aside = []
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, one), (_, two) = self.levels.pop(), self.levels.pop()
            both = self.level(one).unionByName(self.level(two))
            self.levels.append((rank + 1, self._write(_in_byte_order(both, _splits(both)), "level")))
            put_aside += [one, two]
        low, high = F.array_min("places"), F.array_max("places")
        entries = batch.select("head", "text_key", low.alias("place"), (low != high).alias("several"), "seed")
        splits = _splits(entries)
        path = self._write(_in_byte_order(entries, splits), "level")
        new = self.level(path)
        shared = [write(new.filter("several").select("head"), "shared")[0]]
        for rank, old in self.levels:
            # What is several in both together, but in neither alone, is shared by them.
            alone = self.level(old).withColumn("several", F.lit(False))
            # A level of one batch has about the borders of this one.
            borders = splits if rank == 0 else _splits(alone)
            both = _in_byte_order(alone.unionByName(new.withColumn("several", F.lit(False))), borders)
            shared.append(write(both.filter("several").select("head"), "shared")[0])
        self.levels.append((0, path))
        if self.folder:
            self._commit()
        remove(self.spark, *put_aside)
        return shared

    def keep_texts(self, rows: DataFrame) -> None:
        """Keep the texts (text_key, text) of a batch beside its suffixes."""
        self.texts.append(self._write(rows.select("text_key", "text").dropDuplicates(["text_key"]), "texts"))
        self._commit()

    def kept_texts(self) -> DataFrame | None:
        return self.spark.read.parquet(*self.texts) if self.texts else None

    def _commit(self) -> None:
        files.replace(self.spark, f"{self.folder}/state.json", json.dumps({"levels": self.levels, "texts": self.texts}))

    def drop(self) -> None:
        remove(self.spark, *[path for _, path in self.levels])


def _content(found: repeats.Sequences, i: int, window: int) -> bytes:
    start = found.start[i]
    return found.data[start : start + found.count[i] - 1 + window].tobytes()


def _whole(text: bytes, first: int, after: int) -> tuple[int, int]:
    """A run without the characters that it covers in part."""
    while first < after and text[first] & 0xC0 == 0x80:
        first += 1
    while first < after < len(text) and text[after] & 0xC0 == 0x80:
        after -= 1
    return first, after


def _merged(spans: pa.Array, all_of_it: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, after) of the maximal runs that the spans of each row cover, in order; of some rows all."""
    listed = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    row = np.concatenate([np.repeat(np.arange(len(spans)), listed), np.flatnonzero(all_of_it)])
    first = np.concatenate([flat.field("first").to_numpy(zero_copy_only=False), np.zeros(all_of_it.sum(), dtype=np.int64)]).astype(np.int64)
    after = np.concatenate([flat.field("after").to_numpy(zero_copy_only=False), sizes[all_of_it]]).astype(np.int64)
    order = np.lexsort((first, row))
    row, first, after = row[order], first[order], after[order]
    # Rows stand one behind the other, with room between them.
    apart = row * (int(sizes.max(initial=0)) + 2)
    reach = np.maximum.accumulate(after + apart)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (first + apart)[1:] > reach[:-1]
    last = np.append(new[1:], True)[: len(row)]
    return row[new], first[new], (reach - apart)[last]


def remove_repeats(docs: DataFrame, window: int = 200, id_column: str = "doc_id", text_column: str = "text", batches: int = BATCHES, whole_characters: bool = False, folder: str | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, `kept` (the bytes left) and `removed`, the maximal runs as
    (first byte, byte after the last). With `whole_characters` a run loses the characters that it
    covers in part, so that what is kept is UTF-8.

    With a `folder` the rows are a batch that comes to the family kept there: strings that also start in
    an earlier batch repeat too, and the batch stays. The rows given earlier are not judged again.
    """
    spark = prepare(docs.sparkSession)
    seed = min(SEED, window)
    rows = repeats.keyed(docs, id_column, text_column)
    batch = F.pmod(F.xxhash64("text_key"), F.lit(batches)).cast("int")
    found = settle(repeats.seeds(rows, False, seed, window).withColumn("batch", batch), "suffixes")
    family, shared = Family(spark, folder), None
    earlier = family.kept_texts()
    for number in range(batches):
        for heads in family.add(found.filter(F.col("batch") == number)):
            shared = heads if shared is None else shared.unionByName(heads)
    twice = settle(shared.select(F.xxhash64("head").alias("seed")).distinct(), "twice")
    every, suffixes, known = rows, found.drop("batch"), None
    if earlier is not None:
        # Texts of earlier batches that hold a shared head are read for it again, as places to compare with.
        suffixes = suffixes.unionByName(repeats.seeds(earlier, False, seed, window))
        every = rows.select("text_key", "text").unionByName(earlier)
        known = settle(earlier.select("text_key").distinct(), "known")
    where = repeats.places(suffixes.withColumn("seed", F.xxhash64("head")), twice)
    near = settle(
        repeats.candidates(every, where, False, seed, window, lambda f, i: _content(f, i, window)), "candidates"
    )
    if folder:
        family.keep_texts(rows)
    else:
        family.drop()

    def repeated(table: pa.Table) -> list[np.ndarray]:
        columns = [table[c].to_numpy() for c in ("seed", "windows", "behind")]
        return repeats.repeated_windows(*columns, table["content"].to_pylist(), window)

    spans = repeats.spans(near, window, repeated)

    def run(batches):
        for batch in batches:
            texts = repeats.encoded(batch.column(1).to_pylist())
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            copied = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & (sizes >= window)
            row, first, after = _merged(batch.column(2), copied, sizes)
            if whole_characters:
                cut = [_whole(texts[r], a, b) for r, a, b in zip(row.tolist(), first.tolist(), after.tolist(), strict=True)]
                first, after = np.array(cut, dtype=np.int64).reshape(-1, 2).T
                some = first < after
                row, first, after = row[some], first[some], after[some]
            removed = np.bincount(row, after - first, minlength=len(texts)).astype(np.int64)
            ends = np.cumsum(np.bincount(row, minlength=len(texts)))
            kept = list(texts)
            for r in np.unique(row).tolist():
                own = slice(ends[r - 1] if r else 0, ends[r])
                edges = zip([0, *after[own].tolist()], [*first[own].tolist(), len(texts[r])], strict=True)
                kept[r] = b"".join(texts[r][a:b] for a, b in edges)
            run_kind = pa.struct([("first", pa.int32()), ("after", pa.int32())])
            cuts = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(after, pa.int32())], fields=list(run_kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(removed),
                    pa.array(kept, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), cuts),
                ],
                ["id", "n_bytes", "n_removed", "kept", "removed"],
            )

    out = schema(docs, [(id_column, "id")], "n_bytes long, n_removed long, kept binary, removed array<struct<first: int, after: int>>")
    return repeats.with_spans(rows, spans, known).mapInArrow(run, out).withColumnRenamed("id", id_column)
