"""What each of five document filters takes away under every order of applying them.

Words are counted in a sparse document-term matrix. Texts are read in blocks of some megabytes; a
block becomes a CSR shard over the words of the block. The words of a shard stand in the order of a
hash, so those of a range of hashes are one slice; slices of all shards meet by range and get the
codes of a global dictionary, and the shards are recoded by it. Row sums of a shard are the words of its
documents, nonzero counts their distinct words. With the other flags of a document these make a set
of failed filters; documents are counted per part and set, and the counts alone decide what every
step of every order removes.

Filters, by letter: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals A-Z > 5 *
code points; D holds one of #$%&*|; E equals the text of a smaller id.

Handling: a null text is empty (fails A alone, and E when an empty text of a smaller id is there); a
null source counts as the part ''; a row without id neither fails E nor makes others fail, and has no
labels; rows of one id count each, and those with equal text and id don't fail E by one another; of
repeated labels of an id the greatest counts. An empty table has no parts and gives no rows. Other
columns are not read. No row holds more than a block: `BLOCK_BYTES` or one text; texts are split into
words in pieces of `PIECE_BYTES`. A task of the dictionary holds the distinct words of one range.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from veritable.llm.common import Rolling, by_bytes, bytes_in_batches, schema, word_bounds, write

FILTERS = "ABCDE"
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20  # that Python gets at once: texts, or some shards
RANGE_BYTES = 8 << 20  # of words of all shards in a range of hashes, while there are not MOST_RANGES
MOST_RANGES = 1 << 14
MARKS = b"#$%&*|"
#: Parquet looks at sizes every hundred rows, and a reader takes a row group at once. A row here is some
#: megabytes, so sizes are looked at with every row and a row group holds a few: what a task needs does not
#: follow from how much text the task that wrote the file had.
SHARD_FILES = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_BLOCK = """block long, ids array<{id}>, parts array<string>, keys array<binary>, flags array<int>,
    starts array<long>, terms array<int>, counts array<int>"""


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text cut at white space into pieces near PIECE_BYTES."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        gap = _SPACE.search(text, at + PIECE_BYTES)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:]


def _hashes(words: bytes) -> np.ndarray:
    """A hash of each of the words that stand in one blank after the other."""
    data = np.frombuffer(words, dtype=np.uint8)
    starts, ends = word_bounds(data)
    return Rolling(data, plus=1)(starts, ends)


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of each word of the texts its text's number and its code; the words by code, in the order of a hash."""
    chunks, rows = [], []
    for row, text in enumerate(texts):
        for piece in _pieces(text):
            words = piece.split()  # of bytes: at runs of ASCII white space
            chunks.append(pa.array(words, pa.binary()))
            rows.append(np.full(len(words), row, dtype=np.int32))
    coded = pa.chunked_array(chunks, pa.binary()).combine_chunks().dictionary_encode()
    words = coded.dictionary.to_pylist()
    order = np.argsort(_hashes(b" ".join(words)), kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return np.concatenate(rows), rank[coded.indices.to_numpy()], [words[i] for i in order.tolist()]


def _marked(text: bytes) -> int:
    """The filters C and D that a text fails, as bits."""
    data = np.frombuffer(text, dtype=np.uint8)
    capitals = np.count_nonzero((data >= 65) & (data <= 90))
    points = np.count_nonzero((data & 0xC0) != 0x80)
    return 4 * (100 * capitals > 5 * points) + 8 * any(mark in text for mark in MARKS)


def _lists(values: list, kind: pa.DataType) -> pa.Array:
    """One list, as the only row of a column."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """CSR shards with codes of their own: `starts`, `terms`, `counts` over `words` (one blank between
    two), and of each row the id, the part, a 128-bit key of the text and the filters C and D it fails."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 12
        rows = (
            (i, part, (text or "").encode())
            for batch in batches
            for i, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
        )
        for n, group in enumerate(by_bytes(rows, lambda r: len(r[2]) + 64, BLOCK_BYTES)):
            if n >> 12:
                raise ValueError("a partition of over 4096 blocks: read the texts in smaller partitions")
            ids, parts, texts = zip(*group, strict=True)
            owner, code, words = _codes(list(texts))
            width = max(len(words), 1)
            cells, counts = np.unique(owner * np.int64(width) + code, return_counts=True)
            columns = [
                pa.array([first + n], pa.int64()),
                _lists(list(ids), id_type),
                _lists(list(parts), pa.string()),
                _lists([hashlib.md5(t).digest() for t in texts], pa.binary()),
                _lists([_marked(t) for t in texts], pa.int32()),
                _lists(np.searchsorted(cells, np.arange(len(texts) + 1) * width), pa.int64()),
                _lists((cells % width).astype(np.int32), pa.int32()),
                _lists(counts.astype(np.int32), pa.int32()),
                pa.array([b" ".join(words)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_column].dataType
    out = schema(docs, [], f"{_BLOCK.format(id=kind.simpleString())}, words binary")
    names = [f.name for f in out.fields]
    plain = docs.select(
        docs[id_column].alias("id"),
        F.coalesce(docs[part_column].cast("string"), F.lit("")).alias("part"),
        docs[text_column].alias("text"),
    )
    id_type = to_arrow_type(kind)
    return plain.mapInArrow(shards, out)


def coded_words(shards: DataFrame) -> DataFrame:
    """(block, part, words, codes): the words of each range of hashes in each shard, and their codes.

    A range's codes are numbered as its words come, by block; codes of different ranges differ.
    """
    size = shards.agg(F.sum(F.length("words"))).first()[0] or 0
    ranges = max(min(-(-size // RANGE_BYTES), MOST_RANGES), 1)
    borders = np.array([i * (1 << 64) // ranges for i in range(1, ranges)], dtype=np.uint64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = [0, *np.searchsorted(_hashes(words), borders).tolist()]
                listed = words.split()
                slices = [b" ".join(listed[i:j]) for i, j in zip(at, [*at[1:], len(listed)], strict=True)]
                some = [i for i, s in enumerate(slices) if s]
                columns = [pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([slices[i] for i in some], pa.binary())], ["block", "part", "words"])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}
        for batch in batches:
            codes = []
            for part, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if part != now:
                    now, known = part, {}
                new = np.array([known.setdefault(w, len(known)) for w in words.split()], dtype=np.int64)
                codes.append(((part << 40) + new).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*batch.schema.names, "codes"])

    slices = shards.select("block", "words").mapInArrow(cut, "block long, part int, words binary")
    met = slices.repartition(F.col("part")).sortWithinPartitions("part", "block")
    return met.mapInArrow(code, "block long, part int, words binary, codes binary")


def _with_codes(docs: DataFrame, id_column: str, text_column: str, part_column: str) -> tuple[DataFrame, DataFrame]:
    """Shards with `codes`, the slices of their words' codes in order; the dictionary."""
    shards, _ = write(blocks(docs, id_column, text_column, part_column), "shards", SHARD_FILES)
    words = coded_words(shards)
    codes = words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("known"))
    joined = shards.drop("words").join(codes, "block", "left")
    return joined.select(*joined.columns[:-1], F.col("known.codes").alias("codes")), words


def _recoded(batch: pa.RecordBatch, i: int) -> np.ndarray:
    """The terms of a shard by the codes of the dictionary."""
    known = np.frombuffer(b"".join(batch.column("codes")[i].as_py() or []), dtype=np.int64)
    return known[batch.column("terms")[i].values.to_numpy()]


def term_matrix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> tuple[DataFrame, DataFrame]:
    """The document-term matrix as CSR shards whose `terms` are codes of the dictionary, and the dictionary
    as `coded_words` gives it, a row per shard and range."""
    coded, words = _with_codes(docs, id_column, text_column, part_column)

    def recode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                terms = _lists(_recoded(batch, i), pa.int64())
                yield pa.RecordBatch.from_arrays([terms if c == "terms" else row.column(c) for c in names], names)

    out = schema(docs, [], _BLOCK.format(id=docs.schema[id_column].dataType.simpleString()))
    out["terms"].dataType.elementType = LongType()
    names = out.names
    return coded.mapInArrow(recode, out), words


def measure(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source"
) -> DataFrame:
    """(id, part, text_key, n_words, n_distinct, marked) of every document: row sums and nonzero counts of
    the matrix, taken shard by shard as it is recoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, parts, keys, flags, starts, counts = (
                    batch.column(c)[i].values for c in ("ids", "parts", "keys", "flags", "starts", "counts")
                )
                at = starts.to_numpy()
                upto = np.concatenate([[0], np.cumsum(counts.to_numpy(), dtype=np.int64)])
                # A row's cells are one per code, so codes that differ from the one before start a cell.
                terms = _recoded(batch, i)
                new = np.ones(len(terms) + 1, dtype=np.int64)
                new[1:-1] = terms[1:] != terms[:-1]
                new[at[:-1]] = 1
                cells = np.concatenate([[0], np.cumsum(new[:-1])])
                columns = [ids, parts, keys, pa.array(upto[at[1:]] - upto[at[:-1]]), pa.array(cells[at[1:]] - cells[at[:-1]]), flags]
                yield pa.RecordBatch.from_arrays(columns, names)

    coded, _ = _with_codes(docs, id_column, text_column, part_column)
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", "part", "text_key", "n_words", "n_distinct", "marked"]
    plain = coded.select("ids", "parts", "keys", "flags", "starts", "terms", "counts", "codes")
    return plain.mapInArrow(run, f"id {kind}, part string, text_key binary, n_words long, n_distinct long, marked int")


def failures(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(part, failed, good, toxic, n): documents by the set of filters that they fail, as bits of A to E.

    Which of equal texts has the smallest id is settled on counts per text, part and label: no text's
    rows meet in one place.
    """
    few = (100 * F.col("n_distinct") < 65 * F.col("n_words")).cast("int") * 2
    failed = (F.col("n_words") < 50).cast("int") + few + F.col("marked")
    counted = rows.withColumn("failed", failed).groupBy("text_key", "part", "id", "failed").agg(F.count("*").alias("n"))
    # Rows without an id have no labels; they are spread over the tasks of the join.
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text_key", "part"), F.lit(4096))).otherwise(0)
    marks = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("label_id"))
    marks = marks.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    ).withColumn("none", F.lit(0).cast("long"))
    counted = counted.withColumn("spread", spread.cast("long"))
    known = counted.join(marks, (F.col("id") == F.col("label_id")) & (F.col("spread") == F.col("none")), "left")
    known = known.withColumns({"good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))})
    groups = known.groupBy("text_key", "part", "failed", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("text_key"))
    original = F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    groups = groups.withColumn("own", F.coalesce(original, F.lit(0)) + F.col("nameless"))
    kinds = F.array(
        F.struct(F.col("failed").alias("failed"), F.col("own").alias("n")),
        F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - F.col("own")).alias("n")),
    )
    both = groups.select("part", "good", "toxic", F.inline(kinds)).filter("n > 0")
    return both.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))


def _steps() -> list[dict]:
    rows = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(letter) for letter in order]
        rows += [
            {"filter_order": "".join(order), "step": i + 1, "bit": bits[i], "before": sum(bits[:i])} for i in range(len(order))
        ]
    return rows


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, order and step the counts of documents, from those by set of failed filters.

    A part is one row of at most 2 ** 7 counts, which every step reads.
    """
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "good", "toxic", "n")).alias("sets"))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,bit:int,before:int>>")
    rows = sets.select("part", "sets", F.inline(steps))

    def total(which, weight=lambda x: x["n"]):
        return F.aggregate(F.filter("sets", which), F.lit(0).cast("long"), lambda s, x: s + weight(x).cast("long"))

    def fails(x):
        return x["failed"].bitwiseAND(F.col("bit")) != 0

    def passed(x):
        return x["failed"].bitwiseAND(F.col("before")) == 0

    def orders(x):
        # Each of the filters that a document fails stands first of them in an equal share of the orders.
        return x["n"] * (F.lit(len(_steps()) // len(FILTERS)) / F.bit_count(x["failed"]))

    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: passed(x) & ~fails(x)).alias("kept"),
        total(lambda x: passed(x) & fails(x)).alias("removed"),
        total(lambda x: ~passed(x) & fails(x)).alias("redundant"),
        total(lambda x: x["failed"] == F.col("bit")).alias("unique_fails"),
        total(lambda x: passed(x) & fails(x) & x["good"]).alias("good_lost"),
        total(lambda x: passed(x) & fails(x) & x["toxic"]).alias("toxic_lost"),
        total(fails, orders).alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, with what the step keeps and removes."""
    with bytes_in_batches(docs.sparkSession, BATCH_BYTES):
        rows = measure(docs, id_column, text_column, part_column)
        counts, _ = write(failures(rows, labels, id_column), "failures")
    return interactions(counts)
