"""Quoted CSV whose records span lines, read by many tasks a file.

Spark cuts a file at line ends only where no record spans lines, so such a file is one task. Here the
lines are read from all blocks of a file at once. Whether a line end lies inside quotes follows from the
number of quotes before it: a task cannot know how many stood before its block, so it joins its lines
to records both ways, as if its block began outside quotes and inside them. The quotes of each block, added
up along the file, then say which way is right, one row per block. What a block border cuts is put
together from the pieces, at most two per block.

Quotes must be RFC 4180: a field that holds one is quoted, and quotes inside are doubled (an even
number). Lines end with \\n or \\r\\n. Blank lines between records are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.session import settle

BAD = "_bad_record"
ROWS = 5_000  # of a batch

_PIECES = "file string, block long, inside boolean, k long, continues boolean, open boolean, text string"


class _Joiner:
    """Pieces of one block, read as if it began inside quotes or not."""

    def __init__(self, file: str, block: int, inside: bool):
        self.key = (file, block, inside)
        self.quoted, self.continues, self.k = inside, inside, 0
        self.lines: list[str] = []

    def add(self, line: str) -> tuple | None:
        self.lines.append(line)
        self.quoted ^= line.count('"') % 2 == 1
        return None if self.quoted else self._piece()

    def _piece(self) -> tuple:
        piece = (*self.key, self.k, self.continues, self.quoted, "\n".join(self.lines))
        self.lines, self.continues, self.k = [], False, self.k + 1
        return piece

    def rest(self) -> tuple | None:
        return self._piece() if self.lines else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _PIECES.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
    at, joiners, rows = None, [], []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    for batch in batches:
        for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != at:
                rows += [r for j in joiners if (r := j.rest()) is not None]
                at, joiners = (file, block), [_Joiner(file, block, False), _Joiner(file, block, True)]
            rows += [r for j in joiners if (r := j.add(line)) is not None]
        if len(rows) >= ROWS:
            yield batch_of(rows)
            rows = []
    rows += [r for j in joiners if (r := j.rest()) is not None]
    yield batch_of(rows)


def records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """(`file`, `text`): the records of the files, each whole, without the header."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"')))
    blocks = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    begins = settle(blocks.select("file", "block", inside.alias("inside")), "blocks")
    right = lines.mapInArrow(_pieces, _PIECES).join(begins, ["file", "block", "inside"])
    cut = F.col("continues") | F.col("open")
    whole = right.filter(~cut).select("file", "block", "k", "text")
    # The first piece of a cut record is not a continuation; those behind it are, until one closes.
    line = Window.partitionBy("file").orderBy("block", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = right.filter(cut).withColumn("id", F.count_if(~F.col("continues")).over(line)).groupBy("file", "id")
    joined = parts.agg(
        F.min(F.struct("block", "k")).alias("at"), F.array_sort(F.collect_list(F.struct("block", "k", "text"))).alias("pieces")
    )
    text = F.array_join(F.transform("pieces", lambda p: p["text"]), "\n")
    found = whole.unionByName(joined.select("file", F.col("at.block").alias("block"), F.col("at.k").alias("k"), text.alias("text")))
    if header:
        found = found.filter((F.col("block") > 0) | (F.col("k") > 0))
    ended = F.regexp_replace("text", r"\r\z", "")
    return found.select("file", ended.alias("text")).filter(F.length(F.trim("text")) > 0)


def parse(rows: DataFrame, schema: T.StructType, mode: str, text: Column | str = "text") -> DataFrame:
    """Records as columns; those that do not fit raise (FAILFAST) or are left out (DROPMALFORMED)."""
    kept = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"escape": '"', "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    read = (schema if mode == "FAILFAST" else kept).fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read)
    parsed = rows.select("*", F.from_csv(text, ddl, options).alias("_r"))
    if mode != "FAILFAST":
        parsed = parsed.filter(F.col(f"_r.{BAD}").isNull())
    return parsed.select(*[c for c in rows.columns if c != text], *[F.col(f"_r.`{f.name}`").alias(f.name) for f in schema.fields])
