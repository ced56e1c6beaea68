"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.session import fresh_path, settle

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

SETTINGS = {
    # Texts can be long: few rows to an Arrow batch keep the Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "500",
    # What a finished query shuffled is of no more use; the next one writes its own.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def rows_in_batches(spark: SparkSession, rows: int):
    """Jobs that run inside give Python so many rows at once; for short rows only."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bytes_in_batches(spark: SparkSession, most: int):
    """Jobs that run inside give Python rows of about so many bytes at once, or one row; for long rows."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that this package wrote to the shared folder itself."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write(df: DataFrame, label: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """settle(), with the path so that the table can be removed after use; options of the writer."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def schema(docs: DataFrame, kept: Sequence[tuple[str, str]], more: str) -> T.StructType:
    """Columns of `docs` under new names, (column, name), and further ones in DDL."""
    fields = [T.StructField(name, docs.schema[column].dataType) for column, name in kept]
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def held_out_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


# ------------------------------------------------------------------------- numpy inside tasks

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        steps = np.full(n, base, dtype=np.uint64)
        if n:
            steps[0] = 1
        return np.multiply.accumulate(steps)


#: Numbers that are worked on at once: what is made on the way then stays in memory that is already there.
PIECE = 1 << 13
_POWERS: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    """powers(), kept in the worker for sequences of usual lengths."""
    if n > 1 << 19:
        return powers(base, n)
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = powers(base, 1 << max(n - 1, 0).bit_length())
    return _POWERS[base][:n]


class Rolling:
    """Polynomial hashes of any range of a sequence from its prefix sums, modulo 2 ** 64. `plus` is added
    to each symbol."""

    BASE = 0x9E3779B97F4A7C15
    BACK = pow(BASE, -1, 1 << 64)

    def __init__(self, symbols: np.ndarray, plus: int = 0):
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        steps = _kept_powers(self.BASE, n)
        with np.errstate(over="ignore"):
            for a in range(0, n, PIECE):
                part = symbols[a : a + PIECE].astype(np.uint64)
                if plus:
                    part += np.uint64(plus)
                part *= steps[a : a + PIECE]
                part[0] += self.sums[a]
                np.cumsum(part, out=self.sums[a + 1 : a + 1 + len(part)])
        self.back = _kept_powers(self.BACK, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def each(self, width: int) -> np.ndarray:
        """Hash of the range of that width at every place where it fits."""
        n = max(len(self.sums) - width, 0)
        found = np.empty(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for a in range(0, n, PIECE):
                b = min(a + PIECE, n)
                found[a:b] = mix((self.sums[a + width : b + width] - self.sums[a:b]) * self.back[a:b])
        return found


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` hashes the place of its smallest, the leftmost of equal ones.

    Hashes count by their upper 40 bits; the lower 24 hold the place within a piece of the input.
    """
    n = max(len(hashes) - width + 1, 0)
    found = np.empty(n, dtype=np.int64)
    low, piece = np.uint64((1 << 24) - 1), max(PIECE, min(8 * width, 1 << 23))
    for start in range(0, n, piece):
        part = hashes[start : start + piece + width - 1]
        best = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        done = 1
        while done < width:
            step = min(done, width - done)
            best = np.minimum(best[:-step], best[step:])
            done += step
        found[start : start + piece] = (best & low).astype(np.int64) + start
    return found


def by_bytes(rows: Iterator, size, most: int) -> Iterator[list]:
    """Group rows so that the sizes of a group stay near `most`."""
    group, total = [], 0
    for row in rows:
        group.append(row)
        total += size(row)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group

class Words:
    """Words of several UTF-8 texts at once: hashes, places in the joined bytes, first word of each text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        self.starts, self.ends = word_bounds(self.data)
        self.text_starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.text_starts)  # first[i] .. first[i + 1]: words of text i
        # Bytes count from 1, so that a leading zero byte is not nothing.
        self.hashes = Rolling(self.data.astype(np.uint64) + np.uint64(1))(self.starts, self.ends)


__all__ = [
    "WORD", "prepare", "rows_in_batches", "bytes_in_batches", "words", "text_key", "remove", "write", "settle", "schema", "held_out_fold", "mix", "powers",
    "Rolling", "Words", "word_bounds", "leftmost_minima", "by_bytes",
]
