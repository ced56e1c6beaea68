"""Language identification: multinomial naive Bayes over hashed character n-grams.

`fit` counts n-grams of labelled rows per language in `BUCKETS` cells. It learns from at most about
`MOST_ROWS` labelled rows, picked by a hash of the id and the text when there are more; the model is
one matrix of (cells x languages) log probabilities, which is broadcast; more languages than make
`BROADCAST_BYTES` are an error, found before anything is collected.
`predict` scores every row and whole texts: it hashes the n-grams of a batch at once, adds up the
rows of the matrix per text, and gives the best language and its posterior.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing was
learned; rows without text or language teach nothing; the lowest language name wins a tie; equal
texts get equal results. Only id and text are read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import schema

BUCKETS = 1 << 16
LENGTHS = (1, 2, 3)
MOST_ROWS = 20_000
SMOOTHING = 0.5
#: The matrix may not be larger: 256 languages.
BROADCAST_BYTES = 64 << 20
UNKNOWN = "und"
_BATCH_CHARS = 1 << 20


def cells(codes: np.ndarray, length: int) -> np.ndarray:
    """Cell of the n-gram that starts at each place where one fits."""
    n = max(len(codes) - length + 1, 0)
    with np.errstate(over="ignore"):
        mixed = np.full(n, length, dtype=np.uint64)
        for i in range(length):
            mixed = (mixed ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
    return (mixed & np.uint64(BUCKETS - 1)).astype(np.int32)


def text_cells(codes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Cell of the n-gram at each place of joined texts; BUCKETS where it would leave its text."""
    found = np.full(len(codes), BUCKETS, dtype=np.int32)
    whole = cells(codes, length)
    found[: len(whole)] = whole
    for back in range(1, length):
        found[np.maximum(starts[1:] - back, 0)] = BUCKETS
    return found


def packed(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, code points, starts) of groups of texts, each text between two spaces."""
    at = 0
    while at < len(texts):
        group, chars, first = [], 0, at
        while at < len(texts) and (not group or chars < _BATCH_CHARS):
            group.append(f" {texts[at].lower()} ")
            chars += len(group[-1])
            at += 1
        codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        ends = np.cumsum([len(g) for g in group])
        yield first, codes, np.concatenate([[0], ends])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", most_rows: int = MOST_ROWS) -> dict:
    """{"langs": [...], "matrix": float32 array of (BUCKETS, langs), "prior": array}."""
    rows = labelled.select(
        labelled[lang_column].cast("string").alias("lang"), labelled[text_column].alias("text"), labelled[id_column].alias("id")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    there = labelled.filter(F.col(lang_column).isNotNull()).count()
    if there > most_rows:
        chance = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.filter(chance < most_rows / there)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang and has_letter(t)]
                seen[lang] = seen.get(lang, 0) + len(own)
                sums = found.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, codes, starts in packed(own):
                    for length in LENGTHS:
                        sums += np.bincount(text_cells(codes, starts, length), minlength=BUCKETS + 1)[:BUCKETS]
        for lang, sums in found.items():
            at = np.flatnonzero(sums)
            # Cell -1 holds the number of texts.
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(at) + 1), pa.string()),
                    pa.array(np.concatenate([[-1], at]).astype(np.int32)),
                    pa.array(np.concatenate([[seen[lang]], sums[at]]).astype(np.int64)),
                ],
                ["lang", "cell", "n"],
            )

    # The languages are counted before their cells come to the driver.
    most = BROADCAST_BYTES // (BUCKETS * 4)
    if rows.select("lang").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} languages make a matrix beyond {BROADCAST_BYTES} bytes")
    counts = (
        rows.select("lang", "text")
        .mapInArrow(count, "lang string, cell int, n long")
        .groupBy("lang", "cell")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.collect_list(F.struct("cell", "n")).alias("cells"))  # at most BUCKETS + 1
        .orderBy("lang")
        .collect()
    )
    langs, columns, texts = [], [], []
    for row in counts:
        table = np.zeros(BUCKETS + 1)
        for cell, n in row["cells"]:
            table[cell] = n
        if table[-1] > 0:
            langs.append(row["lang"])
            texts.append(table[-1])
            smooth = table[:-1] + SMOOTHING
            columns.append(np.log(smooth / smooth.sum()))
    if not langs:
        return {"langs": [], "matrix": np.zeros((BUCKETS, 0), dtype=np.float32), "prior": np.zeros(0)}
    prior = np.log(np.array(texts) / sum(texts))
    return {"langs": langs, "matrix": np.stack(columns, axis=1).astype(np.float32), "prior": prior}


def score_texts(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    matrix = np.vstack([model["matrix"], np.zeros((1, len(langs)), dtype=np.float32)])
    totals = np.tile(model["prior"], (len(texts), 1))
    known = np.array([bool(langs) and has_letter(t) for t in texts], dtype=bool)
    for first, codes, starts in packed([t or "" for t in texts]):
        last = first + len(starts) - 1
        if not langs:
            break
        for length in LENGTHS:
            found = matrix[text_cells(codes, starts, length)]
            totals[first:last] += np.add.reduceat(found, starts[:-1], axis=0, dtype=np.float64)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = totals.argmax(axis=1)
    shares = np.exp(totals - totals.max(axis=1, keepdims=True))
    score = shares.max(axis=1) / shares.sum(axis=1)
    names = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
    return names, np.where(known, score, 0.0)


def predict(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = score_texts(shared.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
            )

    plain = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    return plain.mapInArrow(run, schema(docs, [(id_column, "id")], "lang_pred string, score double")).withColumnRenamed("id", id_column)
