"""Substring dedup by seed and extend, on words.

Documents are joined on winnowed anchors: the seeds of `repeats`, `SEED` words each, so that every
window of `window` words holds one. Where an anchor stands twice, its places are extended both ways:
their words to the right, and those to the left read backwards, are put in order, and the common
lengths of neighbours say how far places agree in each direction. A window around the anchor is repeated if
another place agrees as far as the window reaches to the left and to the right; runs of such windows are
the maximal repeats of `window` words or more, which are removed from all places.

Words are compared by 64-bit hashes. Anchors with more than `repeats.HOT` places are not gathered in
one task: their windows are told apart by one 64-bit hash of all 35 words each, and counted, which Spark
combines before it shuffles. Two different ones of n such windows agree by chance with odds below
n * n / 2 ** 65, 3e-8 for a million.

Defined results: a null text has no words; texts of fewer words than a window lose nothing; each row
counts as a document, equal ids or not, so a repeated row of a window or more loses all words; an
empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veritable.llm import repeats
from veritable.llm.common import prepare, schema, settle

SEED = 12


def _content(found: repeats.Sequences, i: int, window: int) -> bytes:
    """The words that the windows of a place cover."""
    start = found.start[i]
    return found.symbols[start : start + found.count[i] - 1 + window].tobytes()


def remove_repeats(docs: DataFrame, window: int = 35, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_words, n_removed, `kept` (the words left, joined by one space) and `removed`,
    the maximal repeats as (first word, word after the last)."""
    prepare(docs.sparkSession)
    seed = min(SEED, window)
    rows = repeats.keyed(docs, id_column, text_column)
    found = settle(repeats.seeds(rows, True, seed, window), "anchors")
    where = repeats.places(found, settle(repeats.repeated_seeds(found), "twice"))
    near = settle(
        repeats.candidates(rows, where, True, seed, window, lambda f, i: _content(f, i, window)), "candidates"
    )

    def repeated(table: pa.Table) -> list[np.ndarray]:
        columns = [table[c].to_numpy() for c in ("seed", "windows", "behind")]
        return repeats.repeated_windows(*columns, table["content"].to_pylist(), window, unit=8)

    spans = repeats.spans(near, window, repeated)

    def run(batches):
        for batch in batches:
            texts = repeats.encoded(batch.column(1).to_pylist())
            sizes, removed, kept, cuts = [], [], [], []
            for text, own, copied in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()  # of bytes: at ASCII white space only
                flags = repeats.covered(len(words), own, copied and len(words) >= window)
                sizes.append(len(words))
                removed.append(int(flags.sum()))
                kept.append(b" ".join(w for w, f in zip(words, flags.tolist(), strict=True) if not f) if removed[-1] else b" ".join(words))
                cuts.append([{"first": int(a), "after": int(b)} for a, b in repeats.runs(flags)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string()),
                    pa.array(cuts, pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))),
                ],
                ["id", "n_words", "n_removed", "kept", "removed"],
            )

    out = schema(docs, [(id_column, "id")], "n_words long, n_removed long, kept string, removed array<struct<first: int, after: int>>")
    return repeats.with_spans(rows, spans).mapInArrow(run, out).withColumnRenamed("id", id_column)
