"""What the two removers of repeated passages share.

A text is a sequence of symbols, words or bytes. A window is `window` symbols of one text; a window is
repeated if the same symbols also start anywhere else. Every window is tied to a seed: the `seed`
symbols with the least hash among those that lie in it, the leftmost of equal ones. Equal windows have
equal seeds at equal offsets, so only places whose seed occurs twice need a closer look.

Equal texts are one class with a number of copies. A class with copies consists of repeated windows
only; it still is a place where others can repeat.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import Rolling, Words, by_bytes, leftmost_minima, settle, text_key

#: Seeds that occur more often are compared by counting window hashes instead of in one task.
HOT = 20_000
#: Bytes of text that are worked on at once; longer texts are cut into pieces where symbols are bytes.
GROUP_BYTES = 1 << 18


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


class Sequences:
    """Symbols of several texts, text i at first[i] .. first[i + 1], and the seed of each window."""

    def __init__(self, texts: list[bytes], by_word: bool, seed: int, window: int):
        if by_word:
            words = Words(texts)
            self.symbols, self.first = words.hashes, words.first
        else:
            self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            self.symbols = self.data
            self.first = np.cumsum([0, *map(len, texts)])
        # Bytes count from 1.
        self.rolling = Rolling(self.symbols, 0 if by_word else 1)
        self.seeds = self.rolling.each(seed)
        choice = leftmost_minima(self.seeds, window - seed + 1)
        # Windows that lie in one text are open; those of texts that are shorter are not.
        steps = np.zeros(len(self.symbols) + 1, dtype=np.int8)
        long_ = np.diff(self.first) >= window
        steps[self.first[:-1][long_]] += 1
        steps[self.first[1:][long_] - window + 1] -= 1
        open_ = np.cumsum(steps[: len(choice)], dtype=np.int8) > 0
        # Runs of windows with one seed; a seed lies within one text.
        new = open_.copy()
        new[1:] &= (choice[1:] != choice[:-1]) | ~open_[:-1]
        self.start = np.flatnonzero(new)
        self.place = choice[self.start]
        last = self.first[1:][np.searchsorted(self.first, self.start, side="right") - 1] - window + 1
        self.count = np.minimum(np.append(self.start[1:], len(choice)), last) - self.start
        self.text = np.searchsorted(self.first, self.place, side="right") - 1
        # Empty texts share their start with the next one.
        self.offset = self.first[self.text]


def grouped(batch: pa.RecordBatch, by_word: bool, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(rows, symbols before, pieces) of groups of texts with a bounded number of bytes.

    A long text of bytes is cut into pieces that overlap by less than a window, so that each of its
    windows lies in one piece; `symbols before` tells where a piece starts in its text.
    """

    def pieces():
        for row, text in enumerate(encoded(batch.column("text").to_pylist())):
            if by_word or len(text) <= GROUP_BYTES:
                yield row, 0, text
            else:
                for start in range(0, len(text), GROUP_BYTES):
                    yield row, start, text[start : start + GROUP_BYTES + window - 1]

    for group in by_bytes(pieces(), lambda p: len(p[2]) + 1, GROUP_BYTES):
        rows, before, texts = zip(*group, strict=True)
        yield np.array(rows), np.array(before), list(texts)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(docs[id_column].alias("id"), docs[text_column].alias("text")).withColumn(
        "text_key", text_key(F.col("text"))
    )


def _folded(seeds: np.ndarray, texts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Row numbers of the first of each (text, seed), and the places of all of them as lists."""
    order = np.lexsort((places, seeds, texts))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (seeds[order][1:] != seeds[order][:-1]) | (texts[order][1:] != texts[order][:-1])
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(
        pa.array(np.append(first, len(order)).astype(np.int32)), pa.array(places[order].astype(np.int32))
    )
    return order[first], lists


def seeds(rows: DataFrame, by_word: bool, seed: int, window: int) -> DataFrame:
    """(seed, text_key, places) of the seeds that windows are tied to, a row per seed and text, or more
    for a text in pieces. Of texts of bytes also `head`, the bytes of the seed."""

    def run(batches):
        for batch in batches:
            for row, before, texts in grouped(batch, by_word, window):
                found = Sequences(texts, by_word, seed, window)
                hashes = found.seeds[found.place].astype(np.int64)
                owner = row[found.text]
                first, lists = _folded(hashes, owner, found.place - found.offset + before[found.text])
                columns = [pa.array(hashes[first]), batch.column(0).take(pa.array(owner[first])), lists]
                if not by_word:
                    heads = found.data[found.place[first][:, None] + np.arange(seed)]
                    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(seed), len(first), [None, pa.py_buffer(heads.tobytes())])
                    columns.append(fixed.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["seed", "text_key", "places", *([] if by_word else ["head"])]
    kind = "seed long, text_key binary, places array<int>" + ("" if by_word else ", head binary")
    return rows.select("text_key", "text").mapInArrow(run, kind)


def occurrence(place: str | Column = "place") -> Column:
    """A number for (text, place): equal for copies of a text, else different."""
    return F.xxhash64("text_key", place)


def repeated_seeds(found: DataFrame) -> DataFrame:
    """(seed) of the seeds that stand at two places or more, by their hash."""
    first, last = occurrence(F.array_min("places")), occurrence(F.array_max("places"))
    twice = found.groupBy("seed").agg(F.min(F.least(first, last)).alias("low"), F.max(F.greatest(first, last)).alias("high"))
    return twice.filter("low <> high").select("seed")


def places(found: DataFrame, repeated: DataFrame) -> DataFrame:
    """Per text with repeated seeds: `cold` and `hot` places of them. `repeated`: (seed).

    A text is one row of a seed however often it holds it.
    """
    there = settle(found.select("seed", "text_key", "places").join(repeated, "seed"), "places")
    hot = there.groupBy("seed").agg(F.sum(F.size("places")).alias("n")).filter(F.col("n") > HOT)
    marked = there.join(settle(hot.select("seed", F.lit(True).alias("hot")), "hot"), "seed", "left")
    return marked.groupBy("text_key").agg(
        F.flatten(F.collect_list(F.when(F.col("hot").isNull(), F.col("places")))).alias("cold"),
        F.flatten(F.collect_list(F.when(F.col("hot"), F.col("places")))).alias("hot"),
    )


def candidates(
    rows: DataFrame, where: DataFrame, by_word: bool, seed: int, window: int, content: Callable[[Sequences, int], bytes]
) -> DataFrame:
    """(text_key, seed, start, windows, behind, content, hot) of the windows of repeated seeds.

    A cold place is a row: `windows` windows start at `start` and later, with the seed `behind`
    symbols after the first start. The hot places of a text are one row: `hot` holds each different
    window once, and `sure` the starts of those that the text holds more than once.
    """
    texts = rows.select("text_key", "text").dropDuplicates(["text_key"]).join(where, "text_key")
    entry = pa.struct([("seed", pa.int64()), ("window", pa.int64()), ("place", pa.int32())])

    def hot_row(found: Sequences, use: np.ndarray, shift: np.ndarray) -> tuple[list[dict], list[int]]:
        which = np.repeat(use, found.count[use])
        inside = np.arange(len(which)) - np.repeat(np.cumsum(found.count[use]) - found.count[use], found.count[use])
        starts = found.start[which] + inside
        seeds_ = found.seeds[found.place[which]].astype(np.int64)
        hashes = found.rolling(starts, starts + window).astype(np.int64)
        places_ = starts - found.offset[which] + shift[found.text[which]]
        order = np.lexsort((places_, hashes, seeds_))
        same = (hashes[order][1:] == hashes[order][:-1]) & (seeds_[order][1:] == seeds_[order][:-1])
        first = np.concatenate([[True], ~same])
        more = np.concatenate([same, [False]]) | ~first
        kept = order[first]
        entries = [
            {"seed": a, "window": b, "place": c}
            for a, b, c in zip(seeds_[kept].tolist(), hashes[kept].tolist(), places_[kept].tolist(), strict=True)
        ]
        return entries, np.sort(places_[order[more]]).tolist()

    def run(batches):
        for batch in batches:
            cold, hot = batch.column("cold").to_pylist(), batch.column("hot").to_pylist()
            for row, before, texts in grouped(batch, by_word, window):
                found = Sequences(texts, by_word, seed, window)
                marks = []
                for listed in (cold, hot):
                    at = [np.asarray(listed[r], dtype=np.int64) - b for r, b in zip(row, before, strict=True)]
                    ends = np.diff(found.first)
                    wanted = [p[(p >= 0) & (p < n)] + f for p, n, f in zip(at, ends, found.first, strict=False)]
                    marks.append(np.isin(found.place, np.concatenate(wanted)))
                use = np.flatnonzero(marks[0])
                n = len(use)
                by_text = [np.flatnonzero(marks[1] & (found.text == t)) for t in np.unique(found.text[marks[1]])]
                pairs = [hot_row(found, own, before) for own in by_text]
                keys = np.concatenate([row[found.text[use]], [row[found.text[own[0]]] for own in by_text]]).astype(np.int64)

                def padded(values: np.ndarray, kind: pa.DataType, more: int = len(by_text)) -> pa.Array:
                    return pa.concat_arrays([pa.array(values, kind), pa.nulls(more, kind)])

                place = found.place[use]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(keys)),
                        padded(found.seeds[place].astype(np.int64), pa.int64()),
                        padded((found.start[use] - found.offset[use] + before[found.text[use]]).astype(np.int32), pa.int32()),
                        padded(found.count[use].astype(np.int32), pa.int32()),
                        padded((place - found.start[use]).astype(np.int32), pa.int32()),
                        padded([content(found, i) for i in use], pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.list_(entry)), pa.array([p[0] for p in pairs], pa.list_(entry))]),
                        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.int32()))]),
                    ],
                    ["text_key", "seed", "start", "windows", "behind", "content", "hot", "sure"],
                )

    kind = (
        "text_key binary, seed long, start int, windows int, behind int, content binary, "
        "hot array<struct<seed: long, window: long, place: int>>, sure array<int>"
    )
    return texts.select("text_key", "text", "cold", "hot").mapInArrow(run, kind)


def whole_seeds(batches: Iterator[pa.RecordBatch], most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about `most` rows, from rows in seed order, that hold all rows of their seeds."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= most:
            table = pa.Table.from_batches(waiting)
            names = table["seed"].to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield table.slice(0, cut)
                waiting = table.slice(cut).to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting)


def _order(keys: np.ndarray, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of `rows` within equal keys, and each one's common length in bytes with the one before."""
    sizes = np.array([len(r) for r in rows])
    padded = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), dtype=np.uint8).reshape(len(rows), width)
    order = np.argsort(np.ascontiguousarray(padded).view(f"S{width}").ravel(), kind="stable")
    order = order[np.argsort(keys[order], kind="stable")]
    differs = padded[order[1:]] != padded[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    common[keys[order[1:]] != keys[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def _with_neighbours(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest common length of each row with another one of its key, out of _order()."""
    longest = np.empty(len(order), dtype=np.int64)
    longest[order] = np.maximum(common, np.append(common[1:], -1))
    return longest


def _narrowed(order: np.ndarray, common: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_order() of the live rows alone: the least common length on the way from one to the next is theirs."""
    at = np.flatnonzero(live[order])
    between = np.minimum.reduceat(common[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else common[:0]
    return order[at], np.concatenate([[-1], between])


def _reversed(content: bytes, unit: int) -> bytes:
    return content[::-1] if unit == 1 else np.frombuffer(content, dtype=f"V{unit}")[::-1].tobytes()


def repeated_windows(
    keys: np.ndarray, counts: np.ndarray, behind: np.ndarray, contents: list[bytes], window: int, unit: int = 1
) -> list[np.ndarray]:
    """Flags of each row's windows that occur again in a row with the same key.

    A row is the symbols `contents`, `unit` bytes each, with `counts` windows from its start on and its
    seed `behind` symbols in. Rows of one key are ordered by what follows from the seed on, and by what
    stands before it, read backwards; the common lengths of neighbours cut both orders into classes
    that agree for `d` symbols. So a window that starts `o` symbols before its seed is repeated if two
    rows share the class of `o` symbols before and of `window - o` symbols after: the match is extended
    both ways as far as it goes.
    """
    places: dict[tuple, list[int]] = {}
    for i, row in enumerate(zip(keys.tolist(), behind.tolist(), contents, strict=True)):
        places.setdefault(row, []).append(i)
    flags = [None] * len(keys)
    variants: dict[int, int] = {}
    for key, _, _ in places:
        variants[key] = variants.get(key, 0) + 1
    first = []
    for row, at in places.items():
        whole = np.ones(counts[at[0]], dtype=bool)
        if len(at) > 1:
            for i in at:
                flags[i] = whole
        else:
            flags[at[0]] = ~whole
        if variants[row[0]] > 1:
            first.append(at[0])
    if not first:
        return flags
    at = np.array(first)
    own, n, back = keys[at], counts[at], behind[at]
    low = back - n + 1  # the last window starts so many bytes before the suffix
    widest = int(back.max())
    ahead, common_ahead = _order(own, [contents[i][b * unit :] for i, b in zip(at, back, strict=True)], window * unit)
    before, common_before = _order(own, [_reversed(contents[i][: b * unit], unit) for i, b in zip(at, back, strict=True)], max(widest, 1) * unit)
    # A row shares a class with a neighbour or with none, so its neighbours bound the `o` to look at.
    least = np.maximum(low, window - _with_neighbours(ahead, common_ahead) // unit)
    most = np.minimum(back, _with_neighbours(before, common_before) // unit)
    live = least <= most
    if not live.any():
        return flags
    ahead, common_ahead = _narrowed(ahead, common_ahead, live)
    before, common_before = _narrowed(before, common_before, live)
    hit = np.zeros((len(at), widest + 1), dtype=bool)
    ahead_class, before_class = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for o in range(int(least[live].min()), int(most[live].max()) + 1):
        use = np.flatnonzero((least <= o) & (o <= most))
        if len(use) < 2:
            continue
        ahead_class[ahead] = np.cumsum(common_ahead < (window - o) * unit)
        before_class[before] = np.cumsum(common_before < o * unit)
        pair = before_class[use] * (len(at) + 1) + ahead_class[use]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        hit[use[order[1:][same]], o] = True
        hit[use[order[:-1][same]], o] = True
    for j in np.flatnonzero(hit.any(axis=1)):
        i = at[j]
        flags[i] = flags[i] | hit[j, low[j] : back[j] + 1][::-1]
    return flags


def joined_runs(flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, after) of the runs of all rows, in order."""
    ends = np.cumsum([len(f) + 1 for f in flags])
    # One flag that is not set stands behind each row.
    inside = np.ones(ends[-1], dtype=bool)
    inside[ends - 1] = False
    inside[inside] = np.concatenate(flags)
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    row = np.searchsorted(ends, first, side="right")
    begin = np.append(0, ends)[row]
    return row, first - begin, after - begin


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)


def spans(found: DataFrame, window: int, repeated: Callable[[pa.Table], list[np.ndarray]]) -> DataFrame:
    """(text_key, spans) of runs of repeated windows, as (first symbol, symbol after the last).

    `repeated` flags the windows of each row of a table with whole seeds.
    """

    def run(batches):
        for table in whole_seeds(batches):
            starts = table["start"].to_numpy()
            rows, first, after = joined_runs(repeated(table))
            first, after = starts[rows] + first, starts[rows] + after - 1 + window
            keys = table["text_key"].combine_chunks().take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(first, pa.int32()), pa.array(after, pa.int32())], ["text_key", "first", "after"]
            )

    cold = (
        found.filter("content IS NOT NULL")
        .drop("hot", "sure")
        .repartition("seed")
        .sortWithinPartitions("seed")
        .mapInArrow(run, "text_key binary, first int, after int")
    )
    hot = found.filter("hot IS NOT NULL")
    listed = hot.select("text_key", F.explode("hot").alias("h")).select("text_key", "h.*")
    twice = (
        listed.groupBy("seed", "window")
        .agg(F.min(occurrence()).alias("low"), F.max(occurrence()).alias("high"))
        .filter("low <> high")
        .select("seed", "window")
    )
    shared = listed.join(settle(twice, "windows"), ["seed", "window"]).select("text_key", "place")
    # Starts go back to their texts as lists and become runs there.
    starts = shared.groupBy("text_key").agg(F.collect_list("place").alias("starts"))
    starts = starts.union(hot.filter("size(sure) > 0").select("text_key", "sure"))

    def join_up(batches):
        for batch in batches:
            cuts = []
            for own in batch.column(1).to_pylist():
                own = np.unique(np.asarray(own, dtype=np.int64))
                new = np.flatnonzero(np.diff(own, prepend=-2) > 1)
                last = np.append(new[1:], len(own)) - 1
                cuts.append([{"first": int(a), "after": int(b) + window} for a, b in zip(own[new], own[last], strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cuts, kind)], ["text_key", "cuts"])

    flagged = starts.mapInArrow(join_up, "text_key binary, cuts array<struct<first: int, after: int>>")
    single = settle(cold, "spans").select("text_key", F.array(F.struct("first", "after")).alias("cuts"))
    return single.union(flagged).groupBy("text_key").agg(F.flatten(F.collect_list("cuts")).alias("spans"))


def covered(length: int, spans_: list, all_of_it: bool) -> np.ndarray:
    """Flags of the symbols to remove."""
    if all_of_it:
        return np.ones(length, dtype=bool)
    steps = np.zeros(length + 1, dtype=np.int64)
    if spans_:
        edges = np.array([(s["first"], s["after"]) for s in spans_])
        np.add.at(steps, edges[:, 0], 1)
        np.add.at(steps, edges[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def with_spans(rows: DataFrame, found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """rows with `spans` and `copied`, whether their text occurs more than once, here or in `known`."""
    keys = rows.select("text_key")
    counted = (keys if known is None else keys.unionByName(known)).groupBy("text_key").count()
    copies = counted.filter("count > 1").select("text_key", F.lit(True).alias("copied"))
    facts = found.join(copies, "text_key", "full")
    return rows.join(settle(facts, "facts"), "text_key", "left").select(
        "id", "text", "spans", F.coalesce("copied", F.lit(False)).alias("copied")
    )
