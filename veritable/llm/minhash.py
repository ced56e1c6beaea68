"""MinHash near-dedup with odd sketches.

Every text becomes the set of its distinct word shingles. `SAMPLES` MinHash samples serve twice:
in `SAMPLES / ROWS` bands they propose candidates, and folded into a bitmap where each sample flips
one bit (an odd sketch) they rate a candidate: two bitmaps differ in a number of bits that tells how
many samples differ. Candidates rated below the wanted similarity by more than `MARGIN` (six standard
errors) are dropped, all others are confirmed on their full sets.

Components need no pair of a large group twice. Texts of equal sets are one class. In each bucket
every class is first tried against the bucket's smallest class. Pairs within a component found so
far need no test. In a bucket that still holds several components, the classes outside its largest
one are compared with all others, in blocks: pairs that pass the rating are confirmed there, best
rated first and as long as their components are apart, so a task writes fewer links than it has
rows. A pair that meets in several buckets is compared in the smallest.

A pair at the wanted similarity of 0.8 shares no band with probability 5e-8.

Defined results: null or wordless texts have an empty set and link with nothing; fewer words than a
shingle make one shingle of all; each row counts, equal ids or not; component ids are the smallest
non-null id; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import Rolling, Words, by_bytes, mix, prepare, schema, settle, text_key
from veritable.llm.components import components

SAMPLES, ROWS = 128, 4
BITS = 512
MARGIN = 0.25
BLOCK = 1_000
#: Bytes of the sets of a block, about.
CELL_BYTES = 32 << 20
GROUP_BYTES = 2 << 20

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))


def _draws() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64))
    return seeds[:SAMPLES, None] | np.uint64(1), seeds[SAMPLES:, None]


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for group in by_bytes((t or "" for t in texts), lambda t: len(t) + 1, GROUP_BYTES):
        words = Words([t.encode("utf-8", "surrogatepass").translate(_LOWER) for t in group])
        rolling = Rolling(words.hashes)
        shingles = rolling.each(width)
        for a, b in zip(words.first, words.first[1:], strict=False):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield rolling(np.array([a]), np.array([b]))
            else:
                yield np.zeros(0, dtype=np.uint64)


def samples_of(shingles: np.ndarray) -> np.ndarray:
    factors, shifts = _draws()
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            best = np.minimum(best, (shingles[None, at : at + 2048] * factors + shifts).min(axis=1))
    return best


def bands_of(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(-1, ROWS)
    hashes = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        hashes = mix(hashes + np.uint64(0x9E3779B97F4A7C15) ^ rows[:, i])
    return hashes.astype(np.int64)


def odd_sketch(samples: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        bit = mix(samples ^ mix(np.arange(SAMPLES, dtype=np.uint64))) % np.uint64(BITS)
    return np.packbits((np.bincount(bit.astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def rate(differing: np.ndarray) -> np.ndarray:
    """Similarity that goes with a number of differing sketch bits."""
    share = np.minimum(differing / BITS, 0.499)
    flips = -BITS / 2 * np.log(1 - 2 * share)  # two for each differing sample
    return 1 - flips / (2 * SAMPLES)


def set_keys(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, whatever its order."""
    with np.errstate(over="ignore"):
        one = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        two = mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _sign(rows: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(batch.column(2).to_pylist(), width))
            drawn = [samples_of(s) if len(s) else None for s in sets]
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([None if d is None else bands_of(d) for d in drawn], pa.list_(pa.int64())),
                    pa.array([None if d is None else odd_sketch(d) for d in drawn], pa.binary()),
                ],
                ["id", "text_key", "n", "one", "two", "bands", "sketch"],
            )

    more = "text_key binary, n long, one long, two long, bands array<long>, sketch binary"
    return rows.mapInArrow(run, schema(rows, [("id", "id")], more))


def _sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, set) of the classes in `wanted`, from one text of each."""
    asked = classes.join(wanted, "class").select("class", "some_key")
    texts = rows.join(asked, F.col("text_key") == F.col("some_key")).select("class", "text")

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["class", "set"])

    return texts.dropDuplicates(["class"]).mapInArrow(run, "class long, set binary")


def _rated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches allow the wanted similarity."""
    sketches = classes.select("class", "sketch")
    joined = pairs.join(sketches.toDF("a", "sketch_a"), "a").join(sketches.toDF("b", "sketch_b"), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BITS // 8) for i in (2, 3))
            near = rate(np.bitwise_count(x ^ y).sum(axis=1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    return joined.select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _across(least: float, percent: int):
    """Confirmed links between components, of a bucket's outer classes and one block of all."""

    def run(key, table):
        bucket = key[0].as_py()
        classes, roots = table["class"].to_numpy(), table["root"].to_numpy()
        outer = table["outer"].to_numpy(zero_copy_only=False)
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint64).reshape(len(classes), -1)
        x, y = np.flatnonzero(outer), np.flatnonzero(~outer)
        differing = np.zeros((len(x), len(y)), dtype=np.int32)
        for i in range(sketches.shape[1]):
            differing += np.bitwise_count(sketches[x, None, i] ^ sketches[None, y, i])
        rated = np.where(roots[x, None] != roots[None, y], rate(differing), -1.0)
        one, two = np.nonzero(rated >= least)
        if not len(one):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(-rated[one, two], kind="stable")
        one, two = x[one[order]], y[two[order]]
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64)
        sets = [np.frombuffer(b, np.uint64) for b in table["set"].to_pylist()]
        joined: dict[int, int] = {}

        def top(root: int) -> int:
            while root in joined:
                root = joined[root]
            return root

        links = []
        for i, j in zip(one.tolist(), two.tolist(), strict=True):
            r, t = top(int(roots[i])), top(int(roots[j]))
            if r == t or bands[i][bands[i] == bands[j]].min() != bucket:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                joined[r] = t
                links.append((int(classes[i]), int(classes[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _open_cells(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, dealt to cells (outer block, block)."""
    placed = members.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("n").alias("held"))
    largest = F.struct("count", "root")
    shape = counts.groupBy("bucket").agg(
        F.max_by("root", largest).alias("main"),
        F.count("*").alias("kinds"),
        F.sum("held").alias("all_shingles"),
        (F.sum("held") - F.max_by("held", largest)).alias("outer_shingles"),
        (F.sum("count") - F.max("count")).alias("outer_size"),
    )
    open_ = placed.join(shape.filter("kinds > 1"), "bucket")

    def cells_for(size: str, shingles: str) -> Column:
        """Blocks of about BLOCK classes and CELL_BYTES of sets, 8 bytes a shingle."""
        return F.ceil(F.greatest(F.col(size) / BLOCK, F.col(shingles) * 8 / CELL_BYTES))

    blocks, outer_blocks = cells_for("size", "all_shingles"), cells_for("outer_size", "outer_shingles")
    spread = F.xxhash64("class")
    all_ = open_.select(
        "bucket",
        F.explode(F.sequence(F.lit(0), (outer_blocks - 1).cast("int"))).alias("i"),
        F.pmod(spread, blocks).cast("int").alias("j"),
        F.lit(False).alias("outer"),
        "class",
        "root",
    )
    outer = open_.filter("root <> main").select(
        "bucket",
        F.pmod(spread, outer_blocks).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("j"),
        F.lit(True).alias("outer"),
        "class",
        "root",
    )
    return all_.union(outer)


def group(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, text_key, n_shingles, component_id, kept and `group`, a number for the component
    (null without words)."""
    prepare(docs.sparkSession)
    least = percent / 100 - MARGIN
    rows = docs.select(
        docs[id_column].alias("id"), text_key(docs[text_column]).alias("text_key"), docs[text_column].alias("text")
    )
    signed = settle(_sign(rows, width), "signed")
    classes = settle(
        signed.filter("n > 0")
        .groupBy("one", "two")
        .agg(
            F.min("id").alias("first"),
            F.min("text_key").alias("some_key"),
            F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
            F.any_value("n").alias("n"),
        )
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    entries = classes.select("class", "n", F.explode("bands").alias("bucket"))
    buckets = settle(
        entries.groupBy("bucket").agg(F.min("class").alias("head"), F.count("*").alias("size")).filter("size > 1"), "buckets"
    )
    members = settle(entries.join(buckets, "bucket"), "members")

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        return settle(_confirmed(pairs, settle(_sets_of(rows, classes, wanted, width), "sets"), percent), "links")

    stars = members.filter("class <> head").select(F.col("head").alias("a"), F.col("class").alias("b")).distinct()
    tried = settle(_rated(stars, classes, least), "tried")
    links = confirm(tried)
    roots = components(links)
    cells = settle(_open_cells(members, roots), "cells")
    if not cells.isEmpty():
        sets = settle(_sets_of(rows, classes, cells.select("class").distinct(), width), "sets")
        known = classes.select("class", "sketch", "bands").join(sets, "class")
        across = cells.join(known, "class").select("bucket", "i", "j", "outer", "class", "root", "sketch", "bands", "set")
        found = across.groupBy("bucket", "i", "j").applyInArrow(_across(least, percent), "a long, b long")
        roots = components(links.union(settle(found, "across")))

    placed = classes.join(roots, F.col("class") == F.col("node"), "left").select(
        "one", "two", "first", F.coalesce("root", "class").alias("root")
    )
    ids = placed.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    facts = placed.join(ids, F.col("root") == F.col("r")).select("one", "two", "root", "least")
    component = F.coalesce("least", "id")
    known = signed.select("id", "text_key", "n", "one", "two")
    return known.join(facts, ["one", "two"], "left").select(
        F.col("id").alias(id_column),
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
        F.when(F.col("n") > 0, F.col("root")).alias("group"),
    )
