"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; a vector is in all filters whose cap it lies in (inner product at least
`alpha`). Directions are a random product code: after a random rotation the dimensions are cut into
`BLOCKS` blocks, each with a small code of random unit vectors, and a direction picks one word per
block. So the filters of a vector are listed block by block, dropping beginnings that cannot reach
alpha any more, without looking at all directions. Vectors that share a filter are compared exactly.
`TABLES` codes under independent rotations share the work, so that no rotation is bad for a pair.

The number of vectors sets the cap (about `BUCKET` vectors to a filter) and the chance to meet in a
cap sets how many filters a vector needs, for a chance of `MISS` to overlook a pair at the threshold.
A vector that few caps reach takes its nearest directions instead, as many as the plan wants.
A pair counts in the smallest filter it shares, so every link counts once and no pair is written.

Equal vectors are one class and are compared once. Filters with more than `BLOCK` vectors are cut
into blocks, and each pair of blocks is a group of its own, so that no group outgrows a task.

Defined results: null, empty or zero vectors and those with null or non-finite components link with
nothing; vectors of different length never link; each row counts as a vector, equal ids or not;
component ids are the smallest non-null id; rows without an id are not kept; an empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import prepare, settle
from veritable.llm.components import components

BLOCKS = 2
BUCKET = 256
BLOCK = 1_000
MISS = 1e-4
SLACK = 1.35
#: Filters whose members are compared at once.
CHUNK = 2048
TABLES = 4
SEED = 20_26


def meeting_chance(reach: float, cosine: float) -> float:
    """P(z2 >= reach | z1 >= reach) of normal variables with this correlation."""
    z = np.linspace(reach, reach + 6, 2001)
    weight = np.exp(-z * z / 2)
    tail = 1 - np.vectorize(NormalDist().cdf)((reach - cosine * z) / math.sqrt(1 - cosine * cosine))
    return float((weight * tail).sum() / weight.sum())


def plan(vectors: int, cosine: float) -> dict:
    """Reach of the caps in standard deviations, words per block of a code, filters per vector."""
    share = min(0.1, BUCKET / max(vectors, 1))
    reach = NormalDist().inv_cdf(1 - share)
    # Filters of a product code share words, so they meet less independently than this chance says:
    # 13 of 30 000 pairs at the threshold were missed without SLACK among a million vectors, 27 among ten.
    wanted = math.ceil(SLACK * math.log(1 / MISS) / meeting_chance(reach, cosine) / TABLES)
    words = max(4, math.ceil((wanted / share) ** (1 / BLOCKS)))
    return {"reach": reach, "words": words, "wanted": wanted}


class Code:
    """The product codes for vectors of one length."""

    def __init__(self, length: int, reach: float, words: int, wanted: int):
        rng = np.random.default_rng([SEED, length])
        self.cuts = np.linspace(0, length, min(BLOCKS, length) + 1).astype(int)
        self.alpha, self.count, self.wanted = reach / math.sqrt(length), words, wanted
        self.size = words ** (len(self.cuts) - 1)  # directions of a table
        self.tables = []
        for _ in range(TABLES):
            turn = np.linalg.qr(rng.normal(size=(length, length)))[0]
            codes = []
            for a, b in zip(self.cuts, self.cuts[1:], strict=False):
                code = rng.normal(size=(words, b - a))
                # Blocks count by their share of the dimensions, so a direction has length 1.
                codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * math.sqrt((b - a) / length))
            self.tables.append((turn, codes))

    def filters(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each row."""
        found: list[list[np.ndarray]] = [[] for _ in unit]
        for table, (turn, codes) in enumerate(self.tables):
            turned = unit @ turn
            sums = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], codes, strict=False)]
            tops = np.stack([s.max(axis=1) for s in sums], axis=1)
            rest = tops[:, ::-1].cumsum(axis=1)[:, ::-1] - tops  # best that later blocks can add
            for i in range(len(unit)):
                found[i].append(table * self.size + self._decode([s[i] for s in sums], rest[i]))
        return [np.concatenate(f) for f in found]

    def _decode(self, sums: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
        alpha = self.alpha
        while True:
            names, values = np.zeros(1, dtype=np.int64), np.zeros(1)
            for block, own in enumerate(sums):
                reached = values[:, None] + own[None, :]
                row, word = np.nonzero(reached >= alpha - rest[block])
                names, values = names[row] * self.count + word, reached[row, word]
            if len(names) >= self.wanted or alpha < -1:
                break
            alpha -= 0.15 * max(abs(alpha), 0.1)
        if alpha < self.alpha:  # few caps reach this far: the nearest directions
            names = names[np.lexsort((names, -values))[: self.wanted]]
        return np.sort(names)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(classes: DataFrame, shape: dict) -> DataFrame:
    """(length, filter, class, copies, unit, filters), a row for each filter of a class."""

    def run(batches):
        codes: dict[int, Code] = {}
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            lengths = np.array([len(v) for v in vectors])
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                code = codes.setdefault(int(length), Code(int(length), **shape))
                unit = _unit([vectors[i] for i in at])
                found = code.filters(unit)
                source = np.repeat(np.arange(len(at)), [len(f) for f in found])
                taken = pa.array(at[source])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(source), length, dtype=np.int32)),
                        pa.array(np.concatenate(found)),
                        batch.column(0).take(taken),
                        batch.column(1).take(taken),
                        pa.array([unit[i].tobytes() for i in source], pa.binary()),
                        pa.array([found[i].tobytes() for i in source], pa.binary()),
                    ],
                    ["length", "filter", "class", "copies", "unit", "filters"],
                )

    kind = "length int, filter long, class long, copies long, unit binary, filters binary"
    return classes.select("class", "copies", "vector").mapInArrow(run, kind)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest place reachable from each place of a boolean link matrix."""
    roots = np.arange(len(linked))
    while True:
        around = np.where(linked, roots[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(roots, around)
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


def _compare(cosine: float):
    def run(key, table):
        number, left, right = key[1].as_py(), key[2].as_py(), key[3].as_py()
        classes = table["class"].to_numpy()
        copies = table["copies"].to_numpy()
        block = table["block"].to_numpy()
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), dtype=np.float64).reshape(len(classes), -1)
        near = unit @ unit.T >= cosine
        np.fill_diagonal(near, False)
        if left != right:  # pairs within a block count where the block meets itself
            near &= block[:, None] != block[None, :]
        # A pair that shares a smaller filter counts there.
        lists = [np.frombuffer(f, dtype=np.int64) for f in table["filters"].to_pylist()]
        below = [f[f < number] for f in lists]
        smaller, times = np.unique(np.concatenate(below), return_counts=True)
        smaller = smaller[times > 1]
        elsewhere = np.zeros(near.shape, dtype=bool)
        for at in range(0, len(smaller), CHUNK):
            part = smaller[at : at + CHUNK]
            member = np.zeros((len(classes), len(part)), dtype=np.float32)
            for i, f in enumerate(below):
                member[i, np.searchsorted(part, f[np.isin(f, part)])] = 1
            elsewhere |= (member @ member.T) > 0
        counted = near & ~elsewhere
        links = (counted * copies[None, :]).sum(axis=1)
        order = np.argsort(classes)
        roots = np.empty(len(classes), dtype=np.int64)
        roots[order] = classes[order][_roots(near[np.ix_(order, order)])]
        use = near.any(axis=1)
        return pa.table({"class": classes[use], "root": roots[use], "links": links[use].astype(np.int64)})

    return run


def link(vectors: DataFrame, cosine: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id and kept."""
    prepare(vectors.sparkSession)
    rows = vectors.select(vectors[id_column].alias("id"), vectors[vector_column].alias("vector"))
    classes = settle(
        rows.filter(usable(F.col("vector")))
        .groupBy("vector")
        .agg(F.min("id").alias("first"), F.count("*").alias("copies"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    listed = settle(_assign(classes, plan(classes.count(), cosine)))
    hot = settle(
        listed.groupBy("length", "filter").count().filter(F.col("count") > BLOCK)
        .select(F.col("length").alias("l"), F.col("filter").alias("f"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    cut = (
        listed.join(hot, (F.col("length") == F.col("l")) & (F.col("filter") == F.col("f")), "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("length", "filter", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "class", "copies", "unit", "filters")
    )
    found = settle(
        cut.groupBy("length", "filter", "one", "two").applyInArrow(_compare(cosine), "class long, root long, links long")
    )
    counts = found.groupBy(F.col("class").alias("c")).agg(F.sum("links").alias("links"))
    roots = components(found.select("class", "root"))
    rooted = settle(
        classes.drop("vector")
        .join(counts, F.col("class") == F.col("c"), "left")
        .join(roots, F.col("class") == F.col("node"), "left")
        .select("class", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    least = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("least"))
    facts = rooted.join(least, F.col("root") == F.col("r")).select(F.col("class").alias("c"), "n_links", "least")
    known = classes.join(facts, F.col("class") == F.col("c")).select(F.col("vector").alias("v"), "n_links", "least")
    component = F.coalesce("least", "id")
    return rows.join(known, F.col("vector") == F.col("v"), "left").select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
