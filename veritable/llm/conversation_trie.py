"""Prefix trie of conversations in balanced parentheses, shard by shard.

A conversation is a path of turns; a turn is 128 bits of its role and text. Paths are sorted and
dealt to shards by ranges of (path, conversation), so a prefix' members follow one another and equal
conversations, however many, spread over shards. A shard writes its trie in preorder as balanced
parentheses. Blocks of excess minima under a tree of minima find the closing parenthesis of each
node, which delimits its subtree; ranks of `()` count the leaves, and cumulative sums of ends, turns
and words give members and savings. What two shards share lies on the first and last path of each:
these spines are merged by their prefix, and what they count twice is taken off along the shards.

Handling: a null role or text is empty; turns come in order, null first, equal ones by role, then
text; rows without a conversation id belong to none and are left out; repeated turns are turns.
Without conversations there is no node. A conversation without turns is a member of the root alone.
Texts of any length are hashed where they are read and never gathered; a conversation's path is one
row of some 24 bytes a turn. Other columns are not read.

The digest of the ends of a prefix that spans shards reads them in order, piece by piece, in one
task, as SHA-256 cannot be split; it keeps one piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import words, write

TURNS_PER_SHARD = 250_000
DIGEST = 16  # bytes of a turn in a path

_NODES = """shard int, node int, parent int, depth long, conv_id long, parent_conv_id long, n_convs long,
    n_children long, n_leaves long, gross long, distinct long, words long, key binary, parent_key binary,
    ends string, ends_sha256 string"""


# ------------------------------------------------------------------------- one shard


class Parentheses:
    """Balanced parentheses (True opens) with minima of excess: of blocks, then of pairs of these."""

    BLOCK = 64

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        blocks = max(-(-len(opens) // self.BLOCK), 1)
        self.leaves = 1 << (blocks - 1).bit_length()
        excess = np.full(blocks * self.BLOCK, np.iinfo(np.int32).max, dtype=np.int32)
        excess[: len(opens)] = np.cumsum(np.where(opens, 1, -1))
        self.excess = excess.reshape(blocks, self.BLOCK)
        self.least = np.full(2 * self.leaves, np.iinfo(np.int32).max, dtype=np.int32)
        self.least[self.leaves : self.leaves + blocks] = self.excess.min(axis=1)
        size = self.leaves
        while size > 1:
            row = self.least[size : 2 * size]
            self.least[size // 2 : size] = np.minimum(row[::2], row[1::2])
            size //= 2

    def _inside(self, block: np.ndarray, after: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place of a block behind `after` whose excess is not above the target, or -1."""
        found = np.empty(len(block), dtype=np.int64)
        place = np.arange(self.BLOCK)
        for i in range(0, len(block), 1 << 14):
            part = slice(i, i + (1 << 14))
            base = block[part, None] * self.BLOCK
            hit = (self.excess[block[part]] <= target[part, None]) & (base + place > after[part, None])
            found[part] = np.where(hit.any(axis=1), base[:, 0] + hit.argmax(axis=1), -1)
        return found

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one."""
        target = self.excess.reshape(-1)[at] - 1
        found = self._inside(at // self.BLOCK, at, target)
        far = np.flatnonzero(found < 0)
        node, goal = at[far] // self.BLOCK + self.leaves, target[far]
        climbing = np.arange(len(far))
        while len(climbing):
            here = node[climbing]
            right = (here % 2 == 0) & (self.least[np.minimum(here + 1, len(self.least) - 1)] <= goal[climbing])
            node[climbing] = np.where(right, here + 1, here // 2)
            climbing = climbing[~right]
        while (node < self.leaves).any():
            inner = np.flatnonzero(node < self.leaves)
            left = 2 * node[inner]
            node[inner] = np.where(self.least[left] <= goal[inner], left, left + 1)
        found[far] = self._inside(node - self.leaves, at[far], goal)
        return found


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of values[lo:hi] for each pair, lo < hi."""
    out = np.empty(len(lo), dtype=values.dtype)
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # 2 ** level <= width
    row, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        mine = np.flatnonzero(level == k)
        out[mine] = np.minimum(row[lo[mine]], row[hi[mine] - width])
        row, width = np.minimum(row[:-width], row[width:]), 2 * width
    return out


def _common(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each path and the one before it; 0 for the first."""
    shared = np.zeros(len(sizes), dtype=np.int64)
    most = np.minimum(sizes[1:], sizes[:-1])
    owner = np.repeat(np.arange(len(most)), most)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most)
    differ = (symbols[starts[:-1][owner] + step] != symbols[starts[1:][owner] + step]).any(axis=1)
    shared[1:] = most
    first = np.flatnonzero(differ)[::-1]  # the last write of a pair is its first difference
    shared[1:][owner[first]] = step[first]
    return shared


class Shard:
    """The trie of sorted paths: arrays over its nodes in preorder, the root first."""

    def __init__(self, paths: list[bytes], counts: np.ndarray, ids: np.ndarray):
        """`counts`: words of all turns of all paths, one after the other."""
        sizes = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        symbols = np.frombuffer(b"".join(paths), dtype=np.uint64).reshape(-1, 2)
        shared = _common(symbols, starts, sizes)
        new = sizes - shared
        owner = np.repeat(np.arange(len(sizes)), new)
        deep = np.arange(len(owner)) - np.repeat(np.cumsum(new) - new, new) + shared[owner]
        self.depth = np.concatenate([[0], deep + 1])
        self.words = np.concatenate([[0], counts[starts[owner] + deep]]).astype(np.int64)
        n = len(self.depth)

        closed = np.concatenate([[0], sizes[:-1]]) - shared
        runs = np.concatenate([[1], np.column_stack([closed, new]).reshape(-1), [sizes[-1] + 1]])
        signs = np.concatenate([[True], np.tile([False, True], len(sizes)), [False]])
        bits = np.repeat(signs, runs)
        at = np.flatnonzero(bits)
        close = Parentheses(bits).findclose(at)
        upto = np.cumsum(bits)[close]  # rank of the close: nodes up to the end of the subtree

        self.ends_at = np.cumsum(new)  # the node that each path ends at
        lo = np.searchsorted(self.ends_at, np.arange(n), "left")
        hi = np.searchsorted(self.ends_at, upto - 1, "right")
        self.ids, self.own = ids, np.searchsorted(self.ends_at, np.arange(n), "right")
        self.lo, self.n_convs = lo, hi - lo
        self.least = _range_minima(ids, lo, hi)

        order = np.sort(self.depth * n + np.arange(n))
        before = np.searchsorted(order, (self.depth - 1) * n + np.arange(n)) - 1
        self.parent = order[np.maximum(before, 0)] % n
        self.parent[0] = -1
        self.n_children = np.bincount(self.parent[1:], minlength=n)
        self.n_leaves = self.subtree(~bits[at + 1], upto)
        self.gross = self.subtree(self.n_convs * self.words, upto)
        self.distinct = self.subtree(self.words, upto)

        last, node = [], int(self.ends_at[-1])
        while node >= 0:
            last.append(node)
            node = int(self.parent[node])
        self.spines = [(list(range(int(sizes[0]) + 1)), paths[0]), (last[::-1], paths[-1])]

    @staticmethod
    def subtree(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[upto] - sums[np.arange(len(upto))]

    def keys(self) -> dict[int, bytes]:
        """A key of the prefix of each node on the first and the last path."""
        found = {}
        for nodes, path in self.spines:
            state = hashlib.md5()
            for depth, node in enumerate(nodes):
                state.update(path[(depth - 1) * DIGEST : depth * DIGEST] if depth else b"")
                found[node] = state.copy().digest()
        return found

    def ends(self, node: int) -> str:
        """Decimal ids of the paths that end at a node, joined by commas."""
        return ",".join(map(str, self.ids[self.lo[node] : self.own[node]].tolist()))


def _shard_rows(shard: int, paths: list[bytes], counts: np.ndarray, ids: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    trie = Shard(paths, counts, ids)
    keys, nothing = trie.keys(), hashlib.sha256(b"").hexdigest()
    for start in range(0, len(trie.depth), 1 << 16):
        nodes = np.arange(start, min(start + (1 << 16), len(trie.depth)))
        parents = trie.parent[nodes]
        own = trie.own[nodes] > trie.lo[nodes]
        key = [keys.get(i) for i in nodes.tolist()]
        upper = [keys.get(i) for i in parents.tolist()]
        ends = [trie.ends(i) if some else "" for i, some in zip(nodes.tolist(), own.tolist(), strict=True)]
        digests = [None if k else hashlib.sha256(e.encode()).hexdigest() if e else nothing for k, e in zip(key, ends, strict=True)]
        local = np.array([u is None and p >= 0 for u, p in zip(upper, parents.tolist(), strict=True)])
        columns = [
            pa.array(np.full(len(nodes), shard, dtype=np.int32)),
            pa.array(nodes.astype(np.int32)),
            pa.array(parents.astype(np.int32), mask=local | (parents < 0)),
            pa.array(trie.depth[nodes]),
            pa.array(trie.least[nodes]),
            pa.array(trie.least[np.maximum(parents, 0)], mask=~local),
            *(pa.array(x[nodes].astype(np.int64)) for x in (trie.n_convs, trie.n_children, trie.n_leaves, trie.gross, trie.distinct, trie.words)),
            pa.array(key, pa.binary()),
            pa.array([u if k else None for u, k in zip(upper, key, strict=True)], pa.binary()),
            pa.array([e if k else None for k, e in zip(key, ends, strict=True)], pa.string()),
            pa.array(digests, pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names)


# ------------------------------------------------------------------------- all shards


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, n, said, words): the turns of each conversation from 1, each as hex digits of 128 bits."""
    said_by, said = F.coalesce(turns[role].cast("string"), F.lit("")), F.coalesce(turns[text].cast("string"), F.lit(""))
    rows = turns.filter(turns[conv].isNotNull()).select(
        turns[conv].cast("long").alias("conv_id"),
        turns[turn].alias("turn"),
        said_by.alias("role"),
        said.alias("text"),
        F.md5(F.concat(F.length(said_by).cast("string"), F.lit(":"), said_by, said).cast("binary")).alias("said"),
        F.size(words(said)).alias("words"),
    )
    line = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", F.row_number().over(line).alias("n"), "said", "words")


def _path(conv_id: Column, turns: Column) -> list[Column]:
    """Columns of a path from an array of (said, words)."""
    whole = F.unhex(F.array_join(F.transform(turns, lambda t: t["said"]), ""))
    return [conv_id.alias("conv_id"), whole.alias("path"), F.transform(turns, lambda t: t["words"]).alias("words")]


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, path, words) of conversations as they are, from numbered()."""
    told = F.array_sort(F.collect_list(F.struct("n", "said", "words")))
    return turns.groupBy("conv_id").agg(told.alias("t")).select(*_path(F.col("conv_id"), F.col("t")))


def rebuilt_paths(turns: DataFrame, family: int = 20, starts: int = 4) -> DataFrame:
    """(conv_id, path, words) of conversations that start as the first of their family does.

    A conversation c takes the first h turns of c - c % family (what there is of them), then its own
    after its first h; h = crc32 of c's decimal form modulo `starts`.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % starts).cast("int")
    told = F.struct("n", "said", "words")
    grouped = turns.withColumn("h", h).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") > F.col("h"), told))).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("n") < starts, told))).alias("first"),
    )
    grouped, _ = write(grouped, "conversations")
    heads = grouped.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("head"), F.col("first").alias("given"))
    joined = grouped.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head"), "left")
    given = F.slice(F.coalesce("given", F.array().cast(grouped.schema["own"].dataType)), F.lit(1), h)
    return joined.select(*_path(F.col("conv_id"), F.concat(given, "own")))


def shard_nodes(paths: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> tuple[DataFrame, int]:
    """The nodes of every shard, written, and the number of shards."""
    rows, _ = write(paths, "paths")
    size = rows.agg(F.sum(F.size("words") + 1).alias("n")).first()["n"] or 0
    shards = max(-(-size // turns_per_shard), 1)
    names = [c.split()[0] for c in _NODES.split(",")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids, counts, shard = [], [], [], 0
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                path += batch.column("path").to_pylist()
                ids.append(batch.column("conv_id").to_numpy())
                counts.append(batch.column("words").flatten().to_numpy())
        if path:
            yield from _shard_rows(shard, path, np.concatenate(counts), np.concatenate(ids), names)

    # Two conversations never share both keys, so equal paths can be cut anywhere.
    dealt = rows.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    dealt = dealt.select("path", "conv_id", "words", F.spark_partition_id().alias("shard"))
    return write(dealt.mapInArrow(build, _NODES), "nodes")[0], shards


def _digests(spine: DataFrame) -> DataFrame:
    """(key, ends_sha256) of pieces of ends that follow one another by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for k, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(key, state.hexdigest())])

    def _pairs(done: list) -> pa.RecordBatch:
        keys, digests = [k for k, _ in done], [d for _, d in done]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])

    pieces = spine.filter("ends <> ''").select("key", "shard", "ends")
    return pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(run, "key binary, ends_sha256 string")


def _merge(spine: DataFrame, shards: int) -> DataFrame:
    """One row per prefix on a spine, with counts over all shards."""
    spark = spine.sparkSession
    merged, _ = write(
        spine.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"),
            F.max("depth").alias("depth"),
            F.max("parent_key").alias("parent_key"),
            F.max("words").alias("words"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "gross", "distinct")],
            F.sum((F.col("n_children") == 0).cast("long")).alias("childless"),
            F.count("*").alias("k"),
            F.min("shard").alias("first_shard"),
            F.max("shard").alias("last_shard"),
        ),
        "spines",
    )
    # What a prefix in k shards adds too much to all prefixes above it: words k - 1 times, and leaves.
    many = merged.filter("k > 1").select(
        "key",
        "parent_key",
        "first_shard",
        "last_shard",
        "depth",
        (F.col("k") - 1).alias("more"),
        ((F.col("k") - 1) * F.col("words")).alias("more_words"),
        (F.col("childless") - (F.col("n_children") == 0).cast("long")).alias("more_leaves"),
    )
    sums = ["more_words", "more_leaves"]
    # Prefixes that are first met in one shard and reach the next lie on its last path. In the order of
    # (first shard, depth) a subtree is an interval: from its top to the last one met before its last shard.
    above = Window.partitionBy("first_shard").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    per_shard = many.groupBy(F.col("first_shard").alias("at")).agg(*[F.sum(c).alias(c) for c in sums])
    line = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = spark.range(shards).select(F.col("id").cast("int").alias("at")).join(per_shard, "at", "left")
    upto, _ = write(
        every.select("at", *[F.sum(F.coalesce(c, F.lit(0))).over(line).alias(c) for c in sums]), "upto"
    )  # one row per shard
    start = upto.select((F.col("at") + 1).alias("first_shard"), *[F.col(c).alias(f"start_{c}") for c in sums])
    end = upto.select((F.col("at") + 1).alias("last_shard"), *[F.col(c).alias(f"end_{c}") for c in sums])
    placed = many.select("*", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in sums])
    placed = placed.join(start, "first_shard", "left").join(end, "last_shard", "left")
    within = placed.select(
        "key",
        *[
            (F.col(f"end_{c}") - F.coalesce(f"start_{c}", F.lit(0)) - F.col(f"above_{c}")).alias(c)
            for c in sums
        ],
    )
    children = many.groupBy(F.col("parent_key").alias("key")).agg(F.sum("more").alias("more_children"))
    full = merged.join(within, "key", "left").join(children, "key", "left").join(_digests(spine), "key", "left")
    more = {c: F.coalesce(c, F.lit(0)) for c in (*sums, "more_children")}
    return full.select(
        "key",
        "parent_key",
        "conv_id",
        "depth",
        "n_convs",
        (F.col("n_children") - more["more_children"]).alias("n_children"),
        (F.col("n_leaves") - more["more_leaves"]).alias("n_leaves"),
        (F.col("gross") - F.col("distinct") + more["more_words"]).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(paths: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """One row per distinct prefix of the paths (conv_id, path, words), from the root of depth 0.

    conv_id is the smallest member, parent_conv_id the parent's; saved_tokens are the words that members
    after the first need not be read for, over the whole subtree; ends_sha256 is of the members that end here.
    """
    nodes, shards = shard_nodes(paths, turns_per_shard)
    spine = nodes.filter("key IS NOT NULL")
    merged, _ = write(_merge(spine, shards), "merged")
    # The parent of a node beside a spine is found by its place in the shard, which no hot key crowds.
    places = spine.select("shard", F.col("node").alias("parent"), "key")
    known = places.join(merged.select("key", F.col("conv_id").alias("upper")), "key").drop("key")
    inner = nodes.filter("key IS NULL").withColumn("saved_tokens", F.col("gross") - F.col("distinct"))
    beside = inner.filter("parent IS NOT NULL").drop("parent_conv_id").join(known, ["shard", "parent"])
    top = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return (
        inner.filter("parent IS NULL")
        .select(*RESULT)
        .unionByName(beside.withColumnRenamed("upper", "parent_conv_id").select(*RESULT))
        .unionByName(merged.join(top, "parent_key", "left").select(*RESULT))
    )
