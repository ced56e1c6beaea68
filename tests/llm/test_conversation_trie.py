"""The trie against dictionaries of prefixes, its parentheses against a stack."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string, n long, path string, shard int"


def brute(rows, family=20, starts=4):
    told = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            told.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(turns)] for c, turns in told.items()}
    built = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % starts
        head = c - (abs(c) % family) * (1 if c >= 0 else -1)
        built[c] = (*told.get(head, [])[:h], *turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    saved = {p: (len(m) - 1) * len(p[-1][1].split()) if p else 0 for p, m in nodes.items()}
    out = []
    for p, members in nodes.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = sum(len(below[q]) == 1 for q in below[p])
        ends = ",".join(map(str, sorted(c for c in members if len(built[c]) == len(p))))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(children), leaves,
            sum(saved[q] for q in below[p]), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def run(spark, rows, turns_per_shard):
    full = [(*r, 1, "x", 2) for r in rows]
    turns = ct.numbered(spark.createDataFrame(full, SCHEMA))
    got = ct.trie(ct.rebuilt_paths(turns), turns_per_shard)
    return sorted((tuple(r) for r in got.select(*ct.RESULT).collect()), key=repr)


def conversations(n, seed):
    rng = random.Random(seed)
    said = ["a b", "c", "", None, "d\te  f", "Ü ü", "a  b"]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.35:  # a third are the same conversation
            turns = [("user", "a b"), ("assistant", "c"), ("user", "d\te  f"), ("assistant", "end")]
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(said)) for _ in range(rng.randint(1, 7))]
        for t, (role, text) in enumerate(turns):
            rows.append((i - 30, t if rng.random() < 0.9 else None, role, text))
    rows += [(None, 0, "user", "x"), (5000, 1, "user", "x"), (5000, 1, "user", "x"), (5000, 1, "user", "w")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns_per_shard", [1_000_000, 200, 40])
def test_same_as_brute_force_over_shards(spark, turns_per_shard):
    rows = conversations(160, turns_per_shard)
    assert run(spark, rows, turns_per_shard) == brute(rows)


def test_one_conversation_and_none(spark):
    rows = [(3, 0, "user", "a b c")]
    assert run(spark, rows, 1000) == brute(rows)
    assert run(spark, [], 1000) == []
    assert run(spark, [(None, 0, "user", "a")], 1000) == []


def test_long_and_equal_conversations(spark):
    long = [(t, "user", f"turn {t} " + "x " * (t % 3)) for t in range(3000)]
    rows = [(c, *t) for c in (40, 41) for t in long] + [(60, 0, "user", "word " * 200_000)]
    got = {(r[0], r[1]): r for r in run(spark, rows, 1000)}
    assert len(got) >= 3000 and got[(40, 3000)][3] >= 1
    assert max(r[1] for r in got.values()) == 3000
    root = got[(40, 0)]
    assert root[3] == 3 and root[2] is None


def test_equal_conversations_spread_over_shards(spark):
    rows = [(c * 20, t, "user", f"w{t}") for c in range(300) for t in range(3)]
    turns = ct.numbered(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA))
    nodes, shards = ct.shard_nodes(ct.rebuilt_paths(turns), 100)
    assert shards == 12
    assert nodes.filter("n_convs > 100").count() == 0 and nodes.select("shard").distinct().count() > 6
    assert run(spark, rows, 100) == [
        (0, 0, None, 300, 1, 1, 897, hashlib.sha256(b"").hexdigest()),
        (0, 1, 0, 300, 1, 1, 897, hashlib.sha256(b"").hexdigest()),
        (0, 2, 0, 300, 1, 1, 598, hashlib.sha256(b"").hexdigest()),
        (0, 3, 0, 300, 0, 1, 299, hashlib.sha256(",".join(str(c * 20) for c in range(300)).encode()).hexdigest()),
    ]


def test_findclose_against_a_stack():
    rng = np.random.default_rng(1)
    for size in (1, 2, 40, 300, 5000):
        bits, open_ = [], 0
        left = size
        while left or open_:
            if left and (not open_ or rng.random() < (0.8 if size == 5000 and left > 2500 else 0.5)):
                bits.append(True)
                open_, left = open_ + 1, left - 1
            else:
                bits.append(False)
                open_ -= 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        at = np.flatnonzero(bits)
        assert ct.Parentheses(np.array(bits)).findclose(at).tolist() == [close[i] for i in at.tolist()]


def test_turns_are_not_gathered_with_their_texts(spark):
    turns = ct.numbered(spark.createDataFrame([(1, 0, "user", "x", 1, "p", 2)], SCHEMA))
    assert turns.columns == ["conv_id", "n", "said", "words"]
    assert turns.select(F.max(F.length("said"))).first()[0] == 32
