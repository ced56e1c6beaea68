import numpy as np
import pytest

from veritable.llm import spherical_caps
from veritable.llm.components import components


def brute(rows, cosine=0.9):
    good = [
        (i, np.array(v, dtype=float) / max(map(abs, v))) if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else (i, None)
        for i, v in rows
    ]
    n = len(good)
    link = np.zeros((n, n), dtype=bool)
    for a in range(n):
        for b in range(n):
            x, y = good[a][1], good[b][1]
            if a != b and x is not None and y is not None and len(x) == len(y):
                link[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            root[a] = min([root[a], *(root[b] for b in np.flatnonzero(link[a]))])
    least = {r: min((good[a][0] for a in range(n) if root[a] == r and good[a][0] is not None), default=None) for r in root}
    return sorted(((good[a][0], int(link[a].sum()), least[root[a]], good[a][0] is not None and good[a][0] == least[root[a]]) for a in range(n)), key=repr)


def test_links(spark, monkeypatch):
    monkeypatch.setattr(spherical_caps, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for group in range(12):
        centre = rng.normal(size=16)
        for _ in range(40 if group == 0 else rng.integers(1, 8)):
            rows.append((len(rows) * 3 % 1009, [float(x) for x in centre + rng.normal(size=16) * rng.choice([0.05, 0.3])]))
    rows += [(rows[0][0] + 5000, rows[0][1]), (rows[0][0], rows[0][1]), (7001, [0.0] * 16), (7002, None), (7003, [])]
    rows += [(7004, [float("nan")] + [1.0] * 15), (7005, [None] + [1.0] * 15), (None, rows[5][1]), (None, [1.0, 2.0])]
    rows += [(7006, [1.0, 2.0]), (7007, [1e200, 2e200]), (7008, [float("inf"), 1.0]), (7009, [3.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, class string")
    got = sorted(map(tuple, spherical_caps.link(df.repartition(5)).collect()), key=repr)
    assert got == brute(rows)
    assert spherical_caps.link(df.limit(0)).count() == 0


def test_one_cluster_over_many_blocks(spark, monkeypatch):
    """Near-equal vectors share all their filters; every pair counts once, in one cell, chunk by chunk."""
    monkeypatch.setattr(spherical_caps, "BLOCK", 100)
    monkeypatch.setattr(spherical_caps, "CHUNK", 3)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.02]) for i in range(600)]
    got = spherical_caps.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect()
    assert len(got) == 600 and all(r.n_links == 599 and r.component_id == 0 for r in got)


def test_code_lists_all_that_exceed():
    code = spherical_caps.Code(12, 1.5, 9, 3)
    x = np.random.default_rng(2).normal(size=(50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = code.filters(x)
    for table, (turn, codes) in enumerate(code.tables):
        words = np.array([np.concatenate([codes[0][i], codes[1][j]]) for i in range(9) for j in range(9)])
        assert np.allclose(np.linalg.norm(words, axis=1), 1)
        for row, own in zip(x, found, strict=True):
            sums = words @ (row @ turn)
            mine = own[own // code.size == table] % code.size
            want = np.flatnonzero(sums >= code.alpha)
            assert mine.tolist() == (want if len(want) >= 3 else np.sort(np.argsort(-sums)[:3])).tolist()


def at_the_threshold(rng, n, length):
    x, y = rng.normal(size=(2, n, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1)[:, None] * x
    return x, 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)


@pytest.mark.parametrize(("length", "vectors", "pairs"), [(16, 100, 3000), (64, 10_000, 3000), (64, 1_000_000, 30_000), (64, 10_000_000, 30_000)])
def test_recall_at_the_threshold(length, vectors, pairs):
    """Chances are 1 in 10 000 to miss a pair: 30 000 pairs tell that from 4 in 10 000."""
    rng = np.random.default_rng(vectors)
    code = spherical_caps.Code(length, **spherical_caps.plan(vectors, 0.9))
    x, y = at_the_threshold(rng, pairs, length)
    missed = 0
    for i in range(0, pairs, 1000):
        both = zip(code.filters(x[i : i + 1000]), code.filters(y[i : i + 1000]), strict=True)
        missed += sum(not np.intersect1d(a, b, assume_unique=True).size for a, b in both)
    assert missed <= 3e-4 * pairs


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (300, 299)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    want = {i: 0 for i in range(1, 61)} | {200 + i: 100 for i in range(50)} | {300: 299}
    assert got == want
