import random
from collections import Counter

import numpy as np
import pytest

from veritable.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def expected(sizes, weights=(5, 2, 1), share=1.5):
    """Targets by resharing the excess until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= above


def rows(seed):
    rng = random.Random(seed)
    out = [(i, "w " * int(rng.paretovariate(0.8) % 400), f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}", "x", None) for i in range(600)]
    return [*out, (1, "w w", "s0", None, None), (1, "w w", "s0", None, None), (None, "a b c", None, None, None), (7000, None, "s1", None, None), (7001, "", "empty", None, None)]


@pytest.mark.parametrize(("seed", "class_rows"), [(1, 50_000), (2, 5)])
def test_mix(spark, monkeypatch, seed, class_rows):
    monkeypatch.setattr(mixing, "CLASS_ROWS", class_rows)
    data = rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df.repartition(5)).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, len((t or "").split()), s) for i, t, s, *_ in data)
    sizes = Counter()
    for _, text, source, *_ in data:
        sizes[source] += len((text or "").split())
    want = expected(sizes)
    taken = Counter()
    for r in got:
        assert r.taken in (0, r["size"], 2 * r["size"]) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    for source, target in want.items():
        largest = max(len((t or "").split()) for _, t, s, *_ in data if s == source)
        assert abs(taken[source] - target) <= max(5, 0.02 * target) or len([1 for d in data if d[2] == source]) < 5, (source, taken[source], target, largest)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(2)).collect()))


def test_rates_are_tilted(spark):
    """Rates meet the constraint and their log odds are linear in size, which is what the dual asks for."""
    df = spark.createDataFrame(rows(3), SCHEMA)
    by_source = {}
    for r in mixing.mix(df).collect():
        by_source.setdefault(r.source, []).append((r["size"], r.rate, r.target, r.source_size))
    for found in by_source.values():
        size, rate, target, whole = (np.array(x, dtype=float) for x in zip(*found, strict=True))
        assert abs((size * rate).sum() - target[0]) <= 0.02 + 1e-6 * target[0]
        use = (size > 0) & (rate > 1e-6) & (rate < 2 - 1e-6)
        if target[0] < 2 * whole[0] and use.sum() > 2:
            odds = np.log(rate[use] / (2 - rate[use])) / size[use]
            assert np.ptp(odds) < 1e-3 * np.abs(odds).max() + 1e-9


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
