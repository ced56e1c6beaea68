import random
import re

import numpy as np

from veritable.llm import minhash


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    n = len(rows)
    root = list(range(n))
    near = [(a, b) for a in range(n) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in range(n):
        before = list(root)
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    least = {r: min((rows[a][0] for a in range(n) if root[a] == r and rows[a][0] is not None), default=None) for r in root}
    return sorted(((rows[a][0], len(sets[a]), least[root[a]], rows[a][0] is not None and rows[a][0] == least[root[a]]) for a in range(n)), key=repr)


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgé", k=4))
    rows = []
    for group in range(25):
        base = [word() for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(60 if group == 0 else rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    chain = [word() for _ in range(400)]
    rows += [(3000 + i, "\n".join(chain[6 * i : 6 * i + 90])) for i in range(40)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "A b"), (4004, "a B"), (4005, "a b c d"), (None, "A b"), (None, "lone words here")]
    rows += [rows[0], (rows[1][0], rows[2][1]), (4006, "x" * 100_000), (4007, "A B C D"), (4008, "É b"), (4009, "é b")]
    rng.shuffle(rows)
    return rows


def test_groups(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(5)
    for width, block, cell in ((4, 1000, 1 << 25), (5, 9, 1 << 25), (4, 1000, 3000)):  # cells cut by rows or by bytes
        monkeypatch.setattr(minhash, "BLOCK", block)
        monkeypatch.setattr(minhash, "CELL_BYTES", cell)
        got = minhash.group(df, width, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=repr) == brute(rows, width, 80)
    assert minhash.group(df.limit(0)).count() == 0


def test_sketch_rates_similarity():
    rng = np.random.default_rng(4)
    for wanted in (0.6, 0.8, 0.95):
        seen = []
        for _ in range(30):
            shared, own = int(1000 * wanted), int(500 * (1 - wanted))
            x = rng.integers(0, 2**63, shared + 2 * own, dtype=np.uint64)
            one, two = (minhash.odd_sketch(minhash.samples_of(s)) for s in (x[: shared + own], np.concatenate([x[:shared], x[shared + own :]])))
            differing = np.bitwise_count(np.frombuffer(one, np.uint8) ^ np.frombuffer(two, np.uint8)).sum()
            seen.append(minhash.rate(differing))
        assert abs(np.mean(seen) - shared / (shared + 2 * own)) < 0.04
