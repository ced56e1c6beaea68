import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritable.llm import common, repeats, seed_extend, suffix_array
from veritable.llm.common import Rolling, leftmost_minima, mix, powers
from veritable.operators import ranges


def brute(symbols, window):
    """Flags of the symbols in repeated windows, per text."""
    seen = Counter(tuple(s[i : i + window]) for s in symbols for i in range(len(s) - window + 1))
    flags = []
    for s in symbols:
        own = [False] * len(s)
        for i in range(len(s) - window + 1):
            if seen[tuple(s[i : i + window])] > 1:
                own[i : i + window] = [True] * window
        flags.append(own)
    return flags


def corpus(seed, scale=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé", k=rng.randint(1, 5)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(rng.choice([30, 36, 50, 90]) * scale) for _ in range(8)]
    rows = []
    for i in range(120):
        words = text(rng.randint(0, 60 * scale))
        for _ in range(rng.choice([0, 1, 1, 2])):
            at, passage = rng.randint(0, len(words)), rng.choice(passages)
            a = rng.choice([0, 0, 3])
            words[at:at] = passage[a : len(passage) - rng.choice([0, 0, 2])]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(500, "ab cd " * 100 * scale), (501, "x " * 80 * scale), (502, None), (503, ""), (504, "   "), (None, rows[0][1]), rows[1], rows[1]]
    rows += [(505, " ".join(passages[0])), (506, "y" * 50_000), (507, "\0\0 " * 70), (508, "a\0b " * 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "hot"), [(35, 20_000), (35, 4), (5, 20_000)])
def test_words(spark, monkeypatch, window, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = corpus(window + hot)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(4)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in seed_extend.remove_repeats(df, window).collect()]
    words = [(t or "").encode().split() for _, t in rows]
    want = []
    for (i, _), own, flags in zip(rows, words, brute(words, window), strict=True):
        want.append((i, len(own), sum(flags), b" ".join(w for w, f in zip(own, flags, strict=True) if not f).decode()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert seed_extend.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minima():
    h = np.random.default_rng(0).integers(0, 6, 300).astype(np.uint64) << np.uint64(30)
    for width in (1, 2, 7, 24):
        want = [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
        assert leftmost_minima(h, width).tolist() == want


@pytest.mark.parametrize(("window", "hot", "batches"), [(200, 2000, 2), (200, 4, 3), (60, 2000, 7), (20, 2000, 1)])
def test_bytes(spark, monkeypatch, window, hot, batches):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "GROUP_BYTES", 700)
    rows = corpus(window + hot, 2)
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(4)
    out = suffix_array.remove_repeats(df, window, batches=batches).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept), len(r.removed)) for r in out]
    data = [(t or "").encode() for _, t in rows]
    want = []
    for (i, _), own, flags in zip(rows, data, brute(data, window), strict=True):
        runs = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        want.append((i, len(own), sum(flags), bytes(b for b, f in zip(own, flags, strict=True) if not f), runs))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_no_bytes(spark):
    assert suffix_array.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def suffixes(spark, rows):
    listed = [(h, k.rjust(16), [p]) for h, k, p in rows]
    df = spark.createDataFrame(listed, "head binary, text_key binary, places array<int>")
    return df.withColumn("seed", F.xxhash64("head"))


def test_levels_merge_geometrically(spark):
    family = suffix_array.Family(spark)
    for batch in range(8):
        rows = [(bytes([9 - batch, i]), bytes([i]), i) for i in range(3)]
        assert all(heads.count() == 0 for heads in family.add(suffixes(spark, rows)))
    assert [(rank, family.level(path).count()) for rank, path in family.levels] == [(2, 12), (1, 6), (0, 3), (0, 3)]
    again = family.add(suffixes(spark, [(bytes([5, 1]), b"z", 9), (bytes([77, 0]), b"z", 9)]))
    assert [bytes(r["head"]) for heads in again for r in heads.collect()] == [bytes([5, 1])]


def test_levels_merge_within_a_run(spark, monkeypatch):
    ranks = []
    monkeypatch.setattr(suffix_array.Family, "drop", lambda family: ranks.extend(rank for rank, _ in family.levels))
    df = spark.createDataFrame(corpus(5, 2), "doc_id long, text string")
    suffix_array.remove_repeats(df, 60)
    assert ranks == [1, 0]


def test_a_level_is_in_byte_order(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "RANGE_ROWS", 50)
    rng = random.Random(3)
    rows = [(bytes(rng.choices([0, 1, 255], k=4)), bytes([rng.randint(0, 5)]), rng.randint(0, 9)) for _ in range(700)]
    family = suffix_array.Family(spark)
    (several,) = family.add(suffixes(spark, rows))
    level = [(bytes(r["head"]), bytes(r.text_key), r.place, r.several) for r in family.level(family.levels[0][1]).collect()]
    want = {}
    for h, k, p in rows:
        want.setdefault(h, set()).add((k.rjust(16), p))
    assert sorted((h, several_) for h, *_, several_ in level) == sorted((h, len(s) > 1) for h, s in want.items())
    assert all((k, p) in want[h] for h, k, p, _ in level)
    assert sorted(bytes(r["head"]) for r in several.collect()) == sorted(h for h, s in want.items() if len(s) > 1)
    files = family.level(family.levels[0][1]).select("head", "_metadata.file_name", "_metadata.row_index").collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r.row_index):
        by_file.setdefault(r.file_name, []).append(bytes(r["head"]))
    assert all(heads == sorted(heads) for heads in by_file.values()) and len(by_file) > 1


def test_a_kept_family_meets_later_batches(spark, tmp_path):
    folder, rows = str(tmp_path / "family"), corpus(9, 2)
    data = [[(t or "").encode() for _, t in part] for part in (rows[:50], rows[50:90], rows[90:])]
    for n, part in enumerate((rows[:50], rows[50:90], rows[90:])):
        df = spark.createDataFrame(part, "doc_id long, text string")
        got = [(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_array.remove_repeats(df, 60, batches=1, folder=folder).collect()]
        before = [t for earlier in data[:n] for t in earlier]
        # An earlier text counts once more or less often: what repeats does not change by it.
        flags = brute([*before, *data[n]], 60)[len(before) :]
        want = [(i, sum(f), bytes(b for b, g in zip(t, f, strict=True) if not g)) for (i, _), t, f in zip(part, data[n], flags, strict=True)]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [rank for rank, _ in suffix_array.Family(spark, folder).levels] == [1, 0]


@pytest.mark.parametrize(("fanout", "most"), [(1024, 1 << 16), (3, 1 << 16), (3, 0)])
def test_ranges_are_numbered_where_rows_are_thinned(spark, monkeypatch, fanout, most):
    """One binary search per row in numpy; the join of borders is for more ranges than a task can be sent."""
    monkeypatch.setattr(suffix_array, "RANGE_ROWS", 20)
    monkeypatch.setattr(suffix_array, "MOST_BORDERS", most)
    monkeypatch.setattr(ranges, "FANOUT", fanout)
    calls, number = [], ranges.Splits.number
    df = suffixes(spark, [(bytes([i % 7, i % 251]), b"%d" % i, i) for i in range(400)]).withColumn("place", F.col("places")[0])
    df = df.select("head", "text_key", "place", F.lit(False).alias("several"), "seed")
    splits = suffix_array._splits(df)
    monkeypatch.setattr(ranges.Splits, "number", lambda self, *a: calls.append(1) or number(self, *a))
    rows = suffix_array._in_byte_order(df, splits).withColumn("part", F.spark_partition_id()).collect()
    assert bool(calls) == (most == 0)
    want = Counter(bytes([i % 7, i % 251]) for i in range(400))
    assert sorted((bytes(r["head"]), r.several) for r in rows) == sorted((h, n > 1) for h, n in want.items())
    parts = {}
    for r in rows:
        parts.setdefault(r.part, []).append(bytes(r["head"]))
    assert len(parts) > 3 and all(heads == sorted(heads) for heads in parts.values())


def test_levels_go_to_python_in_large_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), suffix_array.Family._write
    monkeypatch.setattr(suffix_array.Family, "_write", lambda self, *a: seen.append(spark.conf.get(name)) or write(self, *a))
    suffix_array.Family(spark).add(suffixes(spark, [(b"ab", b"x", 1), (b"ab", b"y", 1)]))
    assert seen == [str(suffix_array.BATCH_ROWS)] and spark.conf.get(name) == before


def test_runs_of_many_rows_at_once():
    rng = np.random.default_rng(4)
    flags = [rng.random(n) < 0.6 for n in (0, 1, 1, 30, 0, 2, 50, 0)]
    row, first, after = repeats.joined_runs(flags)
    want = [(i, int(a), int(b)) for i, f in enumerate(flags) for a, b in repeats.runs(f)]
    assert list(zip(row.tolist(), first.tolist(), after.tolist(), strict=True)) == want
    assert [len(x) for x in repeats.joined_runs([np.zeros(0, dtype=bool)])] == [0, 0, 0]


def test_spans_merge_like_flags():
    rng = random.Random(8)
    texts = ["".join(rng.choices("aé€𝄞", k=rng.randint(0, 40))).encode() for _ in range(60)]
    spans = []
    for text in texts:
        cuts = [sorted(rng.choices(range(len(text) + 1), k=2)) for _ in range(rng.randint(0, 4))]
        spans.append([{"first": a, "after": b} for a, b in cuts if a < b] if rng.random() < 0.8 else None)
    copied = np.array([rng.random() < 0.1 and len(t) > 0 for t in texts])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
    for offset in (0, 7):
        column = pa.array(spans, kind).slice(offset)
        sizes = np.array([len(t) for t in texts[offset:]])
        row, first, after = suffix_array._merged(column, copied[offset:], sizes)
        got, whole = [[] for _ in sizes], [[] for _ in sizes]
        for r, a, b in zip(row.tolist(), first.tolist(), after.tolist(), strict=True):
            got[r].append((a, b))
            a, b = suffix_array._whole(texts[offset + r], a, b)
            whole[r] += [(a, b)] * (a < b)
        for i, text in enumerate(texts[offset:]):
            flags = repeats.covered(len(text), spans[offset + i], bool(copied[offset + i]))
            assert got[i] == [(int(a), int(b)) for a, b in repeats.runs(flags)]
            starts = [k for k, byte in enumerate(text) if byte & 0xC0 != 0x80] + [len(text)]
            covers = [all(flags[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            flags = np.repeat(np.array(covers, dtype=bool), np.diff(starts))
            assert whole[i] == [(int(a), int(b)) for a, b in repeats.runs(flags)]


def test_rolling_in_pieces(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", {})
    assert len(Rolling(np.zeros(0, dtype=np.uint8), 1).each(32)) == 0
    assert len(repeats.Sequences([b"", b""], False, 32, 200).start) == 0 and len(repeats.Sequences([b" "], True, 12, 35).start) == 0
    symbols = np.random.default_rng(2).integers(0, 256, 20_001).astype(np.uint8)
    terms = (symbols.astype(np.uint64) + np.uint64(1)) * powers(Rolling.BASE, len(symbols))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])
    want = mix((sums[32:] - sums[:-32]) * powers(Rolling.BACK, len(sums))[:-32])
    assert (Rolling(symbols, 1).each(32) == want).all() and len(Rolling(symbols[:5], 1).each(32)) == 0
