import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veritable.llm import fingerprint
from veritable.operators import ranges


def rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcé", k=4)) for _ in range(60)]
    out = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.randint(1, 200)))) for i in range(120)]
    return [*out, (1000, None), (1001, ""), (1002, " \n"), (7, out[5][1]), (out[3][0], out[3][1]), (None, "a b c d"), (1003, "x" * 30_000)]


def jaccard(a, b):
    x, y = Counter(a.split()), Counter(b.split())
    both, either = sum((x & y).values()), sum((x | y).values())
    return both / either if either else 1.0


def test_edits(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 3000)
    data = rows()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, place string").repartition(5)
    got = fingerprint.compare_with_edits(df).collect()
    order = sorted(((i if i is not None else -1, t or "") for i, t in data), reverse=True)
    want, near = [], {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want.append((i, len(text), sha))
        near[i, sha] = (jaccard(text, edited), jaccard(text, after), text)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    prints, gaps = {}, []
    for r in got:
        edited, after, text = near[r.doc_id if r.doc_id is not None else -1, r.edited_sha256]
        gaps += [r.near_edited - edited, r.near_next - after]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == fingerprint.EMPTY) == (not text.split())
    assert abs(np.mean(gaps)) < 0.02
    assert np.std(gaps) < 0.1
    assert fingerprint.compare_with_edits(df.limit(0)).count() == 0
    assert fingerprint.compare_with_edits(df.filter("doc_id = 1003")).first().near_next == 1.0


def test_next_texts_of_many_short_rows(spark):
    df = spark.range(100_000).select((F.col("id") * 7 % 100_003).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = fingerprint.with_next(df)
    assert got.select("range").distinct().count() == 1  # ranges follow bytes, not rows
    want = {r.doc_id: r.text for r in df.collect()}
    order = sorted(want, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    rows = got.select("id", "text", "next_text").collect()
    assert len(rows) == 100_000 and all(r.text == want[r.id] and r.next_text == want[after[r.id]] for r in rows)


def test_next_texts_over_levels_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 200)
    monkeypatch.setattr(ranges, "FANOUT", 4)
    df = spark.range(2000).select((F.col("id") * 3).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    got = fingerprint.with_next(df)
    rows = {r.id: r for r in got.collect()}
    assert len(rows) == 2000 and len({r.range for r in rows.values()}) > 20
    places = {(r.range, r.place): r.id for r in rows.values()}
    for i, r in rows.items():
        after = i - 3 if i else 5997
        assert r.next_text == f"t{after // 3}" and places[r.next_range, r.next_place] == after


def test_collisions_are_generalised_jaccard(spark):
    texts = [("a " * 5 + "b " * 3 + "c d e f", "a " * 2 + "b " * 6 + "c d g h"), ("x y z", "x y z"), ("p q", "r s"), ("w " * 40, "w " * 10)]
    df = spark.createDataFrame([(k, i, t) for i, pair in enumerate(texts) for k, t in enumerate(pair)], "side int, id int, text string")
    made = fingerprint.fingerprints(df, ["side", "id"], samples=512)
    both = made.filter("side = 0").alias("a").join(made.filter("side = 1").alias("b"), "id")
    got = {r.id: r.near for r in both.select("id", fingerprint.likeness(F.col("a.fingerprint"), F.col("b.fingerprint"), 512).alias("near")).collect()}
    for i, (one, two) in enumerate(texts):
        assert abs(got[i] - jaccard(one, two)) < 0.08
