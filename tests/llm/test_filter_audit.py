"""The audit against counts of plain Python over all orders."""

import itertools
import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from veritable.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string, source string, block long, terms string"
LABELS = "doc_id long, quality int, toxic int, failed int"


def failed(rows):
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    sets = []
    for i, text, *_ in rows:
        t = text or ""
        words = [w for w in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        f = ""
        f += "A" if len(words) < 50 else ""
        f += "B" if 100 * len(set(words)) < 65 * len(words) else ""
        f += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else ""
        f += "D" if any(c in "#$%&*|" for c in t) else ""
        f += "E" if i is not None and i > least[t] else ""
        sets.append(f)
    return sets


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    told = list(zip(rows, failed(rows), strict=True))
    out = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in told if (r[3] or "") == part]
        gone = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                here = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                fails = sum(letter in f for _, f in mine)
                out[part, order, step] = [
                    len(left), len(here), fails - len(here), sum(f == letter for _, f in mine),
                    sum(i in good for i, _ in here), sum(i in toxic for i, _ in here),
                ]
                gone[letter] += len(here)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(gone[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def result(spark, rows, labels, parts=3):
    docs = spark.createDataFrame([(*r, 7, "t") for r in rows], DOCS).repartition(parts)
    marks = spark.createDataFrame([(*r, 1) for r in labels], LABELS)
    got = fa.audit(docs, marks).collect()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in got}


def corpus(n=150):
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "ONE", "a # b", "é" * 60, " ".join(f"w{i}" for i in range(50)), "x\x0by\x0cz\x1cq\xa0r " * 30]
    for _ in range(40):
        words = [rng.choice(["Aa", "b", "C", "d%", "ee", "ß", "漢字"]) + str(rng.randint(0, 90)) for _ in range(rng.randint(1, 150))]
        texts.append(rng.choice([" ", "  ", "\r\n"]).join(words))
    rows = [(i, rng.choice(texts), "en", rng.choice(["s1", "s2", None, ""])) for i in range(n)]
    rows += [(None, texts[9], "en", "s1"), (None, texts[9], "en", "s1"), (3, texts[10], "en", "s3"), (3, texts[10], "en", "s3")]
    rows += [(1000 + i, "the hot text", "en", "hot") for i in range(n)]  # a third share one text
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 1100, 3)]
    return rows, [*labels, (3, 0, 1), (3, 1, 0), (None, 1, 1)]


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(fa, "BLOCK_BYTES", 600)
    monkeypatch.setattr(fa, "RANGE_BYTES", 300)
    monkeypatch.setattr(fa, "PIECE_BYTES", 100)
    rows, labels = corpus()
    assert result(spark, rows, labels) == brute(rows, labels)


def test_long_text_and_empty_tables(spark):
    rows = [(1, "one two " * 900_000, "en", "s"), (2, "x" * 6_000_000, "en", "s")]
    assert result(spark, rows, []) == brute(rows, [])
    assert result(spark, [], []) == {}


def test_shards_give_back_the_words(spark, monkeypatch):
    monkeypatch.setattr(fa, "BLOCK_BYTES", 400)
    monkeypatch.setattr(fa, "RANGE_BYTES", 200)
    rows, _ = corpus(60)
    docs = spark.createDataFrame([(i, r[1], r[2], r[3], 7, "t") for i, r in enumerate(rows)], DOCS).repartition(4)
    shards, words = fa.term_matrix(docs)
    pairs = set()
    for r in words.collect():
        pairs |= set(zip(np.frombuffer(r.codes, dtype=np.int64).tolist(), bytes(r.words).decode().split(" "), strict=True))
    known = dict(pairs)
    assert len(pairs) == len(known) == len({w for _, w in pairs}) and words.select("part").distinct().count() > 3
    got = {}
    for r in shards.collect():
        for k, i in enumerate(r.ids):
            cells = slice(r.starts[k], r.starts[k + 1])
            got[i] = {known[t]: n for t, n in zip(r.terms[cells], r.counts[cells], strict=True)}
    assert shards.select(F.count("block")).first()[0] > 10
    for i, row in enumerate(rows):
        words_of = (row[1] or "").encode().split()
        assert got[i] == {w.decode(): words_of.count(w) for w in words_of}


def test_a_row_group_of_shards_does_not_follow_the_text_of_a_task(spark):
    text = F.expr("concat_ws(' ', transform(sequence(1, 20000), i -> hex(xxhash64(id, i))))")
    docs = spark.range(100).coalesce(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("s").alias("source"))
    coded, _ = fa._with_codes(docs, "doc_id", "text", "source")
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in coded.inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 8  # one task wrote some 60 MB
    assert max(g.total_byte_size for g in groups) < 26 << 20  # 16 MB and a row


def test_python_gets_shards_by_bytes(spark, monkeypatch):
    name, given = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(fa, "write", lambda df, *rest, write=fa.write: (given.append(spark.conf.get(name)), write(df, *rest))[1])
    rows, labels = corpus(30)
    assert result(spark, rows, labels) == brute(rows, labels)
    assert given == [str(fa.BATCH_BYTES)] * 2 and spark.conf.get(name) == before
