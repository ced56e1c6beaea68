"""Each stage on what the one before kept, against plain Python."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as near_copies
from test_repeats import brute as repeated
from tokenizers import Tokenizer

import corpus_pipeline
from veritable.llm import mixing, toxicity
from veritable.llm.common import held_out_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, ids string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdeéü", k=rng.randint(2, 5)))
    passage = " ".join(word() for _ in range(70))
    rows, labels = [], []
    for i in range(150):
        words = [word() for _ in range(rng.randint(8, 90))]
        toxic = rng.random() < 0.2
        if toxic:
            words[2:2] = ["you", "idiot", "moron"]
        if rng.random() < 0.2:
            words[5:5] = passage.split(" ")
        text = " ".join(words)
        rows.append([i, text, "xx", f"s{i % 4}", len(text), "r", "z"])
        labels.append((i, int(toxic)))
    for i in range(10):
        rows.append([200 + i, rows[i * 7][1] + " " + word(), "xx", "s0", 9, None, None])
    rows += [[300, None, None, None, None, None, None], [301, "", "xx", "s1", 0, "", ""], [None, "lone words", None, "s2", 10, None, None], rows[4], rows[4]]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.settle(stage(spark, frames[-1], folder), name))
    docs, clean, single, cut, mixed, encoded = frames
    assert all(f.columns == docs.columns for f in frames[:-1])

    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out_fold(F.col("doc_id"), 5, 0))
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model["learned"], model["weights"])
    assert shown(clean) == sorted((r for r in shown(docs) if scorer.score([r[1]])[0] < 0.5), key=repr)
    assert 0 < clean.count() < docs.count()

    rows = shown(clean)
    groups = near_copies([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    kept = [r for r, (_, n, _, first) in zip(rows, sorted(groups), strict=True) if first or not n]
    assert len(single.collect()) == len(kept)
    roots = {i: root for i, _, root, _ in groups}
    left = [roots[rows.index(r)] for r in shown(single) if (r[1] or "").split()]
    assert len(left) == len(set(left))

    flags = repeated([(r[1] or "").encode() for r in shown(single)], 200)
    want = []
    for row, own in zip(shown(single), flags, strict=True):
        text, at = "", 0
        for c in row[1] or "":
            size = len(c.encode())
            text += "" if all(own[at : at + size]) else c
            at += size
        want.append((row[0], text, *row[2:4], len(text) if any(own) else row[4], *row[5:]))
    assert shown(cut) == sorted(want, key=repr)
    assert any(map(any, flags))

    copies = {}
    for r in mixing.mix(cut).collect():
        copies[r.doc_id, r.source, r["size"]] = copies.get((r.doc_id, r.source, r["size"]), 0) + r.copies
    seen = {}
    for r in shown(mixed):
        assert r in want
        seen[r[0], r[3], len(r[1].split())] = seen.get((r[0], r[3], len(r[1].split())), 0) + 1
    assert seen == {k: n for k, n in copies.items() if n}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    told = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, tuple(r["ids"]), r.decoded) for r in encoded.collect())
    plain = []
    for r in mixed.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        plain.append((r.doc_id is None, r.doc_id or 0, len(ids), tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert told == sorted(plain)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
