import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import langid, toxicity
from veritable.llm.common import held_out_fold

SCHEMA = "doc_id long, text string, lang string, toxic int, score double"
SYLLABLES = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["sch", "ür", "ent", "ach"]}


def corpus(n=400):
    rng = random.Random(7)
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.3)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "zorg" + rng.choice("abcde")]))
        rows.append((i, " ".join(words) + ".", lang, toxic if i % 3 else None, 0.5))
    odd = [(None, "ba lo mi", "aa", 0, None), (9001, None, "aa", 1, None), (9002, "", None, None, None), (9003, "12 34 !", "aa", None, None)]
    return [*rows, *odd, (9004, "sch " * 30_000, None, None, None), rows[0], rows[0]]


def test_languages(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    model = langid.fit(df.filter(~held_out_fold(F.col("doc_id"), 4, 2)))
    got = langid.predict(df, model).collect()
    assert len(got) == len(rows)
    found = {(r.doc_id): r for r in got}
    right = [found[i].lang_pred == lang for i, text, lang, *_ in rows if lang and text and any(map(str.isalpha, text))]
    assert np.mean(right) > 0.99
    for i in (9001, 9002, 9003):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[9004].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)
    again = langid.predict(df.repartition(3), langid.fit(df.repartition(2).filter(~held_out_fold(F.col("doc_id"), 4, 2))))
    assert sorted(map(repr, got)) == sorted(map(repr, again.collect()))
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0


def test_scores_are_naive_bayes():
    texts = [("ab ab", "x"), ("ba cc", "y"), ("abc", "x")]
    counts = {}
    for text, lang in texts:
        own = counts.setdefault(lang, np.zeros(langid.BUCKETS))
        codes = np.array([ord(c) for c in f" {text} "], dtype=np.uint64)
        for length in langid.LENGTHS:
            for cell in langid.cells(codes, length):
                own[cell] += 1
    columns = [np.log((counts[k] + langid.SMOOTHING) / (counts[k] + langid.SMOOTHING).sum()) for k in ("x", "y")]
    model = {"langs": ["x", "y"], "matrix": np.stack(columns, 1).astype(np.float32), "prior": np.log([2 / 3, 1 / 3])}
    names, scores = langid.score_texts(model, ["ab", "cc", "zz", None])
    for text, name, score in zip(["ab", "cc", "zz"], names, scores, strict=False):
        codes = np.array([ord(c) for c in f" {text} "], dtype=np.uint64)
        total = model["prior"] + sum(model["matrix"][langid.cells(codes, n)].sum(axis=0) for n in langid.LENGTHS)
        share = np.exp(total - total.max()) / np.exp(total - total.max()).sum()
        assert name == "xy"[total.argmax()] and abs(score - share.max()) < 1e-4
    assert (names[3], scores[3]) == ("und", 0.0)


def test_toxicity(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    docs = df.select("doc_id", "text", F.lit("x").alias("id"))
    labels = df.select("doc_id", "toxic", F.lit("y").alias("text"))
    model = toxicity.fit(docs, labels.filter(~held_out_fold(F.col("doc_id"), 5, 0)))
    assert "zorg+" in model["learned"]
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: t for i, text, _, t, _ in rows if t is not None and i is not None and i < 9000}
    assert np.mean([(r.score >= 0.5) == (truth[r.doc_id] == 1) for r in got if r.doc_id in truth]) > 0.97
    again = toxicity.fit(docs.repartition(2), labels.repartition(3).filter(~held_out_fold(F.col("doc_id"), 5, 0)))
    assert again["learned"] == model["learned"] and np.array_equal(again["weights"], model["weights"])
    plain = toxicity.fit(docs, labels.limit(0))
    assert plain["learned"] == [] and toxicity.score(docs.limit(0), plain).count() == 0


def test_unrelated_texts_with_common_words_all_teach(spark):
    """An insult outside the lists, only in texts that share their common words; copies count once."""
    common = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    own = lambda i: chr(97 + i // 26) + chr(97 + i % 26)
    rows = [(i, f"{common} x{own(i)}q grumpfel", 1) for i in range(40)]
    rows += [(i, f"{common} y{own(i - 40)}q", 0) for i in range(40, 120)]
    rows += [(i, "sprotzen wa wb", 1) for i in range(120, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    learned = toxicity.fit(df.drop("toxic"), df.drop("text"))["learned"]
    assert any("grumpfel".startswith(s.rstrip("+")) for s in learned), learned
    assert not any("sprotzen".startswith(s.rstrip("+")) for s in learned), learned


def test_grammar_marks_context():
    def kinds(text):
        found = toxicity.Scorer().matches(text)
        return {k for k, n in zip(toxicity.KINDS, found, strict=True) if n}

    assert kinds("You are an idiot.") == {("insult", True, False, False)}
    assert kinds("What an idiot.") == {("insult", False, False, False)}
    assert kinds("You are not an idiot.") == {("insult", True, True, False)}
    assert kinds("He said you are an idiot.") == {("insult", True, False, True)}
    assert kinds("I will kill you.") == {("threat", False, False, False)}
    assert kinds("You said it. Scum everywhere.") == {("insult", False, False, False)}
    assert kinds("Nothing of the kind.") == set() == kinds(None)


def test_composition_equals_a_cascade():
    """The composed machine against running its parts one after another."""
    rng = random.Random(1)
    parts = [toxicity.marker("target", toxicity.NEAR, 0), toxicity.marker("negation", toxicity.SCOPE, 1), toxicity.marker("reported", None, 2)]
    for _ in range(200):
        symbols = rng.choices(toxicity.SYMBOLS, k=12)
        stream = [(s,) for s in symbols]
        for part in parts:
            stream = list(part.run(stream))
        want = [("match", *s) if s[0] in ("insult", "threat") else s for s in stream]
        assert list(toxicity.grammar().run(symbols)) == want
    assert len(toxicity.KINDS) == len(set(product(("insult", "threat"), *[(False, True)] * 3)))


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "BROADCAST_BYTES", 3 * langid.BUCKETS * 4)
    rows = [(i, f"some text {i}", f"l{i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(df.filter("lang <> 'l3'"))["langs"]) == 3
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.fit(df)
