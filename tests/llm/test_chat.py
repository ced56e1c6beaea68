import hashlib
import random

from pyspark.sql import functions as F

from veritable.llm.chat import CONTROL, conversations, escape, format_turns, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_round_trip(spark):
    rng = random.Random(3)
    bits = [*CONTROL, "<", "[", "\\", "/", "s>", "INST]", "a", "\n", " ", ">", "<\\s>", "é", "$1"]
    texts = ["", *("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(2000))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in rows.select("t", escape(F.col("t")), unescape(escape(F.col("t")))).collect():
        assert u == t
        assert not any(c in e for c in CONTROL), (t, e)


def test_conversations(spark):
    rng = random.Random(5)
    bits = [*CONTROL, "<", "[", "\\", "ok", "\n", " ", "ü"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randint(1, 200 if conv == 0 else 6)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.9 else rng.choice(["system", "tool<s>", None, ""])
            text = rng.choice([None, "", "".join(rng.choices(bits, k=6))])
            rows.append((conv, turn, role, text, "x"))
    rows += [rows[3], (None, 0, "user", "a", None), (99, None, "user", "b", None), (99, 5, "assistant", "c" * 100_000, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.conv_id: r for r in conversations(format_turns(df)).withColumn("turns", read_back(F.col("formatted"))).collect()}
    want = {}
    for conv, turn, role, text, _ in rows:
        want.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[conv].turns] == [t[1:] for t in turns] or len({t[:2] for t in turns}) < len(turns)
        assert got[conv].n_turns == len(turns)
        last, valid = "START", True
        follows = {"START": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
        for _, role, _ in turns:
            valid &= role in follows.get(last, ())
            last = role
        if len({t[:2] for t in turns}) == len(turns):
            assert got[conv].valid == valid
    assert conversations(format_turns(df.limit(0))).count() == 0


def test_marks_and_loss(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]", None), (1, 1, "assistant", "</s>[INST] ok [/INST]", None)]
    out = format_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("turn").collect()
    assert [[s.loss for s in r.segments] for r in out] == [[False] * 3, [False, True, False]]
    assert "".join(s.text for r in out for s in r.segments) == (
        "[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]<s><\\/s>[\\INST] ok [\\/INST]</s>"
    )
