import sys

import numpy as np
import pandas as pd
import pytest
from helpers import values
from pyspark.sql import functions as F

from pyspark import cloudpickle

from veritable.operators import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


@pytest.fixture(scope="module")
def samples(spark):
    return spark.range(100).select(
        F.col("id").cast("string").alias("file_name"), (F.col("id") % 2).cast("int").alias("label"),
        F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), (F.col("id") - 50).cast("double").alias("x"),
    )


def make_plain():
    return lambda batch: batch["x"].to_numpy()


def make_failing():
    def call(batch: pd.DataFrame) -> np.ndarray:
        if (batch["x"] == 7).any():
            raise ValueError("unreadable")
        return np.stack([np.zeros(len(batch)), batch["x"].to_numpy()], axis=1)

    return call


def test_one_or_two_logits(samples):
    a = scoring.score(samples, make_plain, ["x"], batch_size=7)
    b = scoring.score(samples.filter("x <> 7"), make_failing, ["x"])
    assert values(a.filter("file_name <> '57'"), "file_name", "prob_fake", "pred") == values(b, "file_name", "prob_fake", "pred")
    assert a.filter("(prob_fake >= 0.5) <> (pred = 1)").count() == 0


@pytest.mark.parametrize(("policy", "rows", "errors", "unscored"), [("null", 100, 1, 1), ("skip", 99, 0, 0), ("blank", 100, 1, 0)])
def test_error_policies(samples, policy, rows, errors, unscored):
    neutral = (lambda row: row.assign(x=0.0)) if policy == "blank" else None
    got = scoring.score(samples, make_failing, ["x"], on_error=policy, neutral=neutral, batch_size=16)
    assert got.count() == rows
    assert got.filter("error is not null").count() == errors
    assert got.filter("prob_fake is null").count() == unscored


def test_policy_arguments(samples):
    with pytest.raises(ValueError, match="on_error"):
        scoring.score(samples, make_plain, ["x"], on_error="resample")
    with pytest.raises(ValueError, match="neutral"):
        scoring.score(samples, make_plain, ["x"], on_error="blank")


def test_evaluate_counts_what_was_not_scored(samples):
    table, manifest, predictions = scoring.evaluate(samples, make_failing, ["x"])
    assert predictions.count() == 100
    assert (manifest.first()["rows"], manifest.first()["unscored"]) == (100, 1)
    assert table.agg(F.sum("n")).first()[0] == 99


def test_sweep_scores_every_variant(samples):
    got = scoring.sweep(samples, ["none", "0"], lambda b, v: b if v == "none" else b.assign(x=float(v)), make_plain, ["x"], batch_size=9)
    rows = {(r["variant"], r["model"]): r for r in got.collect()}
    assert len(rows) == 6
    assert all(r["tpr"] == 1.0 and r["roc_auc"] == 0.5 for (v, _), r in rows.items() if v == "0")


def test_sweep_scores_once(spark, samples):
    calls = spark.sparkContext.accumulator(0)

    def make():
        def call(batch):
            calls.add(len(batch))
            return batch["x"].to_numpy()

        return call

    scoring.sweep(samples, ["none", "0"], lambda b, v: b, make, ["x"], batch_size=9).collect()
    assert calls.value == 200


def test_text_errors(spark):
    df = spark.createDataFrame([(1, "red"), (2, "blue")], "i int, c string")

    def make():
        def call(messages):
            if "blue" in messages:
                raise ValueError("no")
            return [m.upper() for m in messages]

        return call

    kept = scoring.generate_text(df, make, F.col("c"))
    assert values(kept, "i", "generated_prompt", "error") == [(1, "RED", None), (2, None, "ValueError: no")]
    assert values(scoring.generate_text(df, make, F.col("c"), on_error="skip"), "i") == [(1,)]

    def judge():
        def call(batch):
            if (batch["c"] == "blue").any():
                raise ValueError("no")
            return ["humans: yes"] * len(batch)

        return call

    def prompter():
        return lambda batch: ["ok"] * len(batch)

    assert values(scoring.annotate(df, judge, prompter), "i") == [(1,)]
    assert values(scoring.annotate(df, judge, prompter, on_error="null"), "i", "error") == [(1, None), (2, "ValueError: no")]


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "red"), (2, "blue")], "i int, c string")
    got = scoring.generate_text(df, lambda: lambda ms: [f'{{"prompt": "{m}!"}}' for m in ms], F.concat(F.lit("a "), "c"))
    assert values(got, "i", "generated_prompt") == [(1, "a red!"), (2, "a blue!")]
    judged = scoring.annotate(
        df, lambda: lambda b: ["humans: yes" if c == "red" else "none" for c in b["c"]], lambda: lambda b: ["The image is nice"] * len(b)
    )
    assert values(judged, "i", "category", "generated_prompt") == [(1, "human", "Nice")]


def make_weigher():
    """Scores a row by the rows and the bytes of its batch: 1000 * rows + bytes."""

    def call(batch: pd.DataFrame) -> np.ndarray:
        return np.full(len(batch), 1000.0 * len(batch) + batch["body"].map(len).sum())

    return call


def test_batches_are_bounded_by_payload(spark):
    sizes = [10, 10, 300, 5, 5, 5, 5, 90, 20, 0, 0, 0]
    rows = [(str(i), 1, "m", bytes(n)) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "file_name string, label int, model string, body binary").coalesce(1)
    raw = scoring.score(df, make_weigher, ["body"], batch_size=4, batch_bytes=100)
    told = raw.collect()
    assert len(told) == len(sizes) and all(r.error is None for r in told)
    frames = [pd.DataFrame({"body": [bytes(n) for n in sizes], "x": range(len(sizes))})]
    batches = [b["body"].map(len).tolist() for b in scoring._slices(iter(frames), 4, 100)]
    assert batches == [[10, 10], [300], [5, 5, 5, 5], [90], [20, 0, 0, 0]]
    assert [len(b) for b in scoring._slices(iter(frames), 5, 10**9)] == [5, 5, 2]


def test_payload_counts_what_is_inside():
    assert scoring.payload({"bytes": b"123", "path": "ab"}) == 5 and scoring.payload([b"1", {"a": "22"}]) == 3
    assert scoring.payload(np.zeros(4)) == 32 and scoring.payload(None) == 8


def test_rows_that_fail_are_blanked_together(spark):
    """One call for the neutral forms of a batch's failed rows; a neutral that makes single rows still works."""
    calls = []

    def call(batch):
        calls.append(len(batch))
        if (batch["x"] < 0).any():
            raise ValueError("unreadable")
        return batch["x"].to_numpy()

    batch = pd.DataFrame({"x": [1.0, -1.0, 2.0, -2.0, -3.0]})
    results, errors = scoring._guarded(call, batch, lambda rows: rows.assign(x=9.0))
    assert results == [[1.0], [9.0], [2.0], [9.0], [9.0]] and [e is not None for e in errors] == [False, True, False, True, True]
    assert calls == [5, 1, 1, 1, 1, 1, 3]
    assert scoring._guarded(call, batch, lambda row: pd.DataFrame({"x": [9.0]}))[0] == results
    one_by_one = scoring._guarded(lambda b: call(b) if len(b) == 1 else 1 / 0, batch, lambda rows: rows.assign(x=9.0))
    assert one_by_one[0] == results


def test_scoring_can_be_dealt_to_more_tasks(spark):
    df = spark.range(5000).coalesce(1).select(F.col("id").alias("file_name"), F.lit(1).alias("label"), F.lit("m").alias("model"), (F.col("id") / 5000.0).alias("x"))
    scored = scoring.score(df, lambda: lambda batch: batch["x"].to_numpy(), ["x"], tasks=7).withColumn("task", F.spark_partition_id())
    assert scored.select("task").distinct().count() == 7 and scored.count() == 5000
