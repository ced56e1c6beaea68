import math
import random

import pytest
from helpers import values
from pyspark.sql import functions as F

from veritable.operators import filters, metrics

SCHEMA = "file_name string, model string, label int, prob_fake double"


def brute_auc(rows):
    pos = [p for _, _, y, p in rows if y == 1]
    neg = [p for _, _, y, p in rows if y == 0]
    if not pos or not neg:
        return None
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def rows():
    """A hot model with few distinct scores, one with many, one with a single class."""
    rng = random.Random(7)
    out = []
    for i in range(900):
        if i % 3 == 0:
            out.append((str(i), "hot", rng.randint(0, 1), rng.choice([0.0, 0.5, 1.0])))
        else:
            out.append((str(i), "wide", rng.randint(0, 1), rng.random()))
    return out + [("x", "only_fake", 1, 0.4), ("y", "only_fake", 1, 0.6)]


def test_auc_is_exact_for_any_layout(spark, rows):
    want = {m: brute_auc([r for r in rows if r[1] == m]) for m in ("hot", "wide", "only_fake")}
    for parts in (1, 9):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        got = {r["model"]: r["roc_auc"] for r in metrics.roc_auc(df, ["model"]).collect()}
        assert got["only_fake"] is None
        for m in ("hot", "wide"):
            assert math.isclose(got[m], want[m], rel_tol=1e-14)
        overall = metrics.roc_auc(df).first()["roc_auc"]
        assert math.isclose(overall, brute_auc(rows), rel_tol=1e-14)


def test_rates(spark, rows):
    got = {r["model"]: r for r in metrics.metrics_by(spark.createDataFrame(rows, SCHEMA)).collect()}
    for m in ("hot", "wide", "only_fake"):
        mine = [(y, int(p >= 0.5)) for _, mm, y, p in rows if mm == m]
        tp, fp = mine.count((1, 1)), mine.count((0, 1))
        fn, tn = mine.count((1, 0)), mine.count((0, 0))
        r = got[m]
        assert r["n"] == len(mine)
        assert r["accuracy"] == (tp + tn) / len(mine)
        assert r["tpr"] == tp / (tp + fn)
        assert r["tnr"] == (tn / (tn + fp) if tn + fp else None)
        assert r["f1"] == 2 * tp / (2 * tp + fp + fn)


def test_non_finite_scores_are_dropped(spark):
    rows = [("a", "m", 1, float("nan")), ("b", "m", 0, float("inf")), ("c", "m", 1, 0.5), ("d", "m", 0, None), ("e", "m", 0, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert values(filters.finite_only(df, "prob_fake"), "file_name") == [("c",), ("e",)]
    r = metrics.binary_metrics(df).first()
    assert (r["n"], r["accuracy"], r["precision"], r["recall"], r["f1"], r["roc_auc"]) == (2, 1.0, 1.0, 1.0, 1.0, 1.0)


def test_no_rows_and_no_positives(spark):
    r = metrics.binary_metrics(spark.createDataFrame([], SCHEMA)).first()
    assert tuple(r) == (0, 0.0, 0.0, 0.0, 0.0, None)
    assert metrics.metrics_by(spark.createDataFrame([], SCHEMA)).count() == 0
    r = metrics.metrics_by(spark.createDataFrame([("a", "m", 0, 0.9)], SCHEMA)).first()
    assert (r["tpr"], r["tnr"], r["f1"], r["roc_auc"]) == (None, 0.0, 0.0, None)


TABLE = "detector string, model string, n bigint, accuracy double, tpr double, tnr double, f1 double, quality string"


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        ("a", "gen", 10, 0.5, 0.5, None, 0.4, "none"),
        ("a", "gen2", 30, 0.9, 0.9, None, 0.8, "90"),
        ("a", "cam", 20, 0.8, None, 0.8, 0.0, "none"),
        ("b", "gen", 0, 0.1, 0.1, None, 0.2, "90"),
        ("c", "cam", 5, 1.0, None, 1.0, 0.0, "25"),
    ]
    return spark.createDataFrame(rows, TABLE)


def test_weighted_means(table):
    got = table.groupBy("detector").agg(
        metrics.weighted_mean("tpr", "n").alias("w"), metrics.macro_mean("tpr").alias("m")
    )
    rows = {r["detector"]: (r["w"], r["m"]) for r in got.collect()}
    assert math.isclose(rows["a"][0], 0.8) and math.isclose(rows["a"][1], 0.7)
    assert rows["b"] == (None, 0.1) and rows["c"] == (None, None)


def test_balanced_and_reports(table):
    got = {r["detector"]: r for r in metrics.balanced_source_accuracy(table, ["detector"], ["cam"]).collect()}
    assert math.isclose(got["a"]["score"], (0.8 + 0.7) / 2)
    assert math.isclose(got["a"]["standard_error"], math.sqrt(((0.5 - 2.2 / 3) ** 2 + (0.9 - 2.2 / 3) ** 2 + (0.8 - 2.2 / 3) ** 2) / 2) / math.sqrt(3))
    assert (got["c"]["score"], got["c"]["standard_error"]) == (1.0, 0.0)
    report = {r["detector"]: r for r in metrics.split_report(table, ["detector"], ["cam"]).collect()}
    assert math.isclose(report["a"]["average_tpr"], 0.8) and report["c"]["average_tpr"] is None
    summary = metrics.sweep_summary(table, ["cam"]).orderBy("place").collect()
    assert [r["quality"] for r in summary] == ["none", "90", "25"]
    assert math.isclose(summary[0]["overall_acc"], (5 + 16) / 30) and summary[2]["fake_acc"] is None


def test_input_is_read_once_and_counted_first(spark, tmp_path, rows):
    path = str(tmp_path / "p")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    read = spark.read.parquet(path)
    df = metrics.metrics_by(read.mapInPandas(count, read.schema))
    assert df.filter(F.col("model") == "hot").count() == 1
    df.collect()
    assert seen.value == len(rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # All that is left to read are the counts per model and score.
    assert "ReadSchema: struct<model:string,prob_fake:double,_pos:bigint,_neg:bigint>" in plan
    assert "label:int" not in plan


def test_stored_counts_grow_by_what_is_new(spark, rows, tmp_path):
    folder = str(tmp_path / "counts")
    parts = [rows[:100], rows[100:650], rows[650:]]
    for i, part in enumerate(parts):
        metrics.append_counts(spark.createDataFrame(part, SCHEMA), folder, ["model"])
        so_far = spark.createDataFrame([r for p in parts[: i + 1] for r in p], SCHEMA)
        stored = metrics.rates(metrics.stored_totals(spark, folder, ["model"]), ["model"])
        assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, metrics.metrics_by(so_far).collect()))
    # A run reads its own predictions alone, and adds one folder.
    assert len(list((tmp_path / "counts").glob("run=*"))) == 3
    (tmp_path / "counts" / "run=broken").mkdir()
    one = spark.createDataFrame(rows[:1], SCHEMA)
    before = sorted(p.name for p in (tmp_path / "counts").rglob("*.parquet"))
    metrics.append_counts(one, folder, ["model"])
    assert set(before) < {p.name for p in (tmp_path / "counts").rglob("*.parquet")}
