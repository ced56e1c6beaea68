"""Queries over prediction and metric tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritable.catalog.base import (
    AUC_SQL,
    F1_SQL,
    PREDICTIONS,
    REAL_SOURCES,
    REAL_SQL,
    metrics_sql,
    predictions,
    query,
    totals_sql,
)
from veritable.functions.naming import Rule
from veritable.operators.joins import detector_test_matrix
from veritable.operators.metrics import (
    append_counts,
    balanced_source_accuracy,
    binary_metrics as binary_metrics_of,
    macro_mean,
    metrics_by,
    rates,
    roc_auc,
    stored_totals,
    split_report as split_report_of,
    sweep_summary as sweep_summary_of,
    weighted_mean,
)
from veritable.operators.ranking import rank_detectors as rank_detectors_of
from veritable.session import fresh_path
from veritable.operators.reports import (
    best_per_column as best_per_column_of,
    cross_matrix as cross_matrix_of,
    metric_leader as metric_leader_of,
    pivot_mean as pivot_mean_of,
)
from veritable.plans.evaluation import source_table

# Means of doubles are rounded on both sides: their last bits depend on the order of summing.
DIGITS = 9


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, DIGITS) for c in columns})


@query(metrics_sql(PREDICTIONS, "model"))
def metrics_by_source(spark, d):
    return metrics_by(predictions(spark, d), ["model"])


@query(metrics_sql(PREDICTIONS, "model"))
def stored_metrics(spark, d):
    """Metrics from counts that two runs have stored, each of its own predictions."""
    folder, rows = fresh_path(spark, "counts"), predictions(spark, d)
    for half in range(2):
        append_counts(rows.filter(F.pmod(F.xxhash64("prob_fake"), F.lit(2)) == half), folder, ["model"])
    return rates(stored_totals(spark, folder, ["model"]), ["model"])


@query(f"""
SELECT n, CAST(tp + neg - fp AS DOUBLE) / CAST(n AS DOUBLE) AS accuracy,
       CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS precision,
       CASE WHEN pos > 0 THEN CAST(tp AS DOUBLE) / CAST(pos AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS recall,
       {F1_SQL} AS f1, {AUC_SQL} AS roc_auc
FROM ({totals_sql(PREDICTIONS)}) AS m""")
def binary_metrics(spark, d):
    return binary_metrics_of(predictions(spark, d))


@query(f"""
SELECT detector, split, {AUC_SQL} AS roc_auc FROM ({totals_sql(PREDICTIONS, "detector, split")}) AS m""")
def roc_auc_by_detector(spark, d):
    return roc_auc(predictions(spark, d), ["detector", "split"])


TABLE = metrics_sql(PREDICTIONS, "detector, split, model")


def _metric_table(spark, d):
    return metrics_by(predictions(spark, d), ["detector", "split", "model"])


FAMILIES = [Rule("commerce", equals=("purchase",), starts=("sign",)), Rule("faults", contains=("rro",))]
RATE = f"CASE WHEN model IN {REAL_SQL} THEN tnr ELSE tpr END"


@query(f"""
WITH m AS ({TABLE}),
     f AS (SELECT *, {RATE} AS rate,
                  CASE WHEN model IN {REAL_SQL} THEN 'real' WHEN model IN ('purchase', 'signup') THEN 'commerce'
                       WHEN model LIKE '%rro%' THEN 'faults' ELSE model END AS family FROM m)
SELECT detector, family,
       round(sum(rate * n) / nullif(sum(CASE WHEN rate IS NOT NULL THEN n END), 0), {DIGITS}) AS rate
FROM f GROUP BY detector, family""")
def weighted_rates(spark, d):
    return _rounded(source_table(_metric_table(spark, d), FAMILIES, REAL_SOURCES), "rate")


@query(f"""
WITH m AS ({TABLE}), f AS (SELECT *, {RATE} AS v FROM m)
SELECT detector, split,
       round(coalesce((avg(v) FILTER (model IN {REAL_SQL}) + avg(v) FILTER (model NOT IN {REAL_SQL})) / 2,
                      avg(v) FILTER (model IN {REAL_SQL}), avg(v) FILTER (model NOT IN {REAL_SQL})), {DIGITS}) AS score,
       round(CASE WHEN count(v) < 2 THEN 0 ELSE stddev_samp(v) / sqrt(count(v)) END, {DIGITS}) AS standard_error
FROM f GROUP BY detector, split""")
def balanced_accuracy(spark, d):
    table = balanced_source_accuracy(_metric_table(spark, d), ["detector", "split"], REAL_SOURCES)
    return _rounded(table, "score", "standard_error")


@query(f"""
WITH m AS ({TABLE})
SELECT detector, split,
       round(sum(tpr * n) FILTER (model NOT IN {REAL_SQL})
             / nullif(sum(n) FILTER (model NOT IN {REAL_SQL} AND tpr IS NOT NULL), 0), {DIGITS}) AS average_tpr,
       round(sum(accuracy * n) / sum(n), {DIGITS}) AS overall_accuracy
FROM m GROUP BY detector, split""")
def split_report(spark, d):
    report = split_report_of(_metric_table(spark, d), ["detector", "split"], REAL_SOURCES)
    return _rounded(report, "average_tpr", "overall_accuracy")


@query(f"""
WITH m AS ({metrics_sql(PREDICTIONS, "quality, model")})
SELECT quality,
       round(sum(accuracy * n) FILTER (model NOT IN {REAL_SQL}) / nullif(sum(n) FILTER (model NOT IN {REAL_SQL}), 0), {DIGITS}) AS fake_acc,
       round(sum(tnr * n) FILTER (model IN {REAL_SQL}) / nullif(sum(n) FILTER (model IN {REAL_SQL} AND tnr IS NOT NULL), 0), {DIGITS}) AS real_tnr,
       round(sum(accuracy * n) / sum(n), {DIGITS}) AS overall_acc,
       round(sum(f1 * n) FILTER (model NOT IN {REAL_SQL}) / nullif(sum(n) FILTER (model NOT IN {REAL_SQL}), 0), {DIGITS}) AS fake_f1,
       CAST(row_number() OVER (ORDER BY CASE WHEN quality = 'none' THEN 100 ELSE TRY_CAST(quality AS INTEGER) END DESC) AS INTEGER) AS place
FROM m GROUP BY quality""")
def sweep_summary(spark, d):
    summary = sweep_summary_of(metrics_by(predictions(spark, d), ["quality", "model"]), REAL_SOURCES)
    return _rounded(summary, "fake_acc", "real_tnr", "overall_acc", "fake_f1")


@query(f"""
WITH m AS ({TABLE})
SELECT detector, round(avg(f1) FILTER (split = 'indist'), {DIGITS}) AS indist,
       round(avg(f1) FILTER (split = 'ood'), {DIGITS}) AS ood
FROM m GROUP BY detector""")
def cross_matrix(spark, d):
    matrix = cross_matrix_of(_metric_table(spark, d), "detector", "split", "f1", ["indist", "ood"])
    return _rounded(matrix, "indist", "ood")


@query(f"WITH m AS ({TABLE}) SELECT split, model, round(avg(f1), {DIGITS}) AS f1 FROM m GROUP BY split, model")
def pivot_mean(spark, d):
    return _rounded(pivot_mean_of(_metric_table(spark, d), ["split", "model"], "f1"), "f1")


@query(f"""
WITH m AS ({TABLE})
SELECT detector, round(avg(f1), {DIGITS}) AS macro_f1,
       round(avg({RATE}) FILTER (model IN {REAL_SQL}), {DIGITS}) AS real_rate
FROM m GROUP BY detector""")
def macro_means(spark, d):
    table = _metric_table(spark, d).groupBy("detector").agg(
        macro_mean("f1").alias("macro_f1"),
        macro_mean("tnr", F.col("model").isin(*REAL_SOURCES)).alias("real_rate"),
    )
    return _rounded(table, "macro_f1", "real_rate")


TESTS = ("indist", "ood", "unseen")
MATCHED = [("d0", "indist"), ("d1", "ood")]
MEANS = f"""
WITH m AS ({TABLE}),
     v AS (SELECT detector, split AS test, round(sum(accuracy * n) / sum(n), {DIGITS}) AS value FROM m GROUP BY detector, split),
     pairs AS (SELECT DISTINCT detector, test FROM m, (VALUES ('indist'), ('ood'), ('unseen')) AS t(test)),
     x AS (SELECT p.detector, p.test, v.value,
                  (p.detector = 'd0' AND p.test = 'indist') OR (p.detector = 'd1' AND p.test = 'ood') AS matched
           FROM pairs p LEFT JOIN v ON p.detector = v.detector AND p.test = v.test)"""


def _matrix(spark, d):
    means = _metric_table(spark, d).groupBy("detector", F.col("split").alias("test")).agg(
        F.round(weighted_mean("accuracy", "n"), DIGITS).alias("value")
    )
    return detector_test_matrix(means, TESTS, means)


@query(f"{MEANS} SELECT detector, test, value FROM x")
def detector_matrix(spark, d):
    return _matrix(spark, d)


@query(f"""{MEANS},
     y AS (SELECT *, max(value) FILTER (NOT matched) OVER (PARTITION BY test) AS b,
                  avg(value) OVER (PARTITION BY detector) AS a FROM x)
SELECT detector, test, value, matched, coalesce(NOT matched AND abs(value - b) <= 1e-12, false) AS best,
       round(a, {DIGITS}) AS average, abs(a - (SELECT max(a) FROM y)) <= 1e-12 AS best_average
FROM y""")
def best_per_column(spark, d):
    return _rounded(best_per_column_of(_matrix(spark, d), MATCHED), "average")


@query(f"""
WITH a AS (SELECT detector, {AUC_SQL} AS roc_auc FROM ({totals_sql(PREDICTIONS, "detector")}) AS m)
SELECT detector, roc_auc, abs(roc_auc - (SELECT max(roc_auc) FROM a)) <= 1e-9 * roc_auc AS leader FROM a""")
def metric_leader(spark, d):
    return metric_leader_of(roc_auc(predictions(spark, d), ["detector"]), "roc_auc")


@query(f"""
WITH m AS ({TABLE}), f AS (SELECT *, {RATE} AS v FROM m),
     s AS (SELECT detector, split,
                  round((avg(v) FILTER (model IN {REAL_SQL}) + avg(v) FILTER (model NOT IN {REAL_SQL})) / 2, {DIGITS}) AS score
           FROM f GROUP BY detector, split),
     p AS (SELECT detector, max(score) FILTER (split = 'indist') AS indist, max(score) FILTER (split = 'ood') AS ood
           FROM s GROUP BY detector)
SELECT detector, indist, ood,
       CAST(row_number() OVER (ORDER BY greatest(indist, ood) DESC, detector) AS INTEGER) AS place FROM p""")
def rank_detectors(spark, d):
    scores = balanced_source_accuracy(_metric_table(spark, d), ["detector", "split"], REAL_SOURCES)
    wide = scores.groupBy("detector").pivot("split", ["indist", "ood"]).agg(F.max(F.round("score", DIGITS)))
    return rank_detectors_of(wide, "indist", "ood", "detector")
