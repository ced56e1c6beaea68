"""Comparison and statistics tables.

Inputs are either data rows, which are aggregated at once, or metric tables with one row per
source; windows without a partition appear only over the latter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.naming import release_month
from veritable.session import settle


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def split_summary(df: DataFrame, label: str = "label", model: str = "model") -> DataFrame:
    """Rows in all, per label and per model in one pass: (`level`, `value`, `rows`)."""
    slim = df.select(_text(label).alias("_l"), _text(model).alias("_m"))
    sets = slim.groupingSets([[F.col("_l")], [F.col("_m")], []], F.col("_l"), F.col("_m"))
    return sets.agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_gid")).select(
        F.when(F.col("_gid") == 1, "label").when(F.col("_gid") == 2, "model").otherwise("total").alias("level"),
        F.when(F.col("_gid") == 1, F.col("_l")).when(F.col("_gid") == 2, F.col("_m")).otherwise("").alias("value"),
        "rows",
    )


def in_report_order(summary: DataFrame) -> DataFrame:
    """`split_summary` with `place`: the total, labels by name, then models, the most frequent first.

    The window runs over one row per label and model.
    """
    level = F.when(F.col("level") == "total", 0).when(F.col("level") == "label", 1).otherwise(2)
    rows = F.when(F.col("level") == "model", -F.col("rows")).otherwise(F.lit(0))
    return summary.withColumn("place", F.row_number().over(Window.orderBy(level, rows, "value")))


def label_share(df: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """n, fake and real counts with percentages; everything not `fake` counts as real."""
    fake = F.count_if(F.col(label) == "fake")
    n = F.count(F.lit(1))
    return (
        df.groupBy(*keys)
        .agg(n.alias("n"), fake.alias("fake"))
        .withColumn("real", F.col("n") - F.col("fake"))
        .withColumns(
            {
                "fake_pct": F.col("fake") * 100.0 / F.nullif(F.col("n"), F.lit(0)),
                "real_pct": F.col("real") * 100.0 / F.nullif(F.col("n"), F.lit(0)),
            }
        )
    )


def package_summary(
    df: DataFrame, distinct: str = "model", histograms: Sequence[str] = ("label", "type")
) -> DataFrame:
    """(`what`, `value`, `rows`): histograms, and the number of distinct models or channels."""
    names = [*histograms, distinct]
    slim = df.select(*[_text(c).alias(f"_{i}") for i, c in enumerate(names)], F.col(distinct).isNotNull().alias("_set"))
    cols = [F.col(f"_{i}") for i in range(len(names))]
    counted = slim.groupingSets([[c] for c in cols], *cols).agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().alias("_gid"), F.max("_set").alias("_set")
    )
    width = len(names)
    what, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(names):
        gid = (2**width - 1) ^ (1 << (width - 1 - i))
        what = F.when(F.col("_gid") == gid, name).otherwise(what)
        value = F.when(F.col("_gid") == gid, cols[i]).otherwise(value)
    tagged = counted.select(what.alias("what"), value.alias("value"), "rows", "_set")
    total = F.lit(f"distinct {distinct}")
    is_total = F.col("what") == distinct
    return (
        tagged.filter(~is_total | F.col("_set"))
        .groupBy(
            F.when(is_total, total).otherwise(F.col("what")).alias("what"),
            F.when(is_total, "").otherwise(F.col("value")).alias("value"),
        )
        .agg(F.sum(F.when(F.col("what") == distinct, 1).otherwise(F.col("rows"))).alias("rows"))
    )


def _first_filled(value: str, order: str) -> Column:
    text = F.nullif(F.col(value), F.lit(""))
    return F.min_by(text, F.when(text.isNotNull(), F.col(order)))


def source_stats(df: DataFrame, order: str, split: str, splits: Sequence[str]) -> DataFrame:
    """Per model over several splits: count, release, type, label.

    Inside a split the first non-empty value counts, in `order`; across splits counts add, the
    smaller release wins, and type and label come from the first split that has one.
    """
    position = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col(split))
    per_split = df.groupBy("model", split).agg(
        F.count(F.lit(1)).alias("_n"),
        _first_filled("release_date", order).alias("_release"),
        _first_filled("type", order).alias("_type"),
        _first_filled("label", order).alias("_label"),
    ).withColumn("_at", position)
    return per_split.groupBy("model").agg(
        F.sum("_n").alias("count"),
        F.coalesce(F.min("_release"), F.lit("")).alias("release"),
        F.coalesce(F.min_by("_type", F.when(F.col("_type").isNotNull(), F.col("_at"))), F.lit("")).alias("type"),
        F.coalesce(F.min_by("_label", F.when(F.col("_label").isNotNull(), F.col("_at"))), F.lit("")).alias("label"),
    )


def grouped_stats(stats: DataFrame, family: Column) -> DataFrame:
    """Totals per side, per family and per model: (`level`, `side`, `family`, `model`, `count`,
    `release`, `members`). A family's release is its earliest month, null when none is known.
    """
    tagged = stats.select(
        F.when(F.col("label") == "real", "real").when(F.col("label") == "fake", "synthetic").alias("side"),
        F.when(F.col("label") == "real", "real").otherwise(family).alias("family"),
        "model",
        "count",
        release_month("release").alias("_month"),
    ).filter(F.col("side").isNotNull())
    return (
        tagged.rollup("side", "family", "model")
        .agg(
            F.sum("count").alias("count"),
            F.min("_month").alias("release"),
            F.count(F.lit(1)).alias("members"),
            F.grouping_id().alias("_gid"),
        )
        .filter(F.col("_gid") < 7)
        .select(
            F.when(F.col("_gid") == 0, "model").when(F.col("_gid") == 1, "family").otherwise("total").alias("level"),
            "side",
            "family",
            "model",
            "count",
            F.when(F.col("_gid") < 3, F.col("release")).alias("release"),
            "members",
        )
    )


def cross_matrix(results: DataFrame, run: str, test: str, value: str, tests: Sequence[str]) -> DataFrame:
    """Mean of `value` per run (rows) and test set (columns)."""
    return results.groupBy(run).pivot(test, list(tests)).agg(F.avg(value))


def pivot_mean(results: DataFrame, index: Sequence[str], value: str) -> DataFrame:
    return results.groupBy(*index).agg(F.avg(value).alias(value))


def last_seen(posts: DataFrame, channel: str, date: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    """Latest valid date per lower-cased channel; text that is no date is ignored."""
    day = F.try_to_timestamp(F.col(date), F.lit(pattern))
    return (
        posts.groupBy(F.lower(channel).alias("channel"))
        .agg(F.max(day).alias("last_seen"))
        .filter(F.col("last_seen").isNotNull())
    )


def tier_counts(contexts: DataFrame, tier: str = "tier", tiers: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Rows per context tier; tiers nobody is in show 0."""
    counted = contexts.agg(*[F.count_if(F.col(tier) == t).alias(f"_{t}") for t in tiers])
    cells = F.array(
        *[F.struct(F.lit(t).alias("tier"), F.col(f"_{t}").alias("rows")) for t in tiers]
    )
    return counted.select(F.explode(cells).alias("cell")).select("cell.tier", "cell.rows")


def infer_source_type(matched: DataFrame, model: str = "model") -> DataFrame:
    """Adds `type` by the number of rows of the model: at least 8000, at least 4000, fewer."""
    kinds = matched.groupBy(model).agg(F.count(F.lit(1)).alias("_n")).select(
        model,
        F.when(F.col("_n") >= 8000, "Base").when(F.col("_n") >= 4000, "Fine-tune").otherwise("LoRA").alias("type"),
    )
    return matched.join(kinds, model)


def dropped_report(dropped: DataFrame, k: int = 20, model: str = "model", match: str = "match") -> DataFrame:
    """The k most frequent dropped models with the name they resemble."""
    return (
        dropped.groupBy(model, match)
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), model)
        .limit(k)
    )


def ingest_counters(
    df: DataFrame, source: str, status: str, statuses: Sequence[str] = ("saved", "skipped", "errors")
) -> DataFrame:
    counted = df.groupBy(source).pivot(status, list(statuses)).agg(F.count(F.lit(1)))
    return counted.na.fill(0, subset=list(statuses))


def close_to(a: Column, b: Column, relative: float = 1e-12, absolute: float = 1e-12) -> Column:
    room = F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
    return F.coalesce(F.abs(a - b) <= room, F.lit(False))


def best_per_column(matrix: DataFrame, matched: Sequence[tuple[str, str]]) -> DataFrame:
    """Flags on a (`detector`, `test`, `value`) table.

    `matched` pairs were trained and tested on the same benchmark: they are marked and do not
    compete for `best`. `average` is the mean of a detector over its test sets. The matrix is written
    once, since flags and maximum both read it.
    """
    matrix = settle(matrix, "matrix")
    pair = F.struct("detector", "test")
    own = F.lit(False)
    for detector, test in matched:
        own = own | ((F.col("detector") == detector) & (F.col("test") == test))
    by_test, by_detector = Window.partitionBy("test"), Window.partitionBy("detector")
    flagged = matrix.withColumn("matched", own).withColumns(
        {
            "_best": F.max(F.when(~F.col("matched"), F.col("value"))).over(by_test),
            "average": F.avg("value").over(by_detector),
        }
    )
    top = flagged.agg(F.max("average").alias("m")).scalar()
    return flagged.select(
        pair["detector"].alias("detector"),
        pair["test"].alias("test"),
        "value",
        "matched",
        (~F.col("matched") & close_to(F.col("value"), F.col("_best"))).alias("best"),
        "average",
        close_to(F.col("average"), top).alias("best_average"),
    )


def metric_leader(results: DataFrame, metric: str) -> DataFrame:
    """Adds `leader` on the rows that hold the maximum; nulls are ignored."""
    results = settle(results, "results")
    top = results.agg(F.max(metric).alias("m")).scalar()
    return results.withColumn("leader", close_to(F.col(metric), top, 1e-9, 0.0))


def overall_auc(manifests: DataFrame) -> DataFrame:
    """AUC of a run under any of the three names manifests use."""
    names = ("roc_auc", "roc_AUC", "auc_roc")
    return manifests.withColumn(
        "auc", F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names]).cast("double")
    )
