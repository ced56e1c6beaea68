"""Deterministic samples, splits and quotas.

Every sampler reduces to: work out how many rows each group gives (a small table), then cut each
group at that place in the seeded random order (`mark_first`). Rows never move to be sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritable.functions.hashing import order_hash, uniform, uniform_int
from veritable.functions.labels import strip
from veritable.functions.naming import held_out_match
from veritable.operators.ranking import hash_rank, mark_first
from veritable.session import settle


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1)).alias("n")).first()["n"]


def shuffle(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Reproducible permutation: a range-partitioned sort by hash."""
    return df.orderBy(order_hash(seed, key), key)


def file_places(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """The rows of a written Parquet folder with their 1-based place: over its files in the order of
    their part numbers, and inside a file in the order of its rows."""
    file, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = spark.read.parquet(path).select("*", file.alias("_file"), row.alias("_row"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("int")
    # One row per file.
    sizes = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(part, "_file")) - F.col("_n")
    starts = settle(sizes.select("_file", before.alias("_before")), "places")
    return rows.join(starts, "_file").withColumn(name, F.col("_before") + F.col("_row") + 1).drop("_file", "_row", "_before")


def sample_n(df: DataFrame, n: int, key: str, seed: int | str) -> DataFrame:
    """Exactly min(n, rows) rows."""
    return mark_first(df, key, seed, n=n).filter("picked").drop("picked")


def filename_sample(df: DataFrame, predicate: Column, n: int, key: str, seed: int) -> DataFrame:
    return sample_n(df.filter(predicate), n, key, seed)


def holdout_per_group(
    pool: DataFrame,
    key: str,
    min_pool: int,
    per_group: int,
    seed: int,
    group: str = "model",
    label: str = "label",
) -> DataFrame:
    """Adds `split`: test or train. Rows that are neither fake nor real are left out.

    Groups with at least `min_pool` fake rows give `per_group` fake rows to test; as many real
    rows (or all there are) join them.
    """
    lower = F.lower(label)
    marked = pool.filter(lower.isin("fake", "real")).withColumns(
        {
            "_side": lower,
            "_group": F.when(lower == "fake", F.coalesce(group, F.lit(""))).otherwise(F.lit("")),
        }
    )
    counts = settle(marked.groupBy("_side", "_group").agg(F.count(F.lit(1)).alias("_n")), "counts")
    fake = counts.filter((F.col("_side") == "fake") & (F.col("_n") >= min_pool)).select(
        "_side", "_group", F.least(F.lit(per_group), F.col("_n")).cast("bigint").alias("quota")
    )
    real = fake.agg(F.coalesce(F.sum("quota"), F.lit(0)).cast("bigint").alias("quota")).select(
        F.lit("real").alias("_side"), F.lit("").alias("_group"), "quota"
    )
    flagged = mark_first(
        marked, key, seed, quotas=fake.unionByName(real), groups=["_side", "_group"], name="_test"
    )
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop(
        "_side", "_group", "_test"
    )


def balance_by_source(
    df: DataFrame, source: str, key: str, seed: int, model: str = "model", label: str = "label"
) -> DataFrame:
    """Drop real rows of one named source until real is not more than fake, if it can."""
    lower = F.lower(label)
    counts = df.agg(
        F.count_if(lower == "real").alias("real"), F.count_if(lower == "fake").alias("fake")
    ).first()
    excess = counts["real"] - counts["fake"]
    if excess <= 0:
        return df
    side = F.coalesce((lower == "real") & (F.col(model) == source), F.lit(False)).cast("string")
    quotas = df.sparkSession.range(1).select(
        F.lit("true").alias("_side"), F.lit(excess).alias("quota")
    )
    marked = mark_first(
        df.withColumn("_side", side), key, seed, quotas=quotas, groups=["_side"], name="_drop"
    )
    return marked.filter(~F.col("_drop")).drop("_side", "_drop")


def stratified_sample(df: DataFrame, label: str, n: int, key: str, seed: int) -> DataFrame:
    """n rows with equal quotas per label; the first labels take the remainder.

    Labels that are short leave room that other labels' rows fill at random. One label gives a
    plain sample, a table of at most n rows comes back whole.
    """
    counts = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), "strata")
    shape = counts.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("labels")).first()
    if (shape["rows"] or 0) <= n:
        return df
    if shape["labels"] < 2:
        return sample_n(df, n, key, seed)
    place = F.row_number().over(Window.orderBy(label))  # one row per label
    base, rest = divmod(n, shape["labels"])
    quotas = counts.withColumn(
        "quota", F.least(F.lit(base) + (place <= rest).cast("int"), F.col("_n"))
    )
    short = n - quotas.agg(F.sum("quota").alias("q")).first()["q"]
    first = mark_first(df, key, seed, quotas=quotas, groups=[label], name="_first")
    if short == 0:
        return first.filter("_first").drop("_first")
    fill = first.sparkSession.range(1).select(F.lit(False).alias("_first"), F.lit(short).alias("quota"))
    both = mark_first(first, key, f"{seed}/fill", quotas=fill, groups=["_first"], name="_fill")
    return both.filter("_first or _fill").drop("_first", "_fill")


def train_val_split(df: DataFrame, fraction: float, key: str, seed: int) -> DataFrame:
    """Adds `split`: exactly max(1, int(rows * fraction)) validation rows."""
    n = max(1, int(row_count(df) * fraction))
    return (
        mark_first(df, key, seed, n=n, name="_val")
        .withColumn("split", F.when(F.col("_val"), "val").otherwise("train"))
        .drop("_val")
    )


def trim_plan(counts: DataFrame, excess: int, group: str) -> DataFrame:
    """Per group `drop` and `quota` (rows kept): whole largest groups first, then part of the next.

    `counts` is (group, `n`), one row per group.
    """
    by_size = Window.orderBy(F.desc("n"), group)
    before = F.coalesce(
        F.sum("n").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    drop = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(excess) - before))
    return counts.withColumn("drop", drop).withColumn("quota", F.col("n") - F.col("drop"))


def trim_largest(
    df: DataFrame, target: int, group: str, key: str, seed: int
) -> tuple[DataFrame, DataFrame]:
    """(`target` rows, removed rows per group): the largest groups are cut away first."""
    counts = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")), "sizes")
    excess = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) - target
    plan = settle(trim_plan(counts, max(0, excess), group), "trim")
    kept = df if excess <= 0 else (
        mark_first(df, key, seed, quotas=plan, groups=[group]).filter("picked").drop("picked")
    )
    return kept, plan.filter(F.col("drop") > 0).select(group, F.col("drop").alias("removed"))


def max_feasible(a: int, b: int) -> int:
    """Largest n for which n // 2 rows of the first pool (or all) and the rest of the second do."""
    return b + min(a, b)


def pool_quota_sample(
    first: DataFrame, second: DataFrame, n: int, key: str, seed: int
) -> DataFrame:
    """n rows: min(n // 2, size) of the first pool, the rest of the second; tagged `pool`."""
    a, b = row_count(first), row_count(second)
    from_first = min(n // 2, a)
    from_second = n - from_first
    if from_second > b:
        raise ValueError(f"not enough rows: first={a} second={b} need={n}")
    return (
        sample_n(first, from_first, key, seed)
        .withColumn("pool", F.lit("first"))
        .unionByName(sample_n(second, from_second, key, seed).withColumn("pool", F.lit("second")))
    )


def three_way_holdout(
    df: DataFrame,
    held: Sequence[str],
    families: Sequence[tuple[str, str]] = (),
    model: str = "model",
    label: str = "label",
) -> DataFrame:
    """Adds `match` and `bucket`: pool, held_test, dropped, or held_real.

    No match stays in the pool; an exact name that is fake is held-out test data; similar names
    are dropped. Real rows under an exact name are kept apart and can be counted.
    """
    name = F.lower(strip(F.coalesce(model, F.lit(""))))
    exact = name == F.col("match")
    return df.withColumn("match", held_out_match(model, held, families)).withColumn(
        "bucket",
        F.when(F.col("match").isNull(), "pool")
        .when(~exact, "dropped")
        .when(F.lower(label) == "fake", "held_test")
        .otherwise("held_real"),
    )


def cycle_prompts(prompts: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n prompts with `position` 0..n-1; each pass over the list is a fresh permutation."""
    size = row_count(prompts)
    if size == 0:
        raise ValueError("no prompts to cycle over")
    epochs = -(-n // size)
    passes = prompts.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    seeds = F.concat(F.lit(f"{seed}/"), F.col("epoch").cast("string"))
    return (
        hash_rank(passes, key, seeds, groups=["epoch"], name="_r")
        .withColumn("position", F.col("epoch").cast("bigint") * F.lit(size) + F.col("_r"))
        .filter(F.col("position") < n)
        .drop("_r", "epoch")
    )


def weighted_choice(key: str, choices: Mapping[str, float], seed: int, p: float = 1.0) -> Column:
    """One of the choices per row, by weight; null for rows left alone (probability 1 - p)."""
    if abs(sum(choices.values()) - 1.0) > 1e-6:
        raise ValueError(f"weights must sum to 1, got {sum(choices.values()):.4f}")
    draw, upto, chain = uniform(f"{seed}/choice", key), 0.0, None
    names = list(choices)
    for name in names[:-1]:
        upto += choices[name]
        test = draw < F.lit(upto)
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    chosen = F.lit(names[-1]) if chain is None else chain.otherwise(names[-1])
    return F.when(uniform(f"{seed}/apply", key) <= F.lit(p), chosen)


# Codec weights and parameter ranges of the compression plan.
CODEC_WEIGHTS = {"jpeg": 0.45, "webp": 0.20, "avif": 0.10, "resize_jpeg": 0.10, "none": 0.15}
QUALITY_RANGES = {"jpeg": (55, 95), "webp": (65, 90), "avif": (40, 80), "resize_jpeg": (65, 85)}
SECOND_JPEG = (0.3, (50, 85))
LOSSLESS_WEBP = 0.05
LONG_EDGE = (720, 1080)


def compression_plan(df: DataFrame, key: str, seed: int, p: float = 1.0) -> DataFrame:
    """Adds `codec`, `quality`, `second_quality`, `long_edge`: what to do to each sample.

    The pixels are the caller's business; the plan depends on seed and key only.
    """
    codec = F.col("codec")
    quality = None
    for name, (low, high) in QUALITY_RANGES.items():
        value = uniform_int(f"{seed}/{name}", key, low, high)
        quality = F.when(codec == name, value) if quality is None else quality.when(codec == name, value)
    lossless = (codec == "webp") & (uniform(f"{seed}/lossless", key) < LOSSLESS_WEBP)
    twice = (codec == "jpeg") & (uniform(f"{seed}/double", key) < SECOND_JPEG[0])
    return df.withColumn("codec", weighted_choice(key, CODEC_WEIGHTS, seed, p)).withColumns(
        {
            "quality": F.when(~F.coalesce(lossless, F.lit(False)), quality),
            "second_quality": F.when(twice, uniform_int(f"{seed}/second", key, *SECOND_JPEG[1])),
            "long_edge": F.when(codec == "resize_jpeg", uniform_int(f"{seed}/edge", key, *LONG_EDGE)),
        }
    )
