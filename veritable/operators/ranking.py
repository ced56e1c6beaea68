"""Row numbers, cuts and top-n at any table size.

No function here sorts a whole table, or a whole group, in one task. Two ideas carry them all:

* **rank** - rows are dealt into ordered buckets, each bucket is ranked on its own, and a table
  of bucket totals supplies the offsets;
* **cut** - to take the first n rows of a group only the n-th row has to be found. Bucket counts
  say which bucket holds it, that bucket alone is ranked, and the whole table is then filtered
  against one cut value per group without being shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column, hash_prefix, order_hash
from veritable.operators.ranges import narrow_keys, split_points, with_range
from veritable.session import settle


BUCKET_ROWS = 100_000


def bucket_digits(rows: int) -> int:
    """Hex digits with which a bucket holds at most about BUCKET_ROWS rows, were all in one group."""
    digits = 2
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def group_key(groups: Sequence[str]) -> Column:
    """One text key for any number of group columns; null and every text are told apart.

    Each value stands after its length, so no value can run into the next.
    """
    texts = [F.col(g).cast("string") for g in groups]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.concat(*parts) if parts else F.lit("")


# ---------------------------------------------------------------- ranks


def _ranked(df: DataFrame, slim: DataFrame, groups: list[str], bucket: str, order: list[Column], name: str):
    """Ranks the rows of `df`; `slim` holds group and bucket of the same rows."""
    offsets = (
        slim.groupBy(*groups, bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_offset",
            F.sum("_n").over(Window.partitionBy(*groups).orderBy(bucket)) - F.col("_n"),
        )
        .drop("_n")
    )
    local = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order))
    return (
        df.join(offsets, [*groups, bucket])
        .withColumn(name, F.col("_offset") + local - F.lit(1))
        .drop("_offset", bucket)
    )


def hash_rank(
    df: DataFrame,
    key: str,
    seed: int | str | Column,
    groups: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """0-based position of each row in the seeded random order, per group or over the table."""
    hashed = df.withColumns(
        {
            "_g": group_key(groups),
            "_h": order_hash(seed, key),
        }
    )
    # Only two digits more than the least are ever needed below 25 million rows; the first are kept.
    slim = settle(hashed.select("_g", hash_prefix(F.col("_h"), 8).alias("_prefix")), "ranks")
    digits = bucket_digits(slim.count())
    slim = slim.select("_g", F.substring("_prefix", 1, digits).alias("_bucket"))
    hashed = hashed.withColumn("_bucket", hash_prefix(F.col("_h"), digits))
    return _ranked(hashed, slim, ["_g"], "_bucket", [F.col("_h"), F.col(key)], name).drop("_g", "_h")


def global_index(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """Contiguous 0-based index over an ascending order; `order` must identify rows."""
    order = list(order)
    keys = narrow_keys(df, order)
    splits = split_points(keys, order, keys.count())
    columns = [F.col(c) for c in order]
    if splits.ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*columns)).cast("long") - 1)
    return _ranked(splits.number(df, "_bucket"), splits.number(keys, "_bucket"), [], "_bucket", columns, name)


# ---------------------------------------------------------------- cuts


def _edges(slim: DataFrame, quotas: DataFrame) -> DataFrame:
    """Per group: the bucket that holds row number `_quota`, and its position inside it."""
    upto = F.sum("_n").over(Window.partitionBy("_g").orderBy("_bucket"))
    counts = slim.groupBy("_g", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    held = (F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))
    return (
        counts.withColumn("_upto", upto)
        .join(quotas, "_g")
        .filter(held)
        .select("_g", "_bucket", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )


def _pick_n(keyed: DataFrame, slim: DataFrame, n: int, name: str) -> DataFrame:
    """Flag the first n rows of the whole table; the cut reaches the plan as a literal.

    `slim` holds bucket and order of the same rows.
    """
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    edge = (
        slim.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_upto", upto)
        .filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n))
        .first()
        if n > 0
        else None
    )
    if n <= 0 or edge is None:  # nothing wanted, or fewer rows than wanted
        picked = F.lit(n > 0)
    else:
        place = F.row_number().over(Window.orderBy("_o"))
        cut = (
            slim.filter(F.col("_bucket") == edge["_bucket"])
            .withColumn("_place", place)
            .filter(F.col("_place") == n - edge["_upto"] + edge["_n"])
            .first()["_o"]
        )
        fields = keyed.schema["_o"].dataType.fields
        picked = F.col("_o") <= F.struct(*[F.lit(cut[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    return keyed.withColumn(name, picked).drop("_o")


def _pick_quotas(keyed: DataFrame, slim: DataFrame, quotas: DataFrame, name: str) -> DataFrame:
    """Flag the first `_quota` rows of each group `_g`; one cut row per group is joined back.

    The cut table is written first, so its size is known: it is broadcast when small, and the
    table being flagged is then not shuffled at all.
    """
    quotas = quotas.select("_g", F.col("_quota").cast("bigint").alias("_quota"))
    edges = settle(quotas.join(_edges(slim, quotas), "_g", "left"), "edges")
    place = F.row_number().over(Window.partitionBy("_g").orderBy("_o"))
    found = (
        slim.join(edges.filter("_need is not null").drop("_quota"), ["_g", "_bucket"])
        .withColumn("_place", place)
        .filter(F.col("_place") == F.col("_need"))
        .select("_g", F.col("_o").alias("_cut"))
    )
    cuts = settle(edges.select("_g", "_quota").join(found, "_g", "left"), "cuts")
    return (
        keyed.join(cuts, "_g", "left")
        .withColumn(
            name,
            (F.coalesce(F.col("_quota"), F.lit(0)) > 0)
            & (F.col("_cut").isNull() | (F.col("_o") <= F.col("_cut"))),
        )
        .drop("_g", "_o", "_quota", "_cut")
    )


def mark_first(
    df: DataFrame,
    key: str,
    seed: int | str,
    n: int | None = None,
    quotas: DataFrame | None = None,
    groups: Sequence[str] = (),
    name: str = "picked",
) -> DataFrame:
    """Flag the first rows in random order: `n` of the table, or `quota` rows of each group.

    `quotas` has the group columns and `quota`; groups without a line get no row.
    """
    h = order_hash(seed, key)
    order = F.struct(h.alias("h"), as_column(key).alias("k"))
    keyed = df.withColumn("_o", order).withColumn("_g", group_key(groups))
    # Groups and keys are written once; all counting and cutting is done on them, and the rows
    # themselves are read once more to be flagged.
    slim = settle(keyed.select("_g", "_o"), "order")
    slim = slim.withColumn("_bucket", hash_prefix(F.col("_o.h"), bucket_digits(slim.count())))
    if quotas is None:
        return _pick_n(keyed.drop("_g"), slim, n, name)
    quotas = quotas.select(group_key(groups).alias("_g"), F.col("quota").alias("_quota"))
    return _pick_quotas(keyed, slim, quotas, name)


def head_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first `n` rows of an ascending order that identifies rows; any n."""
    order = list(order)
    at = F.struct(*order)
    slim = with_range(narrow_keys(df, order), order, "_bucket").withColumn("_o", at)
    return _pick_n(df.withColumn("_o", at), slim, n, "_picked").filter("_picked").drop("_picked")


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], n: int
) -> DataFrame:
    """The first `n` rows of each group for a small literal n.

    Spark trims every group to n rows before the shuffle (window group limit), so a group that
    holds a third of the table sends only n rows per input partition.
    """
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


# ---------------------------------------------------------------- order of appearance


def first_seen_order(
    df: DataFrame, key: str, order: str, known: DataFrame | None = None
) -> DataFrame:
    """Distinct non-empty values with their rank of first appearance.

    Values that only `known` has come after all seen ones, by name. The distinct values are numbered
    range by range.
    """
    seen = df.filter(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).agg(
        F.min(order).alias("first_seen")
    )
    if known is not None:
        seen = seen.join(known.select(key).distinct(), key, "full_outer")
    seen = settle(seen, "seen").withColumn("_later", F.col("first_seen").isNull())
    return global_index(seen, ["_later", "first_seen", key], "position").drop("_later")


def display_order(
    rows: DataFrame, source: str, label: str, block: str, position: str, block_order: list[str]
) -> DataFrame:
    """Sources folded into display rows: fixed block order, then unknown blocks as first seen.

    Input and output have one row per source at most; `separator` marks rows that start a new
    block where a rule line belongs (never around a video block, nor between two single rows).
    """
    fixed = F.create_map(*[x for i, b in enumerate(block_order) for x in (F.lit(b), F.lit(i))])
    blocks = rows.groupBy(block).agg(F.min(position).alias("_block_seen"))
    folded = rows.groupBy(block, label).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(position, source))), lambda r: r[source]),
            ",",
        ).alias("sources")
    )
    ranked = folded.join(blocks, block).withColumns(
        {
            "_rank": F.coalesce(F.get(F.map_values(F.map_filter(fixed, lambda k, v: k == F.col(block))), F.lit(0)), F.lit(len(block_order)) + F.col("_block_seen")),
            "_size": F.count(F.lit(1)).over(Window.partitionBy(block)),
        }
    )
    line = Window.orderBy("_rank", F.lower(label), label)
    before, before_size = F.lag(block).over(line), F.lag("_size").over(line)
    video = F.lit("Video")
    return ranked.select(
        (F.row_number().over(line) - F.lit(1)).alias("line"),
        block,
        label,
        "sources",
        F.coalesce(
            (before != F.col(block))
            & (before != video)
            & (F.col(block) != video)
            & ((before_size > 1) | (F.col("_size") > 1)),
            F.lit(False),
        ).alias("separator"),
    )


def even_frames(
    df: DataFrame,
    total: str,
    k: int,
    float_step: bool = False,
    distinct: bool = False,
) -> DataFrame:
    """Explode each row into `frame` (slot number) and `position` (frame to read).

    Whole step: total div k, positions clipped to the last frame. Float step: total / k, positions
    past the end dropped. `distinct` drops repeats of the last frame in short inputs.
    """
    n = F.col(total)
    slots = F.sequence(F.lit(0), F.lit(k - 1))
    if float_step:
        step = F.greatest(F.lit(1.0), n / F.lit(float(k)))
        picks = F.transform(slots, lambda i: F.struct(i.alias("frame"), F.floor(i * step).cast("int").alias("position")))
        picks = F.filter(picks, lambda p: p["position"] < n)
    else:
        step = F.greatest(F.lit(1), F.floor(n / F.lit(k)).cast("int"))
        last = (n - F.lit(1)).cast("int")
        picks = F.transform(slots, lambda i: F.struct(i.alias("frame"), F.least(i * step, last).alias("position")))
        if distinct:
            picks = F.filter(picks, lambda p: (p["frame"] == 0) | (p["frame"] * step <= last))
    return (
        df.filter(n > 0)
        .withColumn("_pick", F.explode(picks))
        .select(*df.columns, "_pick.frame", "_pick.position")
    )


def rank_detectors(rows: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Detectors with at least one of two metrics, by the better one, best first."""
    best = F.greatest(first, second)
    return rows.filter(best.isNotNull()).withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc(best), F.col(name)))
    )


def round_robin(files: DataFrame, workers: int, order: str) -> DataFrame:
    """File i of the sorted listing goes to worker i mod n."""
    return global_index(files, [order], "_i").withColumn(
        "worker", F.pmod(F.col("_i"), F.lit(workers)).cast("int")
    ).drop("_i")


def slice_shards(df: DataFrame, shards: int, order: Sequence[str]) -> DataFrame:
    """Contiguous slices of total div n rows; the last slice takes the remainder."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.floor(total / F.lit(shards)))
    return global_index(df, order, "_i").withColumn(
        "shard", F.least(F.floor(F.col("_i") / size), F.lit(shards - 1)).cast("int")
    ).drop("_i")
