"""Mixing sources to target weights by entropy balancing.

Every document may enter a mix 0, 1 or 2 times (`CAP`). Its rate is the mean of an exponentially
tilted Binomial(2, 1/2): `2 / (1 + exp(-lambda * z))`, where z is the document's size over its
source's typical size and lambda the multiplier of the source's token constraint. Among all rates
that meet the constraints these are nearest to the even rate in relative entropy. The multipliers
solve the convex dual; each Newton step is one aggregation over (source, size) counts, guarded by a
bracket so that it converges from any start.

Rates become copies along each source's sizes from the largest down: the running sum of rates is
rounded, so the words taken miss the target by at most half a document, and up to `CORRECTIONS`
single copies, chosen by size, then take up what is missing. Only (source, size) counts are rounded;
documents of one size and source share the copies of their class evenly in hash order. Sums are
integers, so reruns give the same mix.

All work is DataFrame operations. The tables joined to the documents have one row per source, or
per source and size. Classes of over `CLASS_ROWS` documents (copies of one text, say) are ranked in
hash buckets.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 is taken 0 times; equal rows are separate documents; a source whose target is
twice its size is taken twice; an empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import WORD, settle

CAP = 2
UNIT = 1 << 30  # rates are integers in this unit
CLASS_ROWS = 50_000
CORRECTIONS = 4
STEPS = 60


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """(source, source_size, ...) with `target`: shares by weight, none above CAP times the size.

    Reshared excess raises one common level per unit of weight; a source below the level is full.
    The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", weight)
    by_room = Window.orderBy("room", "place")
    total = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(float(share)) * total - F.coalesce(F.col("full"), F.lit(0.0))) / F.col("open")
    return (
        ranked.withColumn("room", CAP * F.col("source_size") / F.col("weight"))
        .withColumn("full", F.sum(CAP * F.col("source_size").cast("double")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("open", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("room"), F.struct("room", "place", "level"))).over(Window.partitionBy())["level"])
        .withColumn("target", F.least(CAP * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float("inf")))))
        .drop("place", "weight", "room", "full", "open", "level")
    )


def _rate() -> Column:
    """The tilted rate of a size under the source's multiplier, in units."""
    z = F.col("size") / F.col("scale")
    tilted = F.lit(float(CAP)) / (1 + F.exp(-F.col("tilt") * z))
    full = F.col("target") >= CAP * F.col("source_size")
    rate = F.when(F.col("size") == 0, 0.0).when(full, float(CAP)).otherwise(tilted)
    return F.round(rate * UNIT).cast("long")


def _exact(x: Column) -> Column:
    """A sum of doubles that doesn't hang on the order of rows."""
    return F.sum(F.round(x * 1e6).cast("decimal(38,0)")).cast("double") / 1e6


def balance(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """`sources` with the multiplier `tilt` that meets each target.

    `sizes`: (source, size, n). One aggregation and one row to the driver per Newton step.
    """
    state = settle(
        sources.withColumn("tilt", F.lit(0.0))
        .withColumn("low", F.lit(float("-inf")))
        .withColumn("high", F.lit(float("inf")))
    )
    for _ in range(STEPS):
        unit, z = _rate() / UNIT, F.col("size") / F.col("scale")
        sums = (
            sizes.join(state.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .groupBy("source")
            .agg(
                _exact(F.col("n") * F.col("size") * unit).alias("got"),
                _exact(F.col("n") * unit * (1 - unit / CAP) * z * z).alias("bend"),
            )
        )
        over = (F.col("got") - F.col("target")) / F.col("scale")
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        tilt = F.col("tilt")
        # A step out of the bracket, or with no slope left, halves the bracket or doubles the way.
        middle = (
            F.when(F.col("low") == float("-inf"), F.least(tilt * 2, tilt - 1))
            .when(F.col("high") == float("inf"), F.greatest(tilt * 2, tilt + 1))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        bounded = F.least(F.greatest(-over / F.col("bend"), F.lit(-8.0)), F.lit(8.0))
        stepped = (
            state.join(sums.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
            .drop("of")
            .withColumn("low", F.when(over < 0, F.greatest("low", "tilt")).otherwise(F.col("low")))
            .withColumn("high", F.when(over > 0, F.least("high", "tilt")).otherwise(F.col("high")))
            .withColumn("next", F.when(F.col("bend") > 0, tilt + bounded))
            .withColumn("miss", F.when(F.col("target") < CAP * F.col("source_size"), F.abs(F.col("got") - F.col("target"))).otherwise(0.0))
            .withColumn("tilt", F.when(F.col("miss") < 0.01, tilt).when(inside, F.col("next")).otherwise(middle))
            .drop("next", "got", "bend")
        )
        stepped = settle(stepped)
        worst = stepped.agg(F.max("miss")).first()[0]
        state = stepped.drop("miss")
        if worst is None or worst < 0.01:
            break
    return state


def round_classes(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, size, n) with `copies`: what the documents of the class enter together."""
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    half = F.lit(UNIT // 2)
    whole = lambda x: F.floor((x + half) / UNIT).cast("long")
    classes = (
        sizes.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .drop("of", "low", "high")
        .withColumn("rate", _rate())
        .withColumn("until", F.sum(F.col("n") * F.col("rate")).over(down))
        .withColumn("copies", whole(F.col("until")) - whole(F.col("until") - F.col("n") * F.col("rate")))
        .drop("until")
    )
    for _ in range(CORRECTIONS):
        classes = settle(classes)
        miss = F.round(F.col("target") - F.col("taken")).cast("long")
        gaps = (
            classes.groupBy("source", "target")
            .agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
            .select(F.col("source").alias("of"), miss.alias("miss"))
        )
        room = F.when(F.col("miss") > 0, F.col("copies") < CAP * F.col("n")).otherwise(F.col("copies") > 0)
        better = F.abs(F.col("size") - F.abs("miss")) < F.abs("miss")
        picks = (
            classes.join(gaps, F.col("source").eqNullSafe(F.col("of")))
            .filter((F.col("size") > 0) & room & better)
            .groupBy("of", "miss")
            .agg(F.min(F.struct(F.abs(F.col("size") - F.abs("miss")), F.col("size")))["size"].alias("at"))
        )
        step = F.coalesce(F.signum("miss").cast("long"), F.lit(0).cast("long"))
        classes = (
            classes.join(picks, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")), "left")
            .withColumn("copies", F.col("copies") + step)
            .drop("of", "at", "miss")
        )
    return settle(classes)


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Per row: id, source, size, source_size, target, rate, copies and taken (copies * size)."""
    sized = settle(
        docs.select(
            docs[id_column].alias("id"), docs[source_column].alias("source"), size_of(docs[text_column]).alias("size")
        )
    )
    sizes = settle(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    mass = F.col("n") * F.col("size")
    sources = sizes.groupBy("source").agg(
        F.sum(mass).alias("source_size"),
        F.greatest(F.sum(mass.cast("double") * F.col("size")) / F.greatest(F.sum(mass), F.lit(1)), F.lit(1.0)).alias("scale"),
    )
    classes = round_classes(sizes, balance(sizes, targets(sources, weights, share)))

    spread = F.xxhash64("id", F.lit("mix"))
    bucket = F.pmod(spread, F.floor(F.col("n") / CLASS_ROWS).cast("long") + 1)
    facts = classes.select(F.col("source").alias("of"), F.col("size").alias("at"), "n", "source_size", "target", "rate", "copies")
    dealt = (
        sized.join(facts, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")))
        .drop("of", "at")
        .withColumn("bucket", bucket)
    )
    before = Window.partitionBy("of", "at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.filter(F.col("n") >= CLASS_ROWS)
        .groupBy(F.col("source").alias("of"), F.col("size").alias("at"), F.col("bucket").alias("part"))
        .agg(F.count("*").alias("rows"))
        .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .drop("rows")
    )
    same = (
        F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("at")) & (F.col("bucket") == F.col("part"))
    )
    within = Window.partitionBy("source", "size", "bucket").orderBy(spread, "id")
    upto = F.floor(F.col("place") * F.col("copies") / F.col("n"))
    return (
        dealt.withColumn("place", F.row_number().over(within))
        .join(settle(offsets), same, "left")
        .withColumn("place", F.col("place") + F.coalesce(F.col("offset"), F.lit(0)))
        .withColumn("copies", (upto - F.floor((F.col("place") - 1) * F.col("copies") / F.col("n"))).cast("long"))
        .select(
            F.col("id").alias(id_column),
            F.col("source").alias(source_column),
            "size",
            "source_size",
            "target",
            (F.col("rate") / UNIT).alias("rate"),
            "copies",
            (F.col("copies") * F.col("size")).alias("taken"),
        )
    )
