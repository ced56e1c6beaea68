"""Names of generators: families, display names, variants, release months.

Which names belong to which family changes with every release, so rules are data the caller
supplies; this module only says how they are applied.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column
from veritable.functions.labels import strip
from veritable.functions.text import capital
from veritable.session import settle


@dataclass(frozen=True)
class Rule:
    """A family and how to recognise it; any of the four tests is enough."""

    family: str
    equals: tuple[str, ...] = ()
    starts: tuple[str, ...] = ()
    contains: tuple[str, ...] = ()
    contains_all: tuple[str, ...] = ()

    def matches(self, name: Column) -> Column:
        tests = []
        if self.equals:
            tests.append(name.isin(*self.equals))
        tests += [name.startswith(s) for s in self.starts]
        tests += [name.contains(s) for s in self.contains]
        if self.contains_all:
            every = F.lit(True)
            for s in self.contains_all:
                every = every & name.contains(s)
            tests.append(every)
        found = F.lit(False)
        for test in tests:
            found = found | test
        return found


def dashed(c: Column | str) -> Column:
    return F.replace(as_column(c), F.lit("_"), F.lit("-"))


def family_of(
    model: Column | str,
    rules: Sequence[Rule],
    default: Column | None = None,
    real_sources: Sequence[str] = (),
    real_family: Column | str = "real",
) -> Column:
    """First matching rule on the lower-cased, dashed name; real sources are tested first, raw."""
    model = as_column(model)
    name = F.lower(dashed(model))
    branches = []
    if real_sources:
        family = real_family if isinstance(real_family, Column) else F.lit(real_family)
        branches.append((model.isin(*real_sources), family))
    branches += [(rule.matches(name), F.lit(rule.family)) for rule in rules]
    chain = None
    for test, family in branches:
        chain = F.when(test, family) if chain is None else chain.when(test, family)
    fallback = name if default is None else default
    return fallback if chain is None else chain.otherwise(fallback)


def is_video(model: Column | str, prefixes: Sequence[str]) -> Column:
    name = F.lower(dashed(model))
    found = F.lit(False)
    for prefix in prefixes:
        found = found | name.startswith(prefix)
    return found


def title_words(model: Column | str, upper: Sequence[str] = ("sd", "xl")) -> Column:
    """`stable_diffusion-xl` -> `Stable Diffusion XL`; a `V` before a digit becomes `v`."""
    parts = F.filter(F.split(dashed(model), "-"), lambda p: p != "")
    words = F.transform(
        parts,
        lambda p: F.when(p.isin(*upper), F.upper(p)).otherwise(
            F.concat(capital(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))
        ),
    )
    return F.regexp_replace(F.array_join(words, " "), r"\bV(\d)", "v$1")


def display_names(
    df: DataFrame, model: str, names: DataFrame, upper: Sequence[str] = ("sd", "xl")
) -> DataFrame:
    """Add `display`: looked up by raw name, then by dashed name, else built from the words.

    `names` is (`name`, `display`), one line per name.
    """
    raw = names.select(F.col("name").alias("_raw"), F.col("display").alias("_d1"))
    alt = names.select(F.col("name").alias("_alt"), F.col("display").alias("_d2"))
    return (
        df.join(raw, F.col(model) == F.col("_raw"), "left")
        .join(alt, dashed(model) == F.col("_alt"), "left")
        .withColumn("display", F.coalesce("_d1", "_d2", title_words(model, upper)))
        .drop("_raw", "_d1", "_alt", "_d2")
    )


def variant_tag(kind: Column | str) -> Column:
    kind = F.lower(strip(kind))
    return (
        F.when(kind.isin("finetune", "fine-tune", "ft"), "FT")
        .when(kind == "lora", "LoRA")
        .when(kind.isin("video", "image"), kind)
        .otherwise("base")
    )


def release_month(text: Column | str) -> Column:
    """`YYYY-MM...` -> `YYYY-MM`; other text unchanged; empty -> null."""
    text = as_column(text)
    parts = F.split(strip(text), "-")
    return F.when(
        text != "",
        F.when(F.size(parts) >= 2, F.concat_ws("-", F.get(parts, 0), F.get(parts, 1))).otherwise(text),
    )


def held_out_match(
    model: Column | str, held: Sequence[str], families: Sequence[tuple[str, str]] = ()
) -> Column:
    """Held-out name that the model name contains: longest first, then families in order.

    Held-out names are a short parameter list, so the match is an expression and needs no join.
    """
    name = F.lower(strip(F.coalesce(as_column(model), F.lit(""))))
    ordered = sorted({h.lower() for h in held}, key=lambda h: (-len(h), h))
    tests = [(h, h) for h in ordered] + [(f.lower(), h.lower()) for f, h in families]
    chain = F.when(name == "", F.lit(None).cast("string"))
    for part, result in tests:
        chain = chain.when(name.contains(part), result)
    return chain


GRAM = 4


def _grams(name: Column, length: Column | int) -> Column:
    """All parts of a name that have this length."""
    last = F.length(name) - length + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    size = length if isinstance(length, Column) else F.lit(length)
    return F.array_distinct(F.transform(places, lambda i: F.substring(name, i, size)))


def held_out_join(
    df: DataFrame, held: DataFrame, families: DataFrame | None = None, model: str = "model", name: str = "held_out"
) -> DataFrame:
    """`held_out_match` for lists of any length: `held` is (`name`), `families` (`part`, `result`, `place`).

    Each listed name is found by one of its grams, an equality join with the grams of the distinct
    model names; what it meets is then compared whole. The gram is the one with the least hash, so that
    names which share a common part do not all stand under it. Only grams as long as listed ones are made.

    Catalyst takes the exploded grams to be as small as the names, and would broadcast them through the
    driver; so both sides are sorted and merged.
    """
    spark = df.sparkSession
    lists = held.select(F.lower("name").alias("_part")).distinct().select(
        "_part", F.col("_part").alias("_result"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_place")
    )
    if families is not None:
        lists = lists.unionByName(
            families.select(
                F.lower("part").alias("_part"), F.lower("result").alias("_result"),
                F.lit(1).alias("_kind"), F.col("place").cast("long").alias("_place"),
            )
        )
    lists = lists.filter(F.length("_part") > 0)
    size = F.least(F.length("_part"), F.lit(GRAM))
    hashed = F.transform(_grams(F.col("_part"), size), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g")))
    listed = settle(lists.withColumn("_gram", F.array_min(hashed)["g"]), "listed")
    sizes = [r["n"] for r in listed.select(F.length("_gram").alias("n")).distinct().collect()]  # GRAM of them at most
    models = df.select(F.col(model).alias("_model")).distinct()
    plain = F.lower(strip(F.coalesce(F.col("_model"), F.lit(""))))
    # A number given keeps the names, which take few bytes, in many tasks while they become grams.
    models = models.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = F.flatten(F.array(*[_grams(plain, k) for k in sizes])) if sizes else F.array().cast("array<string>")
    grams = models.select("_model", F.explode(every).alias("_gram")).hint("merge")
    met = grams.join(listed, "_gram").withColumn("_name", plain)
    # Longest name first, then families by place; names of one length by their letters.
    rank = F.struct("_kind", "_place", F.when(F.col("_kind") == 0, -F.length("_part")), "_part")
    best = met.filter(F.contains("_name", "_part")).groupBy("_model").agg(F.min_by("_result", rank).alias(name))
    return df.join(best, df[model] == best["_model"], "left").drop("_model")
