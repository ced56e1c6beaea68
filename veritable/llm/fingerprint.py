"""Document fingerprints by consistent weighted sampling.

A text is its words with their counts as weights. For each of `SAMPLES` samples a word of weight w
draws r and c from Gamma(2, 1) and b from [0, 1), all from a hash of the word, and has

    t = floor(ln(w) / r + b)        ln a = ln(c) - r * (t - b + 1)

The word of the least `a`, with its t, is the sample. Two texts agree in a sample with probability
sum(min(w)) / sum(max(w)), the generalised Jaccard similarity of their counts, so `likeness` (the
share of equal samples) estimates it with a standard error of at most 0.5 / sqrt(SAMPLES).

A Gamma(2, 1) variable is minus the logarithm of a product of two uniform ones, cut from one 64-bit
hash. `ln a` (upper 31 bits) and 32 bits for (word, t) are packed in a long, so a sample is a plain
`min` of longs. Counting and minima run within one row's group of columns, so a
caller that has dealt its rows by a column in `keys` pays no further shuffle.

All work is DataFrame operations.

Defined results: a null text is empty; texts without words have the fingerprint `EMPTY`, alike to
each other and unlike to all others; equal texts have equal fingerprints; rows with equal keys
count as one text, so keys must identify rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.llm.common import settle, words
from veritable.operators.ranges import split_points

SAMPLES = 32
DIGITS = 8  # hex digits of a sample
EMPTY = "empty"
#: Bytes of text of a range in `with_next`.
RANGE_BYTES = 4 << 20


def _sample(k: int) -> Column:
    """ln a and the identity of (word, t), packed; from `h`, `lw`."""
    bits = F.xxhash64("h", F.lit(k))

    def uniform(width: int, at: int) -> Column:
        """An odd whole number: twice the uniform variable, times 2 ** width."""
        return F.shiftrightunsigned(bits, at).bitwiseAND((1 << width) - 1) * 2 + 1

    r = -F.ln(uniform(12, 0) * uniform(12, 12) / float(1 << 26))
    c = -F.ln(uniform(14, 24) * uniform(14, 38) / float(1 << 30))
    b = F.shiftrightunsigned(bits, 52) / 4096.0
    t = F.floor(F.col("lw") / r + b)
    level = ((F.ln(c) - r * (t - b + 1) + 96.0) * (1 << 24)).cast("long")
    # 0x9E3779B1 spreads t over the 32 bits.
    name = F.col("h").bitwiseXOR(t * 0x9E3779B1).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(level, 32).bitwiseOR(name)


def fingerprints(texts: DataFrame, keys: Sequence[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(keys, fingerprint) of the rows that have words; the others are left to `or_empty`."""
    counts = (
        texts.select(*keys, F.explode(words(F.col(text))).alias("word"))
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("n"))
        .select(*keys, F.xxhash64("word").alias("h"), F.ln(F.col("n").cast("double")).alias("lw"))
    )
    least = counts.groupBy(*keys).agg(*[F.min(_sample(k)).alias(f"m{k}") for k in range(samples)])
    digits = [F.lpad(F.lower(F.hex(F.col(f"m{k}").bitwiseAND(0xFFFFFFFF))), DIGITS, "0") for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def or_empty(fingerprint: Column) -> Column:
    return F.coalesce(fingerprint, F.lit(EMPTY))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints, 0 to 1."""
    same = sum(
        (F.substring(a, DIGITS * k + 1, DIGITS) == F.substring(b, DIGITS * k + 1, DIGITS)).cast("int")
        for k in range(samples)
    )
    empty = F.when(a == b, 1.0).otherwise(0.0)
    return F.when((a == EMPTY) | (b == EMPTY), empty).otherwise(same / F.lit(float(samples)))


def with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows in descending id (nulls last, equal ids by text), each with the text that follows.

    (range, place, id, text, next_text, next_range, next_place); the last row is followed by the
    first. Rows are dealt once, by ranges of ids of some RANGE_BYTES of text; split points come in
    levels of bounded size and only steer the load. A range is closed by a copy of the first row of
    the next one; the chain of ranges itself holds their numbers alone.
    """
    plain = docs.select(
        docs[id_column].alias("id"), F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text")
    )
    keys = settle(plain.select("id", F.octet_length("text").cast("long").alias("bytes")), "ids")
    size = keys.agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    splits = split_points(keys, ["id"], size["rows"], max(1, math.ceil((size["bytes"] or 0) / RANGE_BYTES)))
    # Written first, so that its size is known before a plan decides whether texts move to meet it.
    heads = settle(splits.number(keys, "range").groupBy("range").agg(F.max("id").alias("first_id")), "heads")
    line = Window.orderBy(F.col("range").desc())  # one row per range: its number
    last = F.first("range").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    chain = heads.select(F.col("range").alias("before"), F.coalesce(F.lead("range").over(line), last).alias("after"))
    ranged = splits.number(plain, "range")
    first = (F.col("range") == F.col("r")) & F.col("id").eqNullSafe(F.col("first_id"))
    firsts = ranged.join(heads.withColumnRenamed("range", "r"), first).groupBy("range").agg(F.max("text").alias("text"))
    closing = settle(
        firsts.join(settle(chain, "chain"), F.col("range") == F.col("after")).select(
            F.col("before").alias("range"), F.lit(None).cast(keys.schema["id"].dataType).alias("id"), "text", F.col("after").alias("closes")
        ),
        "closing",
    )
    rows = ranged.withColumn("closes", F.lit(None).cast("long")).unionByName(closing).repartition(splits.ranges, "range")
    inside = Window.partitionBy("range").orderBy(
        F.col("closes").asc_nulls_first(), F.col("id").desc_nulls_last(), F.col("text").desc()
    )
    after = F.lead("closes").over(inside)
    return (
        rows.withColumns({
            "place": F.row_number().over(inside),
            "next_text": F.lead("text").over(inside),
            "next_range": F.coalesce(after, F.col("range")),
            "next_place": F.when(after.isNull(), F.row_number().over(inside) + 1).otherwise(1),
        })
        .filter("closes IS NULL")
        .select("range", "place", "id", "text", "next_text", "next_range", "next_place")
    )


def compare_with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: the last third gives way to the next text's start.

    Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs, id_column, text_column).withColumn("edited", edited)
    facts = rows.select(
        "range",
        "place",
        "id",
        "next_range",
        "next_place",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
    )
    kinds = F.posexplode(F.array("text", "edited")).alias("kind", "text")
    # Both fingerprints of a row lie in one partition, so they meet without a shuffle.
    prints = settle(
        fingerprints(rows.select("range", "place", kinds), ["range", "place", "kind"])
        .groupBy("range", "place")
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(n) for k, n in enumerate(("own", "edit"))])
    )
    after = prints.select(F.col("range").alias("r"), F.col("place").alias("p"), F.col("own").alias("after"))
    own, edit, after_ = or_empty(F.col("own")), or_empty(F.col("edit")), or_empty(F.col("after"))
    return (
        settle(facts)
        .join(prints, ["range", "place"], "left")
        .join(after, (F.col("next_range") == F.col("r")) & (F.col("next_place") == F.col("p")), "left")
        .select(
            F.col("id").alias(id_column),
            "n_chars",
            "edited_sha256",
            own.alias("fingerprint"),
            edit.alias("edited_fingerprint"),
            likeness(own, edit).alias("near_edited"),
            likeness(own, after_).alias("near_next"),
        )
    )
