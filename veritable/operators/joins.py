"""Joins of annotations, registries and listings.

All of them are equi joins on a key. Small sides are left to Catalyst: it broadcasts a side only
when its size is known to be under the session threshold, and AQE splits hot keys otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.media import archive_shard, parse_staged_name, safe_id
from veritable.operators.canonical import first_present
from veritable.operators.ranking import head_rows, top_per_group
from veritable.operators.sampling import sample_n
from veritable.session import settle


def attach_class(
    segments: DataFrame, classes: DataFrame, n: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Segments with their class name, unmatched ones kept; optionally the first n rows."""
    rows = segments if n is None else head_rows(segments, n, order)
    return rows.join(classes.select("LabelName", "ClassName"), "LabelName", "left").select(
        "ImageID", "MaskPath", "LabelName", "ClassName"
    )


def relationship_text(triples: DataFrame, classes: DataFrame, unknown: str = "Object") -> DataFrame:
    """Adds `triplet`, "A relation B"; unknown labels read `Object`."""
    first = classes.select(F.col("LabelName").alias("LabelName1"), F.col("ClassName").alias("_a"))
    second = classes.select(F.col("LabelName").alias("LabelName2"), F.col("ClassName").alias("_b"))
    relation = first_present(triples, ["RelationshipLabel", "RelationLabel"])
    return (
        triples.withColumn("_rel", relation)
        .join(first, "LabelName1", "left")
        .join(second, "LabelName2", "left")
        .withColumn(
            "triplet",
            F.concat(
                F.coalesce("_a", F.lit(unknown)), F.lit(" "), "_rel", F.lit(" "), F.coalesce("_b", F.lit(unknown))
            ),
        )
        .drop("_a", "_b", "_rel")
    )


def first_per_key(
    df: DataFrame, key: str, order: str, value: str, max_chars: int | None = None
) -> DataFrame:
    """First non-empty value per key, cut to `max_chars` characters."""
    text = F.min_by(value, order)
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    named = (F.col(key).cast("string") != "") & (F.col(value) != "")
    return df.filter(named).groupBy(key).agg(text.alias(value))


def capped_list(
    df: DataFrame, key: str, value: str, order: Sequence[str], cap: int = 8, name: str = "items"
) -> DataFrame:
    """At most `cap` values per key, in order."""
    kept = top_per_group(df, [key], list(order), cap)
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return kept.groupBy(key).agg(F.transform(ordered, lambda r: r["_v"]).alias(name))


def distinct_sorted_list(df: DataFrame, key: str, value: str, name: str = "items") -> DataFrame:
    """Sorted unique non-null values per key; duplicates go before the list is built."""
    unique = df.filter(F.col(value).isNotNull()).select(key, value).distinct()
    return unique.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(name))


# Openings of the context and of the generator's message, by tier.
CONTEXT = ("Image description: ", "Scene relationships: ", "Objects in the image: ", "Object to replace: ")
LEAD = ("This photo is described as: ", "This photo shows: ", "This photo contains: ", "A photo contains a ")


def best_context(
    segments: DataFrame, narratives: DataFrame, relationships: DataFrame, scene: DataFrame
) -> DataFrame:
    """Adds `context`, `tier` 1-4 and `lead` (the opening of the generator message).

    First available of caption, relationship list, object list, class name. The three sides have
    one row per image: (`ImageID`, `caption`), (`ImageID`, `relations`), (`ImageID`, `objects`).
    """
    target = F.concat(F.lit("\n" + CONTEXT[3]), F.coalesce("ClassName", F.lit("nan")))
    name = F.coalesce("ClassName", F.lit("nan"))
    relations, objects = F.array_join("relations", "; "), F.array_join("objects", ", ")
    has = [F.col(c).isNotNull() for c in ("caption", "relations", "objects")]
    quoted = F.concat(F.lit('"'), "caption", F.lit('"'))

    def choose(one: Column, two: Column, three: Column, four: Column) -> Column:
        return F.when(has[0], one).when(has[1], two).when(has[2], three).otherwise(four)

    return (
        segments.join(narratives, "ImageID", "left")
        .join(relationships, "ImageID", "left")
        .join(scene, "ImageID", "left")
        .withColumns(
            {
                "tier": choose(F.lit(1), F.lit(2), F.lit(3), F.lit(4)),
                "context": choose(
                    F.concat(F.lit(CONTEXT[0]), quoted, target),
                    F.concat(F.lit(CONTEXT[1]), relations, target),
                    F.concat(F.lit(CONTEXT[2]), objects, target),
                    F.concat(F.lit(CONTEXT[3]), name),
                ),
                "lead": choose(
                    F.concat(F.lit(LEAD[0]), quoted),
                    F.concat(F.lit(LEAD[1]), relations),
                    F.concat(F.lit(LEAD[2]), objects),
                    F.concat(F.lit(LEAD[3]), name),
                ),
            }
        )
        .drop("caption", "relations", "objects")
    )


def untracked(listing: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key is not recorded yet."""
    return listing.join(tracked.select(key), key, "left_anti")


def match_registry(
    files: DataFrame, registry: DataFrame, name: str, prefix: str = "hf_", extension: str = ".png"
) -> DataFrame:
    """Adds `model` and `date` of the longest registered id that the file name starts with.

    What follows the id must be `_<index>` or `_<date>_<index>`, so a name can be cut in two
    places only; both cuts are looked up by equality and the longer id wins. Files that match
    nothing keep nulls. `registry` is (`model`).
    """
    ids = registry.groupBy(safe_id("model").alias("_safe")).agg(F.max("model").alias("_id"))
    parsed = files.withColumn("_p", parse_staged_name(name, prefix, extension))
    plain = ids.select(F.col("_safe").alias("_s1"), F.col("_id").alias("_m1"))
    dated = ids.select(F.col("_safe").alias("_s2"), F.col("_id").alias("_m2"))
    return (
        parsed.join(plain, F.col("_p.plain") == F.col("_s1"), "left")
        .join(dated, F.col("_p.dated") == F.col("_s2"), "left")
        .withColumns(
            {
                "model": F.coalesce("_m1", "_m2"),
                "date": F.when(F.col("_m1").isNull() & F.col("_m2").isNotNull(), F.col("_p.date")),
            }
        )
        .drop("_p", "_s1", "_m1", "_s2", "_m2")
    )


def required_assets(prompts: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct assets needed and not present."""
    return prompts.select(key).distinct().join(present.select(key), key, "left_anti")


def assets_by_archive(assets: DataFrame, key: str) -> DataFrame:
    return assets.groupBy(archive_shard(key).alias("archive")).agg(F.count(F.lit(1)).alias("assets"))


def align_predictions(samples: DataFrame, predictions: DataFrame, key: str = "file_name") -> DataFrame:
    """Samples and predictions paired by key, with `side`: both, sample_only, prediction_only."""
    left = samples.withColumn("_s", F.lit(True))
    right = predictions.withColumn("_p", F.lit(True))
    return (
        left.join(right, key, "full_outer")
        .withColumn(
            "side",
            F.when(F.col("_s").isNull(), "prediction_only")
            .when(F.col("_p").isNull(), "sample_only")
            .otherwise("both"),
        )
        .drop("_s", "_p")
    )


def detector_test_matrix(
    detectors: DataFrame, tests: Sequence[str], results: DataFrame
) -> DataFrame:
    """Every detector with every test set; null where no result exists.

    Test sets are a short parameter list: each detector row is exploded over it. Detectors and
    results may come from one plan, so they are written once.
    """
    shared = detectors is results
    results = settle(results, "results")
    detectors = results if shared else detectors
    pairs = detectors.select("detector").distinct().withColumn(
        "test", F.explode(F.array(*[F.lit(t) for t in tests]))
    )
    return pairs.join(results, ["detector", "test"], "left")


def sample_with_assets(
    master: DataFrame, assets: DataFrame, asset_key: str, key: str, model_id: str, n: int
) -> tuple[DataFrame, int]:
    """(n rows whose asset exists, in an order of the model's own; how many are short of n)."""
    usable = master.join(assets.select(asset_key), asset_key, "left_semi")
    available = usable.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return sample_n(usable, n, key, model_id), max(0, n - available)


def locate_asset(
    paths: DataFrame, listing: DataFrame, key: str, layouts: Sequence[Column], located: str = "path"
) -> DataFrame:
    """Adds `found`: the first candidate location that the listing holds, null when none does.

    `layouts` build the candidates from the row, best first.
    """
    candidates = paths.select(key).distinct().select(
        key, F.posexplode(F.array(*layouts)).alias("_priority", located)
    )
    hits = (
        candidates.join(listing.select(located), located, "left_semi")
        .groupBy(key)
        .agg(F.min_by(located, "_priority").alias("found"))
    )
    return paths.join(hits, key, "left")
