"""From segment annotations to generator messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.operators.joins import (
    attach_class,
    best_context,
    capped_list,
    distinct_sorted_list,
    first_per_key,
    relationship_text,
)


def segment_contexts(
    segments: DataFrame,
    classes: DataFrame,
    narratives: DataFrame,
    triples: DataFrame,
    triple_order: Sequence[str],
    n: int | None = None,
    segment_order: Sequence[str] = (),
    caption_chars: int = 300,
    cap: int = 8,
) -> DataFrame:
    """Segments with class, `context`, `tier` and `lead`.

    `narratives` is (`image_id`, `caption`, `ordinal`); the three per-image sides are aggregates,
    so each join has one row per image on its right.
    """
    targets = attach_class(segments, classes, n, segment_order)
    captions = first_per_key(narratives, "image_id", "ordinal", "caption", caption_chars).select(
        F.col("image_id").alias("ImageID"), "caption"
    )
    relations = capped_list(
        relationship_text(triples, classes), "ImageID", "triplet", triple_order, cap, "relations"
    )
    named = segments.join(classes.select("LabelName", "ClassName"), "LabelName")
    scene = distinct_sorted_list(named, "ImageID", "ClassName", "objects")
    return best_context(targets, captions, relations, scene)


def message(instructions: str) -> Column:
    """The generator message of a context row: its lead, then the caller's instructions with
    `{target}` replaced by the class name."""
    target = F.coalesce("ClassName", F.lit("nan"))
    body = F.replace(F.lit(instructions), F.lit("{target}"), target)
    return F.concat_ws("\n\n", "lead", body)
