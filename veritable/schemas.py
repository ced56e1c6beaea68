"""Explicit schemas of the tables that flow through the library."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


SAMPLES = T.StructType(
    _strings("file_name", "prompt", "label", "model", "type", "release_date")
)
GENERATED = T.StructType(
    _strings("filename", "prompt", "label", "model", "type", "release_date")
    + [T.StructField("packaged", T.BooleanType())]
)
INPAINTED = T.StructType(
    _strings(
        "filename", "prompt", "label", "model", "type", "release_date",
        "source_image_url", "mask_url", "mask_path", "class_name",
    )
)
POSTS = T.StructType(
    _strings("filename", "label", "subreddit")
    + [T.StructField("post_date", T.DateType())]
    + _strings("reddit_id")
    + [T.StructField("packaged", T.BooleanType())]
)
SEGMENTS = T.StructType(_strings("ImageID", "MaskPath", "LabelName"))
CLASSES = T.StructType(_strings("LabelName", "ClassName"))
NARRATIVES = T.StructType(_strings("image_id", "caption"))
CAPTIONS = T.StructType(_strings("TEXT", "URL", "NSFW"))
PREDICTIONS = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("prob_fake", T.DoubleType()),
        T.StructField("pred", T.IntegerType()),
    ]
)
METRICS = T.StructType(
    [T.StructField("model", T.StringType()), T.StructField("n", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("accuracy", "tpr", "tnr", "f1", "roc_auc")]
)
REGISTRY_ENTRY = T.StructType(_strings("status", "reason", "date"))
