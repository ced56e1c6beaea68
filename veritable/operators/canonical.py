"""Bringing metadata of any origin to the canonical six-column table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.labels import FAKE_WORDS, label_to_int, normalize_label
from veritable.functions.media import (
    archive_key,
    asset_url,
    extension_of,
    file_stem,
    resolve_path,
    safe_id,
    url_kind,
)
from veritable.operators.ranking import even_frames, global_index
from veritable.operators.sampling import sample_n
from veritable.schemas import SAMPLES

# Column names other datasets use, first one present wins.
ALIASES = {
    "file_name": ("file_name", "filename", "image_path", "path"),
    "prompt": ("prompt", "generated_prompt", "caption", "text"),
    "label": ("label", "labels", "class", "target", "is_fake"),
    "model": ("model", "generator", "model_name", "source"),
    "type": ("type", "format", "media_type"),
    "release_date": ("release_date", "timestamp", "post_date", "date"),
}


# Names of columns that hold an image.
IMAGE_ALIASES = ("image", "img", "jpg", "png")


def first_present(df: DataFrame, aliases: Sequence[str], default: str | None = None) -> Column:
    """First alias that is a column of `df` and not null in the row; `""` counts as present."""
    found = [F.col(a).cast("string") for a in aliases if a in df.columns]
    return F.coalesce(*found, F.lit(default).cast("string"))


def filled(c: Column, *fallbacks: Column | str) -> Column:
    """First of the columns that is neither null nor empty."""
    rest = [f if isinstance(f, Column) else F.lit(f) for f in fallbacks]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in [c, *rest[:-1]]], rest[-1])


def canonicalize(
    df: DataFrame,
    config: str,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    vocabulary: Sequence[str] = FAKE_WORDS,
    image_folder: str | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """The six text columns. A table without a path or label column is an error, and so is a row
    in which both are empty (raised while the rows are read).

    Rows that carry an image instead of a path get the path `<image_folder>/<index>.jpg`, where the
    index counts all rows in `order` (which must identify rows) and has nine digits.
    """
    images = [a for a in IMAGE_ALIASES if a in df.columns]
    if images and image_folder is not None:
        if not order:
            raise ValueError("rows with images need an order")
        # Rows are ranked with a flag in place of their images, which would all be shuffled.
        flag = F.coalesce(*[F.col(a) for a in images]).isNotNull()
        wanted = {*order, *(a for names in aliases.values() for a in names)}
        df = global_index(df.withColumn("_image", flag).drop(*{*images} - wanted), order, "_index")
    elif not any(a in df.columns for a in aliases["file_name"]):
        raise ValueError(f"no file_name column; found {', '.join(sorted(df.columns))}")
    if not any(a in df.columns for a in aliases["label"]):
        raise ValueError(f"no label column; found {', '.join(sorted(df.columns))}")
    raw = first_present(df, aliases["label"], "")

    def label_of(alias: str) -> Column:
        """The label by the alias' own type; null where the alias is null."""
        numeric = isinstance(df.schema[alias].dataType, T.NumericType | T.BooleanType)
        value = F.col(alias).cast("int") if numeric else F.col(alias)
        return F.when(F.col(alias).isNotNull(), normalize_label(value, vocabulary, numeric))

    label = F.coalesce(*[label_of(a) for a in aliases["label"] if a in df.columns])

    def required(value: Column, what: str) -> Column:
        return F.when(value != "", value).otherwise(F.raise_error(F.lit(f"row without {what}")))

    path = first_present(df, aliases["file_name"], "")
    if images and image_folder is not None:
        name = F.concat(F.lit(f"{image_folder}/"), F.lpad(F.col("_index").cast("string"), 9, "0"), F.lit(".jpg"))
        path = F.when(F.col("_image"), name).otherwise(path)
    return df.select(
        required(path, "path").alias("file_name"),
        first_present(df, aliases["prompt"], "").alias("prompt"),
        F.when(required(raw, "label") != "", label).alias("label"),
        filled(first_present(df, aliases["model"]), config).alias("model"),
        filled(first_present(df, aliases["type"]), "image").alias("type"),
        F.substring(first_present(df, aliases["release_date"], ""), 1, 10).alias("release_date"),
    )


def conform(df: DataFrame, schema: T.StructType = SAMPLES, fill: str | None = "") -> DataFrame:
    """Columns of `schema`, in its order; missing columns added, nulls filled (None: kept)."""
    out = []
    for field in schema.fields:
        if field.name in df.columns:
            c = F.col(field.name).cast(field.dataType)
        else:
            c = F.lit(None).cast(field.dataType)
        if fill is not None and isinstance(field.dataType, T.StringType):
            c = F.coalesce(c, F.lit(fill))
        out.append(c.alias(field.name))
    return df.select(*out)


@dataclass(frozen=True)
class StemRange:
    """Real files whose numeric stem lies in [low, high] come from `model`."""

    low: int
    high: int
    model: str
    type: str = "real"
    path_like: str | None = None


def retag_provenance(
    df: DataFrame, ranges: Sequence[StemRange], generic: str = "real", generic_model: str = "laion"
) -> DataFrame:
    """Correct source and type of real rows by file number; then name the generic source."""
    real = F.lower("label") == "real"
    digits = F.regexp_extract(file_stem("file_name"), r"^(\d+)$", 1)
    number = digits.try_cast("decimal(38,0)")
    model, kind = F.col("model"), F.col("type")
    for r in ranges:
        hit = F.coalesce(real & number.between(r.low, r.high), F.lit(False))
        if r.path_like is not None:
            hit = hit & F.col("file_name").like(r.path_like)
        model = F.when(hit, r.model).otherwise(model)
        kind = F.when(hit, r.type).otherwise(kind)
    named = F.when(real & (F.lower(model) == generic), generic_model).otherwise(model)
    return df.withColumns({"model": named, "type": kind})


def load_samples(
    df: DataFrame,
    root: str,
    path_col: str = "file_name",
    label_col: str | None = "label",
    prefix: str | None = None,
    default_label: int = 0,
    default_model: str = "",
) -> DataFrame:
    """(`file_name`, `label` 0/1, `model`) of a split, with defaults for absent columns."""
    has_label = label_col is not None and label_col in df.columns
    return df.select(
        resolve_path(F.col(path_col), root, prefix).alias("file_name"),
        (label_to_int(label_col) if has_label else F.lit(default_label)).alias("label"),
        (F.coalesce("model", F.lit("")) if "model" in df.columns else F.lit(default_model)).alias("model"),
    )


def adapt_flat(
    df: DataFrame,
    name: str,
    label: Column,
    models: Sequence[str],
    default_model: str,
    type_tag: str,
    root: str,
    prompt: str | None = None,
) -> DataFrame:
    """A flat external benchmark in canonical columns; empty model names fall through."""
    return df.select(
        F.concat(F.lit(root.rstrip("/") + "/"), F.coalesce(F.col(name), F.lit(""))).alias("file_name"),
        (F.coalesce(F.col(prompt), F.lit("")) if prompt else F.lit("")).alias("prompt"),
        label.alias("label"),
        filled(F.col(models[0]), *[F.col(m) for m in models[1:]], default_model).alias("model"),
        F.lit(type_tag).alias("type"),
        F.lit("").alias("release_date"),
    )


def adapt_keyed_archive(
    df: DataFrame, key: str, url: str, root: str, type_tag: str, extension: str = ".png"
) -> DataFrame:
    """An archive keyed by path: masks dropped, label by URL, model from the first key segment."""
    url_text = F.coalesce(F.col(url), F.lit(""))
    key_text = F.coalesce(F.col(key), F.lit(""))
    real = url_text.contains("original")
    return df.filter(~url_text.contains("mask")).select(
        F.concat(F.lit(root.rstrip("/") + "/"), archive_key(key_text), F.lit(extension)).alias("file_name"),
        F.lit("").alias("prompt"),
        F.when(real, "real").otherwise("fake").alias("label"),
        F.when(real, "real").otherwise(F.get(F.split(key_text, "/"), F.lit(0))).alias("model"),
        F.lit(type_tag).alias("type"),
        F.lit("").alias("release_date"),
    )


def adapt_metadata_csv(
    df: DataFrame, root: str, type_tag: str, n: int, seed: int, key: str = "file_name"
) -> DataFrame:
    """Rows of one type (any case), paths made absolute, capped by a seeded sample."""
    rows = df.filter(F.lower("type") == type_tag.lower()).withColumn(
        "file_name", resolve_path("file_name", root)
    )
    return conform(sample_n(rows, n, key, seed))


def generation_records(
    manifest: DataFrame,
    order: Sequence[str],
    model: str,
    model_type: str,
    release_date: str,
    run_date: str,
    image_base: str,
    mask_base: str,
    default_prompt: str = "a realistic replacement",
) -> DataFrame:
    """One provenance row per generated output, numbered in manifest order."""
    safe = model.replace("/", "_")
    rows = global_index(manifest, order, "_i")
    prompt = F.col("generated_prompt") if "generated_prompt" in manifest.columns else F.lit(None)
    return rows.select(
        F.concat(F.lit(f"inpaint_{safe}_{run_date}_"), F.col("_i").cast("string"), F.lit(".png")).alias("filename"),
        F.coalesce(prompt, F.lit(default_prompt)).alias("prompt"),
        F.lit("fake").alias("label"),
        F.lit(model).alias("model"),
        F.lit(model_type).alias("type"),
        F.lit(release_date).alias("release_date"),
        F.concat(F.lit(image_base + "/"), F.col("ImageID"), F.lit(".jpg")).alias("source_image_url"),
        asset_url("MaskPath", mask_base).alias("mask_url"),
        F.col("MaskPath").alias("mask_path"),
        F.col("ClassName").alias("class_name"),
    )


def batch_records(
    prompts: DataFrame, index: str, model: Column, model_type: Column, release_date: Column, run_date: str
) -> DataFrame:
    """Provenance rows of plain text-to-image outputs, staged and not yet packaged."""
    return prompts.select(
        F.concat(F.lit("hf_"), safe_id(model), F.lit(f"_{run_date}_"), F.col(index).cast("string"), F.lit(".png")).alias("filename"),
        F.col("prompt"),
        F.lit("fake").alias("label"),
        model.alias("model"),
        model_type.alias("type"),
        release_date.alias("release_date"),
        F.lit(False).alias("packaged"),
    )


def post_records(
    posts: DataFrame, channels: DataFrame, prefix: str = "reddit", frames: int = 15
) -> DataFrame:
    """Posts to file rows: one per image, one per video frame; other posts give none.

    `posts` is (`id`, `channel`, `created` timestamp, `url`, `is_video`, `total_frames`);
    `channels` is (`channel` lower-cased, `label`).
    """
    based = posts.withColumns(
        {
            "subreddit": F.lower("channel"),
            "post_date": F.to_date("created"),
        }
    ).withColumn(
        "_base",
        F.concat_ws(
            "_", F.lit(prefix), "subreddit", F.date_format("created", "yyyy-MM-dd"), F.col("id").cast("string")
        ),
    )
    image = url_kind("url", ("jpg", "jpeg", "png")) == "image"
    images = based.filter(image).withColumn("filename", F.concat("_base", extension_of("url")))
    clips = even_frames(based.filter(~image & F.col("is_video")), "total_frames", frames).withColumn(
        "filename", F.concat(F.col("_base"), F.lit("_frame_"), F.col("frame").cast("string"), F.lit(".jpg"))
    )
    columns = ["filename", "subreddit", "post_date", F.col("id").cast("string").alias("reddit_id")]
    rows = images.select(*columns).unionByName(clips.select(*columns))
    labels = channels.select(F.lower("channel").alias("subreddit"), "label")
    return rows.join(labels, "subreddit").select(
        "filename", "label", "subreddit", "post_date", "reddit_id", F.lit(False).alias("packaged")
    )
