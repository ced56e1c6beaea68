"""File names, URLs, paths and magic bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column

# Extensions by kind of media.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png")
VIDEO_EXTENSIONS = ("mp4", "webm", "mov")


def _ends_in(c: Column, extensions: Sequence[str]) -> Column:
    return F.coalesce(F.lower(c).rlike(r"\.(" + "|".join(extensions) + r")$"), F.lit(False))


def has_extension(c: Column | str, extensions: Sequence[str]) -> Column:
    return _ends_in(as_column(c), extensions)


def url_kind(
    c: Column | str,
    images: Sequence[str] = IMAGE_EXTENSIONS,
    videos: Sequence[str] = VIDEO_EXTENSIONS,
) -> Column:
    c = as_column(c)
    return F.when(_ends_in(c, images), "image").when(_ends_in(c, videos), "video").otherwise("other")


def extension_of(c: Column | str) -> Column:
    """The last `.ext` of the last path segment, case kept; empty when there is none."""
    return F.regexp_extract(as_column(c), r"[^/.](\.[^./]*)$", 1)


def file_stem(c: Column | str) -> Column:
    """Last path segment without its last extension."""
    return F.regexp_replace(F.regexp_extract(as_column(c), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def file_base(c: Column | str) -> Column:
    return F.regexp_extract(as_column(c), r"([^/]*)$", 1)


def sniff_media(payload: Column | str) -> Column:
    """Extension from the first twelve bytes; JPEG when nothing matches."""
    head = F.hex(F.substring(as_column(payload), 1, 12))
    return (
        F.when(head.startswith("FFD8"), ".jpg")
        .when(head.startswith("89504E470D0A1A0A"), ".png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), ".webp")
        .when(F.substring(head, 9, 8) == "66747970", ".avif")
        .otherwise(".jpg")
    )


def parse_staged_name(name: Column | str, prefix: str = "hf_", extension: str = ".png") -> Column:
    """The two ways to read a staged name, as struct(plain, plain_index, dated, date, dated_index).

    `<prefix><id>_<index><ext>` gives `plain`; `<prefix><id>_<date>_<index><ext>` gives `dated`.
    A name that does not fit gives nulls.
    """
    name = as_column(name)
    stem = F.when(
        name.startswith(prefix) & name.endswith(extension),
        F.substr(name, F.lit(len(prefix) + 1), F.length(name) - F.lit(len(prefix) + len(extension))),
    )
    dated = r"^(.*)_(\d{4}-\d{2}-\d{2})_(\d+)$"
    plain = r"^(.*)_(\d+)$"

    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(stem, pattern, i), F.lit(""))

    return F.struct(
        group(plain, 1).alias("plain"),
        group(plain, 2).alias("plain_index"),
        group(dated, 1).alias("dated"),
        group(dated, 2).alias("date"),
        group(dated, 3).alias("dated_index"),
    )


def archive_key(key: Column | str) -> Column:
    return F.replace(as_column(key), F.lit("/"), F.lit("__"))


def safe_id(model: Column | str) -> Column:
    return F.replace(as_column(model), F.lit("/"), F.lit("_"))


def archive_shard(path: Column | str) -> Column:
    """The archive an asset lives in: its first character, lower-cased."""
    return F.lower(F.substring(as_column(path), 1, 1))


def asset_url(path: Column | str, base: str) -> Column:
    """`<base><first char>/<path>`"""
    return F.concat(F.lit(base), archive_shard(path), F.lit("/"), as_column(path))


def resize_target(width: Column | str, height: Column | str, cap: Column | int) -> Column:
    """struct(width, height) after limiting the long edge; aspect kept, at least one pixel."""
    w, h = as_column(width), as_column(height)
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    scale = cap / F.greatest(w, h)
    small = F.greatest(w, h) <= cap

    def side(x: Column) -> Column:
        return F.when(small, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale))).cast("int")

    return F.struct(side(w).alias("width"), side(h).alias("height"))


def resolve_path(path: Column | str, root: str, prefix: str | None = None) -> Column:
    """Absolute paths stay; others are put under the root and the optional prefix."""
    path = as_column(path)
    parts = [F.lit(root.rstrip("/"))] + ([F.lit(prefix)] if prefix else []) + [path]
    return F.when(path.startswith("/"), path).otherwise(F.concat_ws("/", *parts))
