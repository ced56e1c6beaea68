"""Nested feed JSON to flat records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column

# Names under which feeds carry the post list and the page cursor.
POST_LIST_KEYS = ("posts", "items", "results", "data", "generations")
CURSOR_KEYS = ("cursor", "next_cursor", "next", "nextCursor", "next_page")
NESTED_CURSOR_KEYS = ("cursor", "next_cursor", "next")
QUALITIES = ("source", "md", "ld")

_SIZE = "width bigint, height bigint"
_POST = (
    "id string, generation_id string, gen_id string, post_id string, title string, text string, "
    "created_at string, createdAt string, model string, prompt string, actions map<string,string>, "
    "user struct<username string, name string>, author struct<username string, name string>, "
    f"{_SIZE}, encodings map<string, struct<path string, url string, {_SIZE}, duration_secs double>>, "
    "url string, video_url string, videoUrl string, media string, video string, "
    "generation string, generations string"
)
_MEDIA = f"type string, url string, path string, source string, {_SIZE}, duration double, duration_secs double"


def _first(*candidates: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def _media_columns(df: DataFrame, qualities: Sequence[str], hosts: Sequence[str]) -> DataFrame:
    """Ways to the media of the parsed post `_post`: `_best`, `_direct`, `_one`, `_entry`.

    They are columns of their own, so that each is worked out once per row and not once per use.
    """
    post = F.col("_post")
    encoded = F.transform(
        F.array(*[F.lit(q) for q in qualities]),
        lambda q: F.struct(
            q.alias("quality"),
            _first(post["encodings"][q]["path"], post["encodings"][q]["url"]).alias("url"),
            post["encodings"][q]["width"].alias("width"),
            post["encodings"][q]["height"].alias("height"),
            post["encodings"][q]["duration_secs"].alias("duration"),
        ),
    )
    direct = _first(post["url"], post["video_url"], post["videoUrl"])
    usable = direct.endswith(".mp4")
    for host in hosts:
        usable = usable | direct.contains(host)
    media = _first(post["media"], post["video"])
    many = F.from_json(F.when(media.startswith("["), media), f"array<struct<{_MEDIA}>>")
    # In a list the first entry that is a video is taken; one without a type counts as video.
    is_video = lambda m: F.coalesce(m["type"], F.lit("video")) == "video"
    return df.withColumns(
        {
            "_best": F.get(F.filter(encoded, lambda e: e["url"].isNotNull()), F.lit(0)),
            "_direct": F.when(usable, direct),
            "_one": F.from_json(F.when(media.startswith("{"), media), _MEDIA),
            "_entry": F.get(F.filter(many, is_video), F.lit(0)),
        }
    ).withColumn(
        "_nested",
        F.coalesce(
            _first(F.col("_one.url"), F.col("_one.path"), F.col("_one.source")),
            _first(F.col("_entry.url"), F.col("_entry.path")),
        ),
    )


def _hold(df: DataFrame, *names: str) -> DataFrame:
    """Compute the columns here, once per row.

    Later filters and projections would otherwise be rewritten in terms of the parse expressions,
    each use repeating all of them. A one-element explode is not rewritten through.
    """
    kept = [c for c in df.columns if c not in names]
    held = F.explode_outer(F.array(F.struct(*names))).alias("_held")
    return df.select(*kept, held).select(*kept, *[F.col(f"_held.{n}").alias(n) for n in names])


def _inner_post(post: Column) -> Column:
    """The post inside a post: a single generation, or the first of a list."""
    single = F.when(
        post["generation"].startswith("{") & (post["generation"] != "{}"), post["generation"]
    )
    return F.coalesce(single, F.get(F.from_json(post["generations"], "array<string>"), F.lit(0)))


def normalize_posts(
    df: DataFrame,
    text: str,
    hosts: Sequence[str],
    depth: int | None = None,
    qualities: Sequence[str] = QUALITIES,
) -> DataFrame:
    """Nested post JSON to flat records beside the other columns; posts without media are left out
    (`posts_without_media` gives them).

    Looks at encodings by quality, then a direct URL (a video file, or on one of `hosts`), then nested
    media, and when all of them fail goes down to the post inside the post, as often as posts nest.
    `depth` levels are unrolled; without it the deepest nesting is found first, in one pass.
    """
    depth = nesting(df, text) if depth is None else depth
    kept = [c for c in df.columns if c != text]
    out = _hold(df.withColumn("_post", F.from_json(text, _POST)), "_post")
    found = F.col("_url")
    for level in range(depth):
        out = _media_columns(out, qualities, hosts).withColumn(
            "_url", F.coalesce("_best.url", "_direct", "_nested")
        )
        out = _hold(out, "_best", "_direct", "_one", "_entry", "_nested", "_url")
        if level < depth - 1:
            inner = F.when(found.isNull(), _inner_post(F.col("_post")))
            out = _hold(out.withColumn("_inner", inner), "_inner")
            deeper = F.when(F.col("_inner").isNull(), F.col("_post")).otherwise(F.from_json("_inner", _POST))
            out = _hold(out.withColumn("_post", deeper), "_post")
    post = F.col("_post")

    def size(name: str) -> Column:
        other = F.when(F.col("_direct").isNull(), F.coalesce(f"_one.{name}", f"_entry.{name}"))
        encoded = F.col("_best").isNotNull()
        return F.coalesce(F.when(encoded, F.col(f"_best.{name}")).otherwise(other), post[name], F.lit(0))

    return out.filter(found.isNotNull()).select(
        *kept,
        F.coalesce(_first(post["id"], post["generation_id"], post["gen_id"], post["post_id"]), F.lit("unknown")).alias("id"),
        F.coalesce(_first(post["title"], post["text"]), F.lit("")).alias("title"),
        F.coalesce(_first(post["created_at"], post["createdAt"]), F.lit("")).alias("created_at"),
        F.coalesce(post["model"], F.lit("")).alias("model"),
        F.coalesce(
            _first(post["prompt"]), F.array_join(F.map_values(post["actions"]), " | "), post["text"], F.lit("")
        ).alias("prompt"),
        F.coalesce(
            _first(post["user"]["username"], post["user"]["name"], post["author"]["username"], post["author"]["name"]),
            F.lit("unknown"),
        ).alias("creator"),
        found.alias("video_url"),
        F.coalesce("_best.quality", F.lit("unknown")).alias("quality"),
        size("width").alias("width"),
        size("height").alias("height"),
        F.coalesce(
            "_best.duration",
            F.when(F.col("_best").isNull() & F.col("_direct").isNull(), F.coalesce("_one.duration", "_one.duration_secs")),
            F.lit(0.0),
        ).alias("duration"),
    )


def nesting(df: DataFrame, text: str) -> int:
    """Levels of posts inside posts, at most: one more than the names of inner posts in a text."""
    inner = F.regexp_count(F.col(text), F.lit('"generations?"'))
    return 1 + (df.agg(F.max(inner)).first()[0] or 0)


def posts_without_media(df: DataFrame, text: str, key: str, hosts: Sequence[str], **options) -> DataFrame:
    """(key, `reason`) of the rows that `normalize_posts` leaves out; `key` identifies rows."""
    parsed = F.from_json(text, "map<string,string>").isNotNull()
    reason = F.when(F.col(text).isNull(), "no post").when(~parsed, "not JSON").otherwise("no media at any level")
    found = normalize_posts(df, text, hosts, **options).select(key)
    return df.select(key, reason.alias("reason")).join(found, key, "left_anti")


def unwrap_page(text: Column | str) -> Column:
    """A page as struct(posts array<string>, cursor): list under any known name or a bare list.

    The page is parsed once; lists arrive as text and only the one that counts is split up.
    """
    text = as_column(text)
    nested = ", ".join(f"{k} string" for k in NESTED_CURSOR_KEYS)
    names = dict.fromkeys([*POST_LIST_KEYS, *CURSOR_KEYS, "has_more", "hasMore"])
    schema = ", ".join(f"{k} string" for k in names) + f", pagination struct<{nested.replace(' string', ': string')}>"
    page = F.from_json(F.when(~F.ltrim(text).startswith("["), text), schema)

    def split_up(p: Column) -> Column:
        lists = [F.when(p[k].startswith("["), p[k]) for k in POST_LIST_KEYS]
        bare = F.when(F.ltrim(text).startswith("["), text)
        cursor = _first(*[p[k] for k in CURSOR_KEYS], *[p["pagination"][k] for k in NESTED_CURSOR_KEYS])
        more = F.coalesce(p["has_more"], p["hasMore"], F.lit("true"))
        posts = F.from_json(F.coalesce(*lists, bare), "array<string>")
        return F.struct(
            F.coalesce(posts, F.array().cast("array<string>")).alias("posts"),
            F.when(~more.isin("false", "0", "null", ""), cursor).alias("cursor"),
        )

    # The lambda argument stands for the parsed page, so the page is not parsed per use.
    return F.get(F.transform(F.array(page), split_up), F.lit(0))
