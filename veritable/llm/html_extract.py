"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of blocks (`html_tree`); unary potentials from a block's own features and
parent-child potentials give, by messages up and down the tree, the marginal chance of each run of
text to be main text (`page_model`). Runs of at least one half are the page's text, in page order.

The model is learned once per call, from `WRITTEN` labelled pages of invented words in many layouts
and at most `SAMPLED` pages of the table that label themselves: those with exactly one <article> or
<main>, of at most `SAMPLE_CHARS` characters, the first by a hash of their columns, one page a hash. This
sample is the only bound; all pages are extracted whole.

Handling: null or empty html has an empty text; rows are independent, equal ones give equal results;
markup may be broken (`html_tree`); html without markup is one run of text. Pages are handled in
groups of `GROUP_BYTES`, a longer page alone. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import by_bytes, schema
from veritable.llm.page_model import PageModel, fit, self_labelled, written_pages

WRITTEN = 800
SAMPLED = 150
SAMPLE_CHARS = 40_000
GROUP_BYTES = 2 << 20


def learn(pages: DataFrame, html_column: str = "html", by: Sequence[str] = ("page_id", "url")) -> PageModel:
    """The model of the module's docstring."""
    html = pages[html_column]
    usable = pages.filter((F.length(html) <= SAMPLE_CHARS) & html.rlike("(?i)<(article|main)[\\s>]"))
    hashed = usable.select(F.xxhash64(*[pages[c] for c in by]).alias("h"), html.alias("html"))
    # Hashes alone are sorted, so no task sends pages that others' smaller hashes leave out.
    first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLED).collect()]
    if not first:
        return fit(written_pages(WRITTEN))
    rows = hashed.filter(F.col("h") <= first[-1]).groupBy("h").agg(F.min("html").alias("html")).orderBy("h").collect()
    own = [marked for marked in (self_labelled(r["html"]) for r in rows) if marked is not None]
    return fit([*written_pages(WRITTEN), *own])


def extract(
    pages: DataFrame, model: PageModel, html_column: str = "html", keep: Sequence[str] = ("page_id", "url")
) -> DataFrame:
    """The kept columns of every page, `text` and `n_chars`, its code points."""
    kept = [(c, f"k{i}") for i, c in enumerate(keep)]
    out = schema(pages, kept, "text string")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [h or "" for h in batch.column(len(kept)).to_pylist()]
            texts: list[str] = []
            for group in by_bytes(html, len, GROUP_BYTES):
                texts += shared.value.main_texts(group)
            columns = [*batch.columns[: len(kept)], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    plain = pages.select(*[pages[c].alias(name) for c, name in kept], pages[html_column].cast("string").alias("html"))
    found = plain.mapInArrow(run, out)
    return found.select(
        *[F.col(name).alias(c) for c, name in kept], "text", F.length("text").cast("long").alias("n_chars")
    )
