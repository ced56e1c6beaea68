"""All registered queries, by subject."""

from veritable.catalog import curation, files, metrics, reports, sampling, scorers, streams  # noqa: F401
from veritable.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
