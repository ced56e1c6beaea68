"""Operators of a training-data pipeline: dedup, tokenising, formatting, filters and mixing."""
