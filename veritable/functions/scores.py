"""Detector outputs to probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column


def fake_probability(logits: Column | str) -> Column:
    """Probability of class 1: sigmoid of one logit, or of the difference of two.

    The difference form equals the two-way softmax and needs no shift against overflow.
    """
    logits = as_column(logits)
    margin = F.when(F.size(logits) == 1, F.get(logits, F.lit(0))).otherwise(
        F.get(logits, F.lit(1)) - F.get(logits, F.lit(0))
    )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin.cast("double")))


def predicted(prob: Column | str, threshold: float = 0.5) -> Column:
    return (as_column(prob) >= threshold).cast("int")
