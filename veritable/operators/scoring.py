"""Running callers' batch functions: detectors, generators, judges.

The caller supplies a factory. It is called once per task, loads what it needs there, and
returns a function from a pandas batch to results. Spark partitions the work and moves it in
Arrow batches; everything before and after stays in built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.scores import fake_probability, predicted
from veritable.functions.text import clean_prompt, extract_prompt, parse_verdict
from veritable.operators.metrics import metrics_by, roc_auc
from veritable.session import settle

BatchFn = Callable[[pd.DataFrame], np.ndarray]
POLICIES = ("null", "blank", "skip")
#: Payload of a batch; Spark's own Arrow batches are bounded by spark.sql.execution.arrow.maxBytesPerBatch.
BATCH_BYTES = 64 << 20
#: Rows of a frame that goes back to Spark.
OUT_ROWS = 2_000


def payload(value: object) -> int:
    """Bytes that a value holds, as far as batches are concerned: lengths of texts and binaries."""
    if isinstance(value, (bytes, bytearray, str)):
        return len(value)
    if isinstance(value, dict):
        return sum(map(payload, value.values()))
    if isinstance(value, (list, tuple)) or (isinstance(value, np.ndarray) and value.dtype == object):
        return sum(map(payload, value))
    return getattr(value, "nbytes", 8)


def _slices(frames: Iterator[pd.DataFrame], size: int, most: int = BATCH_BYTES) -> Iterator[pd.DataFrame]:
    """Batches of at most `size` rows and, but for single larger rows, `most` bytes of payload."""
    for frame in frames:
        heavy = [c for c in frame.columns if frame[c].dtype == object]
        weights = sum((frame[c].map(payload).to_numpy(dtype="int64") for c in heavy), np.zeros(len(frame), dtype="int64"))
        start, held = 0, 0
        for at, weight in enumerate(weights.tolist()):
            if at > start and (at - start == size or held + weight > most):
                yield frame.iloc[start:at]
                start, held = at, 0
            held += weight
        if start < len(frame):
            yield frame.iloc[start:]


def _as_lists(raw: np.ndarray) -> list[list[float]]:
    values = np.asarray(raw, dtype="float64")
    return values.reshape(len(values), -1).tolist()


def _neutral_results(call: BatchFn, rows: pd.DataFrame, neutral: Callable[[pd.DataFrame], pd.DataFrame]) -> list:
    """Results of what `neutral` makes of rows: of all of them at once, or where that fails one by one."""
    if len(rows) > 1:
        try:
            made = neutral(rows)
            results = _as_lists(call(made)) if len(made) == len(rows) else []
            if len(results) == len(rows):
                return results
        except Exception:
            pass
    return [result for at in range(len(rows)) for result in _as_lists(call(neutral(rows.iloc[at : at + 1])))]


def _guarded(
    call: BatchFn, batch: pd.DataFrame, neutral: Callable[[pd.DataFrame], pd.DataFrame] | None
) -> tuple[list, list]:
    """(results, errors) of a batch; a failing batch is retried row by row."""
    try:
        return _as_lists(call(batch)), [None] * len(batch)
    except Exception:
        results, errors = [], []
        for at in range(len(batch)):
            try:
                results += _as_lists(call(batch.iloc[at : at + 1]))
                errors.append(None)
            except Exception as error:
                results.append(None)
                errors.append(f"{type(error).__name__}: {error}")
        failed = [at for at, error in enumerate(errors) if error is not None]
        if neutral is not None and failed:
            for at, result in zip(failed, _neutral_results(call, batch.iloc[failed], neutral), strict=True):
                results[at] = result
        return results, errors


def _joined(frames: Iterator[pd.DataFrame], most: int = OUT_ROWS) -> Iterator[pd.DataFrame]:
    """Frames put together to `most` rows or a few more, since each that goes to Spark has a cost of its own."""
    waiting, rows = [], 0
    for frame in frames:
        waiting.append(frame)
        rows += len(frame)
        if rows >= most:
            yield pd.concat(waiting, ignore_index=True)
            waiting, rows = [], 0
    if waiting:
        yield pd.concat(waiting, ignore_index=True)


def score(
    df: DataFrame,
    make_scorer: Callable[[], BatchFn],
    inputs: Sequence[str],
    keep: Sequence[str] = ("file_name", "label", "model"),
    batch_size: int = 64,
    on_error: str = "null",
    neutral: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    threshold: float = 0.5,
    variants: Sequence[str] | None = None,
    transform: Callable[[pd.DataFrame, str], pd.DataFrame] | None = None,
    batch_bytes: int = BATCH_BYTES,
    tasks: int | None = None,
) -> DataFrame:
    """Keyed prediction table: `keep`, `prob_fake`, `pred`, `error`.

    A batch has at most `batch_size` rows and `batch_bytes` bytes of payload; a larger row goes alone.

    Rows that cannot be scored: `null` keeps them without a probability, `skip` drops them,
    `blank` scores what `neutral` makes of them. The error text is kept in the first and last.
    With `variants` each row is sent once, scored once under each variant of itself that `transform`
    makes, and gives a row per variant, named in `variant`. With `tasks` the rows are first dealt to that many:
    Spark shares rows out by their bytes, which says nothing about the work that small ones make.
    """
    if on_error not in POLICIES:
        raise ValueError(f"on_error must be one of {POLICIES}")
    if (on_error == "blank") != (neutral is not None):
        raise ValueError("on_error='blank' needs `neutral`, and only then")
    columns = list(dict.fromkeys([*keep, *inputs]))
    named = [T.StructField("variant", T.StringType())] if variants is not None else []
    schema = T.StructType(
        [df.schema[c] for c in keep]
        + named
        + [
            T.StructField("logits", T.ArrayType(T.DoubleType())),
            T.StructField("error", T.StringType()),
        ]
    )

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in _slices(frames, batch_size, batch_bytes):
            for variant in variants if variants is not None else [None]:
                call = scorer if variant is None else lambda part, v=variant: scorer(transform(part, v))
                logits, errors = _guarded(call, batch, neutral)
                out = batch[list(keep)]
                if variant is not None:
                    out = out.assign(variant=variant)
                out = out.assign(logits=logits, error=errors)
                yield out[out["logits"].notna()] if on_error == "skip" else out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _joined(scored(frames))

    rows = df.select(*columns)
    if tasks is not None:
        rows = rows.repartition(tasks, F.xxhash64(*columns))
    raw = rows.mapInPandas(run, schema)
    probability = fake_probability("logits")
    return raw.select(
        *keep, *[f.name for f in named], probability.alias("prob_fake"), predicted(probability, threshold).alias("pred"), "error"
    )


def evaluate(
    df: DataFrame, make_scorer: Callable[[], BatchFn], inputs: Sequence[str], **options
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics per model, one-row manifest, predictions); scoring runs once.

    Predictions are written to the shared folder first, since metrics and AUC both read them.
    """
    predictions = settle(score(df, make_scorer, inputs, **options), "predictions")
    overall = roc_auc(predictions.filter(F.col("prob_fake").isNotNull()))
    rows = predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prob_fake").isNull()).alias("unscored")
    ).first()
    manifest = overall.select(
        F.lit(rows["rows"]).alias("rows"), F.lit(rows["unscored"]).alias("unscored"), "roc_auc"
    )
    return metrics_by(predictions), manifest, predictions


def sweep(
    df: DataFrame,
    variants: Sequence[str],
    transform: Callable[[pd.DataFrame, str], pd.DataFrame],
    make_scorer: Callable[[], BatchFn],
    inputs: Sequence[str],
    keys: Sequence[str] = ("model",),
    keep: Sequence[str] = ("file_name", "label", "model"),
    **options,
) -> DataFrame:
    """Metrics per variant and key; every sample is scored once under every variant.

    A sample travels to its task once; `transform` and scorer run there for each variant, so no
    transformed payload is shuffled. Metrics read the predictions once (`score_totals`).
    """
    options |= {"variants": list(variants), "transform": transform}
    return metrics_by(score(df, make_scorer, inputs, keep, **options), ["variant", *keys])


def batch_text(
    df: DataFrame,
    make_call: Callable[[], Callable[[pd.DataFrame], Sequence[str]]],
    name: str,
    batch_size: int = 32,
    on_error: str = "null",
) -> DataFrame:
    """Adds one text column computed by a batch function, and `error`.

    A batch that fails is tried row by row. Rows that fail alone are kept without text and with
    the error (`null`), or dropped (`skip`).
    """
    if on_error not in ("null", "skip"):
        raise ValueError("on_error must be null or skip")
    kept = [f for f in df.schema.fields if f.name != "error"]
    schema = T.StructType([*kept, T.StructField(name, T.StringType()), T.StructField("error", T.StringType())])

    def answers(call, batch: pd.DataFrame) -> tuple[list, list]:
        try:
            return list(call(batch)), [None] * len(batch)
        except Exception as error:
            if len(batch) == 1:
                return [None], [f"{type(error).__name__}: {error}"]
            pairs = [answers(call, batch.iloc[at : at + 1]) for at in range(len(batch))]
            return [p[0][0] for p in pairs], [p[1][0] for p in pairs]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_call()
        for batch in _slices(frames, batch_size):
            texts, errors = answers(call, batch)
            out = batch[[f.name for f in kept]].assign(**{name: texts, "error": errors})
            yield out[out["error"].isna()] if on_error == "skip" else out

    return df.mapInPandas(run, schema)


def generate_text(
    df: DataFrame,
    make_generator: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    message: Column,
    batch_size: int = 32,
    name: str = "generated_prompt",
    on_error: str = "null",
) -> DataFrame:
    """Build a message per row, call the generator on batches, parse the replies (see batch_text)."""

    def make() -> Callable[[pd.DataFrame], Sequence[str]]:
        generator = make_generator()
        return lambda batch: generator(batch["_message"].tolist())

    replies = batch_text(df.withColumn("_message", message), make, "_reply", batch_size, on_error)
    return replies.withColumn(name, extract_prompt("_reply")).drop("_message", "_reply")


def annotate(
    df: DataFrame,
    make_judge: Callable[[], Callable[[pd.DataFrame], Sequence[str]]],
    make_prompter: Callable[[], Callable[[pd.DataFrame], Sequence[str]]],
    batch_size: int = 32,
    on_error: str = "skip",
) -> DataFrame:
    """Judge every row; only relevant rows stay and get a `generated_prompt` and `category`.

    Rows that judge or prompter fail on are left out (`skip`), or kept with the `error` (`null`).
    """
    judged = batch_text(df, make_judge, "_verdict", batch_size, on_error).withColumn(
        "category", F.when(F.col("error").isNull(), parse_verdict("_verdict")["category"])
    )
    failed = judged.filter("error IS NOT NULL").drop("_verdict")
    relevant = judged.filter(F.col("category") != "none").drop("_verdict")
    told = batch_text(relevant, make_prompter, "_reply", batch_size, on_error).withColumn(
        "generated_prompt", clean_prompt("_reply")
    ).drop("_reply")
    return told if on_error == "skip" else told.unionByName(failed, allowMissingColumns=True)
