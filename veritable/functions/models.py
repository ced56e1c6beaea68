"""Model catalogue entries and the outcome of generation jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veritable.functions.hashing import as_column

# Samples per kind of model.
QUOTAS = {"Base": 10000, "Fine-tune": 5000, "LoRA": 2000}
# Tags of adapters.
ADAPTER_TAGS = ("lora", "peft", "adapter")
# Exit code -> (reason, status).
EXIT_CODES = {
    0: ("", "COMPLETED"),
    14: ("Critical Code Bug", "HALT"),
    11: ("Incompatible Architecture", "MODEL_FAULT"),
    12: ("Node/GPU Out of Memory", "INFRASTRUCTURE_FAULT"),
    137: ("Node/GPU Out of Memory", "INFRASTRUCTURE_FAULT"),
    9: ("Node/GPU Out of Memory", "INFRASTRUCTURE_FAULT"),
    10: ("Data/Path Typo", "INFRASTRUCTURE_FAULT"),
}
OTHER_EXIT = ("Generic Slurm/Job Failure", "INFRASTRUCTURE_FAULT")
TERMINAL = ("COMPLETED", "MODEL_FAULT")
# Words in error messages.
MEMORY_WORDS = ("cuda out of memory",)
MISSING_FILE_WORDS = ("no such file or directory",)
MODEL_FILE_WORDS = ("model_index.json", "config.json", "scheduler", "huggingface", "safetensors")
ARCHITECTURE_WORDS = (
    "weight", "pipeline", "expected str", "time embedding", "incorrect config", "dimension",
)


def classify_model(tags: Column | str, base_models: Column | str) -> Column:
    """struct(type, quota, base_id) from hub tags and the declared parents (first one counts)."""
    tags = F.transform(F.coalesce(as_column(tags), F.array().cast("array<string>")), F.lower)
    declared = F.nullif(F.get(as_column(base_models), F.lit(0)), F.lit(""))
    tagged = F.get(F.filter(tags, lambda t: t.startswith("base_model:")), F.lit(0))
    base = F.coalesce(declared, F.nullif(F.regexp_extract(tagged, "^base_model:(.*)$", 1), F.lit("")))
    adapter = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in ADAPTER_TAGS]))
    kind = F.when(adapter, "LoRA").when(base.isNotNull(), "Fine-tune").otherwise("Base")
    quota = F.lit(QUOTAS["Base"])
    quota = F.when(adapter, QUOTAS["LoRA"]).when(base.isNotNull(), QUOTAS["Fine-tune"]).otherwise(quota)
    return F.struct(
        kind.alias("type"), quota.alias("quota"), F.coalesce(base, F.lit("None")).alias("base_id")
    )


def task_tiers(quota: Column | str, smallest: int = 2) -> Column:
    """Parallel tasks for a quota: 10, 5, or the smallest tier (2 for images, 3 for inpainting)."""
    quota = as_column(quota)
    return F.when(quota >= 10000, 10).when(quota >= 5000, 5).otherwise(smallest)


def run_status(code: Column | str) -> Column:
    """struct(reason, status) of an exit code; the reason of a failure names the code."""

    def pair(reason: str, status: str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(status).alias("status"))

    known = F.create_map(*[x for c, p in EXIT_CODES.items() for x in (F.lit(c), pair(*p))])
    found = F.coalesce(F.try_element_at(known, as_column(code).cast("int")), pair(*OTHER_EXIT))
    exit_ = F.concat(found["reason"], F.lit(" (Exit "), as_column(code).cast("string"), F.lit(")"))
    failed = found["status"].isin("MODEL_FAULT", "INFRASTRUCTURE_FAULT") & as_column(code).isNotNull()
    return F.struct(F.when(failed, exit_).otherwise(found["reason"]).alias("reason"), found["status"].alias("status"))


def _mentions(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def fault_code(message: Column | str, io_error: Column | None = None) -> Column:
    """Exit code of an error text; word lists are tried in order of priority."""
    low = F.lower(F.coalesce(as_column(message), F.lit("")))
    missing = _mentions(low, MISSING_FILE_WORDS)
    if io_error is not None:
        missing = missing | io_error
    return (
        F.when(_mentions(low, MEMORY_WORDS), 12)
        .when(missing & _mentions(low, MODEL_FILE_WORDS), 11)
        .when(missing, 10)
        .when(_mentions(low, ARCHITECTURE_WORDS), 11)
        .otherwise(14)
    )
