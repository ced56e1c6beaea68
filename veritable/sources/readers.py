"""Reading metadata, annotations, listings and payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritable.functions.media import file_base, file_stem
from veritable.operators.ranking import head_rows
from veritable.schemas import REGISTRY_ENTRY
from veritable.sources import quoted
from veritable.sources.listing import FileListing


def _csv(spark: SparkSession, schema: T.StructType, mode: str = "FAILFAST", multiline: bool = True) -> DataFrameReader:
    """Quoted texts may hold quotes and, with `multiline`, line breaks."""
    return (
        spark.read.schema(schema)
        .option("multiLine", multiline)
        .option("escape", '"')
        .option("columnPruning", False)  # whether a line is bad must not hang on the columns asked for
        .option("mode", mode)
    )


BAD = "_bad_record"


def read_metadata(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    bad_lines: str = "fail",
    multiline: bool | str = True,
) -> DataFrame:
    """Headered CSV with every column text and missing values as `""`.

    Prompts hold quotes and line breaks, so records may span lines; a file is then read in one task, or
    with `multiline="split"`, for RFC 4180 quotes, by a task per block (`quoted`). With
    `multiline=False` no record spans lines, and large files are split by Spark. `bad_lines='skip'` leaves out records that do not
    fit the schema (`bad_records` returns them), `'fail'` raises. Columns are matched by position.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    mode = {"skip": "DROPMALFORMED", "fail": "FAILFAST"}[bad_lines]
    if multiline == "split":
        return quoted.parse(quoted.records(spark, path).select("text"), text, mode).na.fill("")
    return _csv(spark, text, mode, multiline).option("header", True).csv(path).na.fill("")


def bad_records(spark: SparkSession, path: str | list[str], schema: T.StructType, multiline: bool = True) -> DataFrame:
    """(`record`) of the lines that `read_metadata` leaves out with `bad_lines='skip'`."""
    fields = [T.StructField(f.name, T.StringType()) for f in schema.fields]
    kept = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    rows = _csv(spark, kept, "PERMISSIVE", multiline).option("columnNameOfCorruptRecord", BAD)
    # Spark refuses to read the bad record alone, so the other columns take part in the test.
    others = F.hash(*[f.name for f in fields]) % 1 == 0
    return rows.option("header", True).csv(path).filter(F.col(BAD).isNotNull() & others).select(F.col(BAD).alias("record"))


def read_headerless(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _csv(spark, schema).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line; absent text keys become `""`."""
    return spark.read.schema(schema).json(path).na.fill("")


def read_parquet_glob(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """All `<split>-*.parquet` files of a folder; Spark raises when there are none."""
    return spark.read.option("pathGlobFilter", f"{split}-*.parquet").parquet(folder)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by model id as rows (`model`, `status`, `reason`, `date`).

    Each file is one JSON document, parsed in one task; a large registry is a folder of them.
    """
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", T.MapType(T.StringType(), REGISTRY_ENTRY))
    return whole.select(F.explode(entries).alias("model", "entry")).select("model", "entry.*")


def list_media(
    spark: SparkSession, folder: str, extensions: Sequence[str], recursive: bool = False
) -> DataFrame:
    """`path`, `name`, `length`, `modificationTime` of the media files, in no order; contents are not read.

    Tasks list the folders, and leave out other extensions there (`listing`).
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileListing)
    rows = spark.read.format(FileListing.name()).option("recursive", str(recursive).lower()).load(folder)
    wanted = [e.lower().lstrip(".") for e in extensions]
    return rows.filter(F.col("extension").isin(wanted)).select("path", "name", "length", "modificationTime")


def read_tagged_union(
    spark: SparkSession, paths: str | list[str], schema: T.StructType, tag: str, split: bool = False
) -> DataFrame:
    """One read over many CSV files, each row tagged with the stem of its file; with `split` (RFC 4180
    quotes) large files are read by several tasks."""
    if split:
        rows = quoted.records(spark, paths).select(file_stem(F.col("file")).alias("_tag"), "text")
        return quoted.parse(rows, schema, "FAILFAST").select(*[f.name for f in schema.fields], F.col("_tag").alias(tag))
    rows = _csv(spark, schema).option("header", True).csv(paths)
    return rows.withColumn(tag, file_stem(F.col("_metadata.file_path")))


def read_record_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    max_files: int = 16,
    pattern: str = "*.parquet",
) -> DataFrame:
    """Parquet files of a folder as a stream, a bounded number of files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def read_records(
    spark: SparkSession, folder: str, order: Sequence[str], max_rows: int | None = None
) -> DataFrame:
    """The batch form of the record source, with the optional row cap of a debug run."""
    df = spark.read.parquet(folder)
    return df if max_rows is None else head_rows(df, max_rows, order)


def read_payloads(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """`name` and `content` of every file of a folder."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        .select(file_base("path").alias("name"), "content")
    )


def embed_payload(meta: DataFrame, media: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `image` = struct(bytes, path), rows without a file).

    `media` is (`name`, `content`). Metadata rows are narrow, so they are the side to broadcast
    when they fit; payloads are never collected. Names must be unique: one that two files have
    ends the job, since either could be meant.
    """
    files = media.select(F.col("name").alias(key), "content")
    names = files.groupBy(key).agg(F.count(F.lit(1)).alias("_files"))
    twice = F.raise_error(F.concat(F.lit("several files named "), F.col(key)))
    meta = (
        meta.join(names, key, "left")
        .filter(F.when(F.col("_files") > 1, twice.cast("boolean")).otherwise(F.lit(True)))
        .drop("_files")
    )
    embedded = meta.join(files, key).select(
        F.struct(F.col("content").alias("bytes"), F.col(key).alias("path")).alias("image"),
        *[c for c in meta.columns if c != key],
    )
    return embedded, meta.join(files.select(key), key, "left_anti")


def read_manifests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Run manifests, one small JSON object per file: (`run` = file stem, `body` text).

    Two of the names that matter differ in case only, so the body stays text and is looked up.
    """
    return spark.read.text(paths, wholetext=True).select(
        file_stem(F.col("_metadata.file_path")).alias("run"), F.col("value").alias("body")
    )


def merge_shards(
    spark: SparkSession, paths: str | list[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(all rows of the worker outputs, rows per shard)."""
    rows = read_tagged_union(spark, paths, schema, "shard")
    return rows.drop("shard"), rows.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"))
