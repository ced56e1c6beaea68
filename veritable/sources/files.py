"""Small files and folders in a shared folder, through the file system that Spark uses for it."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _open(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none when there is no such folder."""
    fs, at = _open(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _open(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _open(spark, path)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a whole file if there is none of that name; False if another writer was first.

    The text is written beside it and moved: a rename to a name that is taken fails on HDFS. A local
    rename would replace the file, so local files are linked, which fails.
    """
    folder, name = path.rsplit("/", 1)
    fs, at = _open(spark, path)
    if fs.exists(at):
        return False
    beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
    _write(spark, beside, text)
    if fs.getScheme() != "file":
        if fs.rename(_open(spark, beside)[1], at):
            return True
        delete(spark, beside)
        return False
    local = [unquote(urlparse(p).path) for p in (beside, path)]
    try:
        os.link(*local)
    except FileExistsError:
        return False
    finally:
        delete(spark, beside)
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write a file, whatever was there."""
    _write(spark, path, text)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, at = _open(spark, path)
    return fs.rename(at, _open(spark, to)[1])


def delete(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders that this package wrote itself."""
    for path in paths:
        fs, at = _open(spark, path)
        fs.delete(at, True)


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder."""
    fs, at = _open(spark, path)
    return fs.getContentSummary(at).getLength()
