"""A listing of files as a Spark source: folders are listed by tasks, one prefix each.

The driver looks at folders only until there are enough of them to share out (`PREFIXES`), never at the
files below. Filters on `extension` reach the tasks, which leave other files out before rows are made.
Names that start with `_` or `.` are hidden, as they are for Spark's own file sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

PREFIXES = 64
DEPTH = 3
ROWS = 10_000  # of a batch

SCHEMA = "path string, name string, extension string, length long, modificationTime timestamp"


def _file_system(folder: str):
    """(pyarrow file system, the folder's path in it, what to put before a path to make it Spark's)."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder, "file:"
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.split(":", 1)[1].lstrip("/"), "file:"
    system, path = fs.FileSystem.from_uri(folder)
    return system, path, folder[: folder.index(path)] if path and path in folder else folder.split("://")[0] + "://"


def _hidden(name: str) -> bool:
    return name.startswith(("_", "."))


def extension_of(name: str) -> str:
    """Lower-case letters behind the last dot; empty without one."""
    return name.rsplit(".", 1)[1].lower() if "." in name else ""


class Prefix(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.recursive = options["path"], options.get("recursive", "false").lower() == "true"
        self.extensions: frozenset[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("extension",):
                values = frozenset(f.value if isinstance(f, In) else [f.value])
                self.extensions = values if self.extensions is None else self.extensions & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Folders to list with all below them, and those above these, to list for their own files."""
        from pyarrow import fs

        system, root, _ = _file_system(self.folder)
        if not self.recursive:
            return [Prefix(root, False)]
        above, deep = [], [root]
        for _ in range(DEPTH):
            if len(deep) >= PREFIXES:
                break
            below = []
            for folder in deep:
                infos = system.get_file_info(fs.FileSelector(folder))
                below += [i.path for i in infos if i.type == fs.FileType.Directory and not _hidden(i.base_name)]
            above += deep
            deep = below
        return [*(Prefix(f, False) for f in above), *(Prefix(f, True) for f in sorted(deep))]

    def read(self, partition: Prefix) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, _, before = _file_system(self.folder)
        rows: list[tuple] = []
        waiting = [partition.folder]
        while waiting:
            for info in system.get_file_info(fs.FileSelector(waiting.pop())):
                if _hidden(info.base_name):
                    continue
                if info.type == fs.FileType.Directory:
                    if partition.deep:
                        waiting.append(info.path)
                elif info.type == fs.FileType.File:
                    extension = extension_of(info.base_name)
                    if self.extensions is None or extension in self.extensions:
                        at = info.mtime or datetime.fromtimestamp(0, UTC)
                        at = at.replace(microsecond=at.microsecond // 1000 * 1000)  # as other file sources say it
                        rows.append((before + info.path, info.base_name, extension, info.size, at))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, name, extension, length, at = ([r[i] for r in rows] for i in range(5))
    text = pa.string()
    columns = [pa.array(path, text), pa.array(name, text), pa.array(extension, text), pa.array(length, pa.int64())]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(at, pa.timestamp("us", tz="UTC"))], ["path", "name", "extension", "length", "modificationTime"]
    )


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options)
