"""A file listing as a Spark data source: every file below a folder, hidden ones included.

Spark's ``binaryFile`` source leaves out names that begin with a dot or an
underscore and knows no kinds of entries, both of which a check of a file set
needs.  The driver opens folders from the top, breadth first, until there are
``FOLDERS`` of them; each unopened one is then walked in a task of its own, and
the entries of each opened one are dealt by name to ``SHARES`` tasks, so neither
a deep tree nor one large folder is left to a single task.  Contents are read
only if asked for (option ``content``) and only for regular files.

    spark.dataSource.register(FileListing)
    spark.read.format("file_listing").option("content", "true").load("/site")

Stores that pyarrow has a file system for are listed in the same way by their
URIs (``s3://``, ``gs://``, ``hdfs://``); they have files and folders only.

Columns: path (below the folder, with slashes), kind (file, link or other),
length, content.  An entry that is no regular file is listed, not followed.
"""

from __future__ import annotations

import os
import stat
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .stores import open_store

SCHEMA = "path string, kind string, length long, content binary"
ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("length", pa.int64()), ("content", pa.binary())])
BATCH_BYTES = 8 << 20
FOLDERS = 64
SHARES = 4
IRREGULAR = " (not a regular file)"


def is_mounted(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def kind_of(mode: int) -> str:
    return "file" if stat.S_ISREG(mode) else "link" if stat.S_ISLNK(mode) else "other"


class Walk(InputPartition):
    """All that lies below a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder


class Share(InputPartition):
    """One share of a folder's own entries that are not folders."""

    def __init__(self, folder: str, share: int) -> None:
        self.folder, self.share = folder, share


class Mounted:
    """Entries of a mounted folder, of any kind."""

    def __init__(self, path: str) -> None:
        self.root = open_store(path)[1]

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        """(path below the root, whether it is a folder) of a folder's own entries."""
        with os.scandir(os.path.join(self.root, folder)) as found:
            for x in found:
                yield os.path.join(folder, x.name).replace(os.sep, "/"), x.is_dir(follow_symlinks=False)

    def describe(self, path: str) -> tuple[str, int]:
        info = os.lstat(os.path.join(self.root, path))
        return kind_of(info.st_mode), info.st_size

    def body(self, path: str) -> bytes:
        with open(os.path.join(self.root, path), "rb") as f:
            return f.read()


class Stored:
    """Entries of a folder in a store of pyarrow; opened anew in each process."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.sizes: dict[str, int] = {}

    def entries(self, folder: str) -> Iterator[tuple[str, bool]]:
        store, root = open_store(self.path)
        root = root.rstrip("/")
        for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"), recursive=False)):
            name = f"{folder}/{info.base_name}".lstrip("/")
            if info.type == fs.FileType.File:
                self.sizes = {name: info.size}  # of the entry that is asked for next
            yield name, info.type == fs.FileType.Directory

    def describe(self, path: str) -> tuple[str, int]:
        if path in self.sizes:
            return "file", self.sizes[path]
        store, root = open_store(self.path)
        return "file", store.get_file_info(f"{root.rstrip('/')}/{path}").size

    def body(self, path: str) -> bytes:
        store, root = open_store(self.path)
        with store.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
            return f.read()


class ListingReader(DataSourceReader):
    def __init__(self, root: str, content: bool, mounted: bool | None = None) -> None:
        self.content = content
        self.place = Mounted(root) if (is_mounted(root) if mounted is None else mounted) else Stored(root)

    def partitions(self) -> list[InputPartition]:
        opened, waiting = [], [""]
        while waiting and len(opened) + len(waiting) <= FOLDERS:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += sorted(path for path, is_folder in self.place.entries(folder) if is_folder)
        return [Share(folder, i) for folder in opened for i in range(SHARES)] + [Walk(folder) for folder in waiting]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in self.share(partition) if isinstance(partition, Share) else self.walk(partition.folder):
            (kind, length), body = self.place.describe(path), None
            if self.content and kind == "file":
                body = self.place.body(path)
                size += len(body)
            rows.append((path, kind, length, body))
            if size >= BATCH_BYTES or len(rows) >= 4096:
                yield self.batch(rows)
                rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def share(self, part: Share) -> Iterator[str]:
        return (path for path, is_folder in self.place.entries(part.folder) if not is_folder and zlib.crc32(path.encode("utf-8", "surrogateescape")) % SHARES == part.share)

    def walk(self, folder: str) -> Iterator[str]:
        for path, is_folder in self.place.entries(folder):
            if is_folder:
                yield from self.walk(path)
            else:
                yield path

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        mounted = {"mounted": True, "arrow": False}.get(self.options.get("store", ""))
        return ListingReader(self.options["path"], self.options.get("content", "false") == "true", mounted)


def list_files(spark: SparkSession, folder: str, content: bool = False, store: str = "") -> DataFrame:
    """Sorted by path; ``listed_as`` marks entries that are not regular files.  ``store``: mounted or arrow, by the URI if not given."""
    spark.dataSource.register(FileListing)
    found = spark.read.format("file_listing").option("content", str(content).lower()).option("store", store).load(folder)
    return found.withColumn("listed_as", listed_name(F.col("path"), F.col("kind"))).orderBy("path")


def listed_name(path: Column, kind: Column) -> Column:
    return F.when(kind == "file", path).otherwise(F.concat(path, F.lit(IRREGULAR)))
