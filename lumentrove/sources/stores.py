"""File systems for Python data sources: local or mounted folders, and the stores that pyarrow knows."""

from __future__ import annotations

import posixpath
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import SparkSession


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), posixpath.normpath(unquote(urlparse(path).path) if scheme else path)
    return fs.FileSystem.from_uri(path)


def is_known(path: str) -> bool:
    """Whether ``open_store`` can open the path."""
    return urlparse(path).scheme in ("", "file", "s3", "gs", "gcs", "hdfs", "abfs", "abfss")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session shares with its executors; a local one only if none is named and all tasks run here."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "/tmp/checkpoints"
    return named.rstrip("/")
