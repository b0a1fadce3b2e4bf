"""Whole-file sources by Spark's own readers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, files: Mapping[str, str]) -> DataFrame:
    """(name, text): one row per named file, each read as one string."""
    parts = [spark.read.text(path, wholetext=True).select(F.lit(name).alias("name"), F.col("value").alias("text")) for name, path in files.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def read_binaries(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, content) of every file below ``path``; the pattern (``*.ply``) is applied before files are opened.

    Spark's reader gives no rows for empty files and for names that begin with a dot or an underscore.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, accepted, vertices, sha256) of PLY files, with the number of vertices that their headers announce.

    Empty files are refused: they are rows with ``accepted`` false, except in stores
    that only Hadoop knows, where they cannot be listed and have no rows.
    """
    from ..functions.binary import digest, is_ply_payload, ply_vertex_count
    from .listing import list_files
    from .stores import is_known

    rows = read_binaries(spark, path, "*.ply")
    if is_known(path):
        empty = list_files(spark, path).filter((F.col("kind") == "file") & (F.col("length") == 0) & F.endswith("path", F.lit(".ply")))
        rows = rows.unionByName(empty.select(F.concat(F.lit(path.rstrip("/") + "/"), F.col("path")).alias("path"), "length", F.lit(b"").alias("content")))
    return rows.select("path", "length", is_ply_payload(F.col("content")).alias("accepted"), ply_vertex_count(F.col("content")).alias("vertices"), digest(F.col("content")).alias("sha256"))


def ordered_values(spark: SparkSession, values: Sequence[str], name: str = "value") -> DataFrame:
    """A literal table (ord, value) that keeps the order of its values."""
    return spark.createDataFrame(list(enumerate(values)), f"ord int, {name} string")
