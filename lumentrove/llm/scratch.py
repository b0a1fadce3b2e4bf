"""The shared folder in which operators leave what later stages or other executors read.

Results are lazy, so an operator cannot know when its tables have been read for
the last time.  Tables that only a finished step used are removed at once with
``remove``; a caller that has stored a result removes the rest with ``sweep``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Used only by a local master whose session names no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder of ``spark.checkpoint.dir``; set to a local one only if unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    at = spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read of the table and no
    recomputation, and several consumers share one evaluation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    return made


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    known = _written.get(spark.sparkContext.applicationId, [])
    if path in known:
        known.remove(path)


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)


def left(spark: SparkSession) -> set[str]:
    """The folders that this application has left here up to now."""
    return set(_written.get(spark.sparkContext.applicationId, []))


def sweep(spark: SparkSession, keep: Iterable[DataFrame] = (), earlier: Iterable[str] = ()) -> None:
    """Deletes what this application has left here, except the tables ``keep`` and the folders ``earlier``; results that still read it are lost."""
    for path in left(spark) - {table.scratch_path for table in keep} - set(earlier):
        remove(spark, path)
