"""How many tasks a number of bytes calls for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A task gets no more bytes than the first, nor fewer than the second only to keep all cores busy to the end.
MOST_BYTES = 64 << 20
LEAST_BYTES = 2 << 20
ROUNDS = 3


def tasks(spark: SparkSession, total: int | None, most: int = MOST_BYTES, least: int = LEAST_BYTES) -> int:
    total = total or 0
    return max(1, -(-total // most), min(ROUNDS * spark.sparkContext.defaultParallelism, total // least))
