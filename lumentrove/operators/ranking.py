"""Numbers and cuts within keys of any size: no key is bound to one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import shared_folder

#: Steps per doubling of a score in the histogram of ``best_rows``.
STEPS = 16


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder once and read from there, for work that reads it more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_blocks(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``df`` cut by ranges of (keys, order), with ``_block``: a later row of a key has no smaller block, and no key is bound to one task."""
    return df.repartitionByRange(*keys, *order).withColumn("_block", F.spark_partition_id())


def numbered(df: DataFrame, keys: list[str], order: list[tuple[Column, bool]], nth: str, total: str | None = None) -> DataFrame:
    """Adds ``nth`` (long, from 0) within each key and, if named, ``total``, the key's rows.

    ``order`` lists (value, whether descending).  Rows are cut by ranges and numbered
    within each block; the counts of a key's blocks, a row each, give the first number
    of a block.  The cut rows are written to the shared folder once, as both the
    counts and the numbering read them.  Null keys are a key of their own; equal
    rows in the order get different numbers, which one is not defined.
    """
    key = [f"_k{i}" for i in range(len(keys))]
    by = [F.col(f"_o{i}").desc() if falling else F.col(f"_o{i}").asc() for i, (_, falling) in enumerate(order)]
    row = df.select(F.struct(*df.columns).alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], *[c.alias(f"_o{i}") for i, (c, _) in enumerate(order)])
    cut = stored(in_blocks(row, key, by), "numbered")
    mine = Window.partitionBy(*key)
    counts = cut.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select(*key, "_block", (F.sum("_n").over(mine.orderBy("_block")) - F.col("_n")).alias("_base"), F.sum("_n").over(mine).alias("_total"))
    inside = cut.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_block").orderBy(*by)) - 1)
    same = [inside[c].eqNullSafe(bases[c]) for c in (*key, "_block")]
    out = [(F.col("_nth") + F.col("_base")).cast("long").alias(nth)] + ([F.col("_total").alias(total)] if total else [])
    return inside.join(bases, same).select(inside["row"], *out).select("row.*", nth, *([total] if total else []))


def best_rows(df: DataFrame, keys: list[str], score: Column, ties: list[Column], room: Column) -> DataFrame:
    """The ``room`` rows of each key (an expression of its columns) with the largest ``score``, whole numbers from 0; equal scores by ascending ``ties``.

    A histogram of scores by key tells the step in which the cut lies: rows above it
    are in, rows below are out, and only those in it are ranked.  A key without
    ``room`` (null, zero or less) gives nothing.
    """
    step = F.floor(F.log2(score.cast("double") + 1) * STEPS)
    key, tie = [f"_k{i}" for i in range(len(keys))], [f"_t{i}" for i in range(len(ties))]
    named = [F.col(k).alias(n) for k, n in zip(keys, key, strict=True)] + [t.alias(n) for t, n in zip(ties, tie, strict=True)]
    rows = df.select(F.struct(*df.columns).alias("row"), *named, step.alias("_step"), score.alias("_score"), room.cast("long").alias("_room"))
    bars = rows.filter("_room > 0").groupBy(*key, "_step").agg(F.count(F.lit(1)).alias("_n"), F.max("_room").alias("_most"))
    above = Window.partitionBy(*key).orderBy(F.col("_step").desc())  # some hundred bars of a key
    cuts = bars.withColumn("_before", F.sum("_n").over(above) - F.col("_n")).filter("_before < _most")
    own = cuts.groupBy(*[F.col(k).alias(f"_own{k}") for k in key]).agg(F.min("_step").alias("_cut"), F.min_by(F.col("_most") - F.col("_before"), "_step").alias("_left"))
    met = rows.join(own, [F.col(k).eqNullSafe(F.col(f"_own{k}")) for k in key])
    ranked = numbered(met.filter("_step = _cut"), key, [(F.col("_score"), True), *[(F.col(t), False) for t in tie]], "_place")
    return met.filter("_step > _cut").select("row.*").unionByName(ranked.filter("_place < _left").select("row.*"))


def carried(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null at or before each row, in ascending ``order`` within each key.

    Rows are cut by ranges, as for ``numbered``: a block hands on the last value it
    has, a row each, so a key of any number of rows is carried on by several tasks.
    Rows of the same place in the order share a block, and which goes first is not
    defined.  Null keys are a key of their own; before the first value ``out`` is null.
    """
    key, by = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    row = df.select(F.struct(*df.columns).alias("row"), *[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], *[c.alias(n) for c, n in zip(order, by, strict=True)], value.alias("_v"))
    cut = stored(in_blocks(row, key, by), "carried")
    last = F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*by)))
    ends = cut.groupBy(*key, "_block").agg(last.alias("_end"))
    earlier = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a few blocks of a key
    handed = ends.select(*key, "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_handed"))
    until = Window.partitionBy(*key, "_block").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.withColumn("_own", F.last("_v", ignorenulls=True).over(until))
    same = [inside[c].eqNullSafe(handed[c]) for c in (*key, "_block")]
    return inside.join(handed, same).select(inside["row"], F.coalesce("_own", "_handed").alias(out)).select("row.*", out)
