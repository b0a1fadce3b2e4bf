"""Progress of training runs, as a report of each run's latest state, speed and elapsed time.

The reference names what its status shows in prose only; this follows the prose and
claims no parity beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_progress(events: DataFrame, session: str, time: str, step: Column, measures: dict[str, Column], target: Column | None = None, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(session, started, ended, elapsed_seconds, events, steps, speed, progress, one column per measure) of each run.

    A run is what a session reports without a silence longer than ``gap``; a later event
    begins the next run.  ``steps`` is the largest step reported, ``speed`` is steps reached since the
    run's smallest step by the second (null for runs of one moment), and ``progress`` is steps over the largest
    ``target`` (null without one), held at 1.  A measure is its value at the largest step
    that has one; of values at the same step the largest.

    On a stream a run comes out once the watermark, ``late`` behind the newest event, has
    passed its end, and events behind the watermark are dropped; a stream
    without late events gives the rows of the batch version.  Events with a null time belong to no
    run; null steps count as events only; null sessions are a session.
    """
    steps = step.cast("double")
    source = events.withWatermark(time, late) if events.isStreaming else events
    goal = target.cast("double") if target is not None else F.lit(None).cast("double")
    rows = source.filter(F.col(time).isNotNull()).select(session, time, steps.alias("_step"), goal.alias("_goal"), *[v.alias(f"_m_{n}") for n, v in measures.items()])
    latest = [F.max(F.when(F.col(f"_m_{n}").isNotNull() & F.col("_step").isNotNull(), F.struct("_step", f"_m_{n}"))).getField(f"_m_{n}").alias(n) for n in measures]
    runs = rows.groupBy(F.session_window(time, gap), session).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("events"), F.max("_step").alias("steps"), F.min("_step").alias("_first"), F.max("_goal").alias("_goal"), *latest)
    elapsed = (F.col("ended") - F.col("started")).cast("interval second").cast("decimal(18,6)").cast("double")
    held = F.when(F.col("_goal") > 0, F.least(F.lit(1.0), F.col("steps") / F.col("_goal")))
    made = runs.withColumns({"elapsed_seconds": elapsed, "progress": held})
    return made.select(session, "started", "ended", "elapsed_seconds", "events", "steps", F.when(F.col("elapsed_seconds") > 0, (F.col("steps") - F.col("_first")) / F.col("elapsed_seconds")).alias("speed"), "progress", *measures)
