"""Viewer sessions as streams of events: last settings, counters, and radii that follow the viewport.

The functions take batch or streaming DataFrames; none keeps state beyond one
bounded row per session, and ``session_stream`` lets go of that too when a session
has been silent for long enough.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalars import max_camera_angle, shared_fov
from ..operators.poses import fit_radius


def last_settings(events: DataFrame, session: str, seq: Column, settings: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(session, one column per setting): the value of the latest event, by ``seq``, whose condition holds.

    ``settings``: name -> (condition, value).
    """
    return events.groupBy(session).agg(*[F.max_by(value, F.when(condition, seq)).alias(name) for name, (condition, value) in settings.items()])


class LastSettings(StatefulProcessor):
    """Keeps, for each setting of a session, the value of the event with the largest sequence number, and a timer that ends the session.

    State of a session: last event time and timer in milliseconds, and per setting a
    sequence number and a value.
    """

    def __init__(self, session: str, names: list[str], state: StructType, gap_ms: int) -> None:
        self.session, self.names, self.schema, self.gap_ms = session, names, state, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("settings", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N803
        now = dict(zip(self.schema.names, self.kept.get(), strict=True)) if self.kept.exists() else dict.fromkeys(self.schema.names)
        for row in rows:
            if row["_at"] is not None and (now["last_ms"] is None or row["_at"] > now["last_ms"]):
                now["last_ms"] = row["_at"]
            for name in self.names:
                seq = row[f"_seq_{name}"]
                if seq is not None and (now[f"seq_{name}"] is None or seq >= now[f"seq_{name}"]):
                    now[f"seq_{name}"], now[f"value_{name}"] = seq, row[f"_value_{name}"]
        if now["last_ms"] is not None and now["timer_ms"] != now["last_ms"] + self.gap_ms:
            if now["timer_ms"] is not None:
                self.handle.deleteTimer(now["timer_ms"])
            now["timer_ms"] = now["last_ms"] + self.gap_ms
            self.handle.registerTimer(now["timer_ms"])
        self.kept.update(tuple(now[c] for c in self.schema.names))
        yield self.row(key, now, False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:  # noqa: N803
        if self.kept.exists():
            now = dict(zip(self.schema.names, self.kept.get(), strict=True))
            self.kept.clear()
            yield self.row(key, now, True)

    def row(self, key: tuple, now: dict, closed: bool) -> Row:
        return Row(**{self.session: key[0]}, **{name: now[f"value_{name}"] for name in self.names}, last_seen_ms=now["last_ms"], closed=closed)


def use_rocksdb(spark: SparkSession) -> None:
    """``session_stream`` keeps timers, which Spark supports in this state store only; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def session_stream(events: DataFrame, session: str, time: str, seq: Column, settings: Mapping[str, tuple[Column, Column]], gap: str, late: str) -> DataFrame:
    """``last_settings`` as a stream: (session, one column per setting, last_seen_ms, closed), a row for each change.

    Events may come out of order and more than once: ``seq`` alone decides which
    value is the latest, so a session's last row is the row of the batch version
    over all its events.  Only those behind the watermark are dropped.  A session without events for ``gap`` (event time, behind the
    watermark of ``late``) gives a last row with ``closed`` true and leaves the state; if
    it comes back, it starts anew.  Rows with a null session are one session; null
    times keep no session alive; a null ``seq`` changes nothing.
    """
    gap_ms = events.sparkSession.sql(f"SELECT unix_millis(timestamp_micros(0) + INTERVAL {gap})").first()[0]
    per_setting = [c for name, (condition, value) in settings.items() for c in (F.when(condition, seq).cast("long").alias(f"_seq_{name}"), value.alias(f"_value_{name}"))]
    slim = events.withWatermark(time, late).select(session, time, F.unix_millis(time).alias("_at"), *per_setting)
    kinds = slim.schema
    state = StructType([StructField("last_ms", LongType()), StructField("timer_ms", LongType())] + [f for name in settings for f in (StructField(f"seq_{name}", LongType()), StructField(f"value_{name}", kinds[f"_value_{name}"].dataType))])
    out = StructType([StructField(session, kinds[session].dataType)] + [StructField(name, kinds[f"_value_{name}"].dataType) for name in settings]).add("last_seen_ms", "long").add("closed", "boolean")
    return slim.groupBy(session).transformWithState(LastSettings(session, list(settings), state, gap_ms), out, "Update", "EventTime")


def event_counters(events: DataFrame, session: str, counters: Mapping[str, Column]) -> DataFrame:
    """(session, one count per condition)."""
    return events.groupBy(session).agg(*[F.count_if(condition).alias(name) for name, condition in counters.items()])


def windowed_counters(events: DataFrame, time: str, width: str, late: str, session: str, counters: Mapping[str, Column]) -> DataFrame:
    """Counters per event-time window; events later than ``late`` are dropped and finished windows leave the state."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    found = source.groupBy(F.window(time, width), session).agg(*[F.count_if(condition).alias(name) for name, condition in counters.items()])
    return found.select(F.col("window.start").alias("window_start"), session, *counters)


def refit(viewports: DataFrame, keys: list[str]) -> DataFrame:
    """The resize events (keys, half_x, half_y, width, height) with the radius that fits each, a row per event.

    Columns ``fov_degrees`` and ``max_angle_degrees``, where the events have them, are the
    viewer's own field of view and largest angle, held as it holds them.
    """
    own = {"fov": ("fov_degrees", shared_fov), "max_angle": ("max_angle_degrees", max_camera_angle)}
    options = {name: hold(F.col(c).cast("double")) for name, (c, hold) in own.items() if c in viewports.columns}
    return fit_radius(viewports, keys, F.col("half_x"), F.col("half_y"), F.col("width"), F.col("height"), **options)


def refit_stream(viewports: DataFrame, keys: list[str], on_change: Callable[[DataFrame], None], checkpoint: str, trigger: Mapping[str, object] | None = None) -> StreamingQuery:
    """Calls ``on_change`` with the refitted rows of every micro-batch.

    A batch is delivered again after a failure; consumers that write should
    overwrite by key.
    """
    return (
        viewports.writeStream.foreachBatch(lambda batch, _: on_change(refit(batch, keys)))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
