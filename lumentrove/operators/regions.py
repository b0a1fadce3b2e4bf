"""Local structure of images that are rows of pixels: flat regions, and the direction in which colour flows.

The reference describes these in prose only; this follows the prose and public
definitions and claims no parity beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Side of the squares in which tasks hold an image.
TILE = 256


def local_variance(pixels: DataFrame, keys: list[str], x: Column, y: Column, value: Column, radius: int) -> DataFrame:
    """(keys, x, y, value, window_pixels, local_mean, local_variance) over the square of ``2 * radius + 1`` pixels around each pixel, cut at the image's edges.

    Sums run along the lines and then along the columns, each window as the
    difference of two running sums, so the work for a pixel is the same at any radius
    and a task holds a line of an image at a time.  Whole-number values have exact
    sums.  A pixel with a null value counts as none but gets its window's measures;
    a place without a row adds nothing, and takes its part of its line from the
    windows of its column.  A pixel given twice counts twice.
    """
    v = F.col("value")
    rows = pixels.select(*keys, x.cast("long").alias("x"), y.cast("long").alias("y"), value.cast("double").alias("value"))
    counted = rows.groupBy(*keys, "x", "y").agg(F.count(v).alias("_n"), F.coalesce(F.sum(v), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("_ss"), F.avg(v).alias("value"))

    def along(name: str, across: str, by: str) -> Column:
        line = Window.partitionBy(*keys, across).orderBy(by)
        until = F.sum(name).over(line.rangeBetween(Window.unboundedPreceding, radius))
        return until - F.coalesce(F.sum(name).over(line.rangeBetween(Window.unboundedPreceding, -radius - 1)), F.lit(0))

    sums = ("_n", "_s", "_ss")
    lines = counted.select(*keys, "x", "y", "value", *[along(c, "y", "x").alias(c) for c in sums])
    squares = lines.select(*keys, "x", "y", "value", *[along(c, "x", "y").alias(c) for c in sums])
    n, s = F.col("_n"), F.col("_s")
    known = F.when(n > 0, n)
    return squares.select(*keys, "x", "y", "value", n.alias("window_pixels"), (s / known).alias("local_mean"), F.when(n > 0, F.greatest(F.lit(0.0), (F.col("_ss") - s * s / known) / known)).alias("local_variance"))


def flat_ratio(ratio: Column, most: Column, variance: Column, flat_below: Column) -> Column:
    """The edge ratio of a shape, moved towards ``most`` as its region gets flatter: wholly at a variance of 0, not at all from ``flat_below`` on."""
    flatness = F.when(variance < flat_below, 1 - variance / flat_below).otherwise(0.0)
    return ratio + (most - ratio) * flatness


def tensors(values: np.ndarray, radius: int) -> np.ndarray:
    """Sums of the structure tensor (xx, xy, yy) over squares around each pixel of (channels, height, width) values; NaN where no pixel is."""
    there = ~np.isnan(values).all(axis=0)
    edged = np.pad(values, ((0, 0), (1, 1), (1, 1)), constant_values=np.nan)
    middle = edged[:, 1:-1, 1:-1]
    other = lambda part: np.where(np.isnan(part), middle, part)
    dx = np.nan_to_num((other(edged[:, 1:-1, 2:]) - other(edged[:, 1:-1, :-2])) / 2)
    dy = np.nan_to_num((other(edged[:, 2:, 1:-1]) - other(edged[:, :-2, 1:-1])) / 2)
    out = np.stack([(dx * dx).sum(0), (dx * dy).sum(0), (dy * dy).sum(0)]) * there
    side = 2 * radius + 1
    for axis in (1, 2):
        around = [(0, 0)] * 3
        around[axis] = (radius, radius)
        wide = np.pad(out, around)
        out = sum(np.take(wide, range(i, i + out.shape[axis]), axis) for i in range(side))
    return out


def colour_flow(pixels: DataFrame, keys: list[str], x: Column, y: Column, channels: Mapping[str, Column], radius: int = 2, tile: int = TILE) -> DataFrame:
    """(keys, x, y, flow_degrees, coherence, energy) of each pixel: the direction along which colours change least around it.

    The structure tensor, summed over all channels and the square of
    ``2 * radius + 1`` pixels around a pixel, has its small eigenvalue along the
    flow: an angle from 0 up to 180 degrees, from the x axis towards y.
    ``coherence`` is 1 where there is one direction and 0 where there is none, and
    ``energy`` is the sum of both eigenvalues.  Where nothing changes, angle and
    coherence are null, and where all directions change alike, the angle is.

    Tasks work on tiles of ``tile`` pixels with a border of ``radius + 1`` from
    their neighbours, so a task holds one tile, whatever the image's size.  A missing
    neighbour, at edges or in holes, counts as equal to the pixel; a null channel
    value changes nothing; a pixel given twice is the mean.
    """
    names = [f"_v{i}" for i in range(len(channels))]
    rim = radius + 1
    rows = pixels.select(*keys, x.cast("long").alias("x"), y.cast("long").alias("y"), *[c.cast("double").alias(n) for n, c in zip(names, channels.values(), strict=True)]).filter("x is not null and y is not null")
    near = lambda c: F.explode(F.sequence(F.floor((c - rim) / tile), F.floor((c + rim) / tile)))
    copies = rows.withColumn("_tx", near(F.col("x"))).withColumn("_ty", near(F.col("y")))
    # Tiles are in place before copies of a pixel are joined, so that the join needs no shuffle of its own.
    once = copies.repartition(*keys, "_tx", "_ty").groupBy(*keys, "_tx", "_ty", "x", "y").agg(*[F.avg(n).alias(n) for n in names])
    kinds = rows.schema
    out = StructType([kinds[k] for k in keys]).add("x", "long").add("y", "long").add("_xx", "double").add("_xy", "double").add("_yy", "double")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        left, top = int(frame["_tx"].iat[0]) * tile - rim, int(frame["_ty"].iat[0]) * tile - rim
        side = tile + 2 * rim
        column, line = frame["x"].to_numpy() - left, frame["y"].to_numpy() - top
        values = np.full((len(names), side, side), np.nan)
        for i, n in enumerate(names):
            values[i, line, column] = frame[n].to_numpy(dtype=float)
        inside = ((column >= rim) & (column < side - rim) & (line >= rim) & (line < side - rim)).nonzero()[0]
        found = tensors(values, radius)[:, line[inside], column[inside]]
        made = frame.iloc[inside][[*keys, "x", "y"]].copy()
        made["_xx"], made["_xy"], made["_yy"] = found
        return made

    solved = once.groupBy(*keys, "_tx", "_ty").applyInPandas(solve, out)
    xx, xy, yy = F.col("_xx"), F.col("_xy"), F.col("_yy")
    gap = F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy)
    steepest = F.degrees(F.atan2(2 * xy, xx - yy)) / 2  # from -90 to 90
    flow = steepest + F.lit(90.0)
    some = xx + yy > 0
    return solved.select(*keys, "x", "y", F.when(some & (gap > 0), F.when(flow >= 180, flow - 180).otherwise(flow)).alias("flow_degrees"), F.when(some, gap / (xx + yy)).alias("coherence"), (xx + yy).alias("energy"))
