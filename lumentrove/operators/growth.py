"""A picture as cells: an aspect-true grid that grows where the error is largest, up to a budget.

The reference describes grid initialisation and density growth in prose only; this
follows the prose and claims no parity beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ranking import best_rows, stored

BOX = ("x0", "x1", "y0", "y1")


def grid_shape(width: Column, height: Column, count: Column) -> tuple[Column, Column]:
    """(columns, rows) of about ``count`` cells that are as square as the picture allows; at least one, and none below a pixel."""
    held = lambda c, most: F.greatest(F.lit(1), F.least(most, c)).cast("long")
    columns = held(F.floor(F.sqrt(count * width.cast("double") / height) + 0.5), width)
    return columns, held(F.floor(count.cast("double") / columns + 0.5), height)


def root_cell(at: Column, size: Column, cells: Column) -> tuple[Column, Column, Column]:
    """(cell, its first pixel, the next cell's first pixel) of a pixel in one direction."""
    whole = lambda a, b: F.call_function("div", a, b)
    cell = whole((at + 1) * cells - 1, size)
    return cell, whole(cell * size, cells), whole((cell + 1) * size, cells)


def cells_of(batch: pa.RecordBatch, rest: list[str]) -> Iterator[pa.RecordBatch]:
    """The cells from a grid cell down to the pixel that hold each pixel, level by level: ``rest``, path, x0, x1, y0, y1.

    A path is 1 for the grid cell, and twice the parent's path, plus one for the
    second half, for a half: a row of bits that leads from the grid cell down.  A box is
    cut across its width unless that is the shorter side.
    """
    x, y, x0, x1, y0, y1 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_x", "_y", *BOX))
    at, path = np.arange(len(x)), np.ones(len(x), np.int64)
    while len(at):
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in rest], *map(pa.array, (path, x0, x1, y0, y1))], names=[*rest, "path", *BOX])
        more = (x1 - x0 > 1) | (y1 - y0 > 1)
        at, path, x, y, x0, x1, y0, y1 = (c[more] for c in (at, path, x, y, x0, x1, y0, y1))
        wide = x1 - x0 >= y1 - y0
        cut = np.where(wide, x0 + (x1 - x0) // 2, y0 + (y1 - y0) // 2)
        second = np.where(wide, x, y) >= cut
        path = path * 2 + second
        x0, x1 = np.where(wide & second, cut, x0), np.where(wide & ~second, cut, x1)
        y0, y1 = np.where(~wide & second, cut, y0), np.where(~wide & ~second, cut, y1)


def grow(pixels: DataFrame, keys: list[str], x: Column, y: Column, width: Column, height: Column, value: Column, count: Column, budget: Column) -> DataFrame:
    """(keys, grid_x, grid_y, path, x0, x1, y0, y1, pixels, mean, error): the cells of each picture after growth.

    A picture starts as a grid of about ``count`` cells and may have ``budget`` in the
    end.  Each step splits the cell with the largest error, the sum of squared
    differences from its mean (in whole units), across its longer side.  As no half
    has a larger error than its whole, the cells that get split are simply those with
    the largest errors of the whole tree, so no rounds are needed: the pixels add up
    to all their cells in one aggregation, and an exact cut takes as many as the
    budget has room for; of equal errors, larger cells go first, then by
    place.  The budget is met exactly unless the grid exceeds it or there are
    fewer pixels, and where pixels are missing an empty half leaves no cell.

    ``width``, ``height``, ``count`` and ``budget`` are constant in a picture; values
    are whole numbers, as samples are, of up to 16 bits in pictures of up to two
    thousand million pixels.  A pixel given twice counts twice; pixels with nulls or
    outside their picture give nothing.
    """
    columns, rows = grid_shape(F.col("_w"), F.col("_h"), F.col("_count"))
    p = pixels.select(*keys, *[c.cast("long").alias(n) for n, c in (("_x", x), ("_y", y), ("_w", width), ("_h", height), ("_v", value), ("_count", count), ("_budget", budget))])
    p = p.filter("_w > 0 and _h > 0 and _x >= 0 and _y >= 0 and _x < _w and _y < _h and _v is not null and _count is not null").withColumns({"_nx": columns, "_ny": rows})
    gx, x0, x1 = root_cell(F.col("_x"), F.col("_w"), F.col("_nx"))
    gy, y0, y1 = root_cell(F.col("_y"), F.col("_h"), F.col("_ny"))
    cell = [*keys, "grid_x", "grid_y", "path"]
    rest = [*keys, "grid_x", "grid_y", "_v", "_room"]
    p = p.withColumns({"grid_x": gx, "grid_y": gy, "_room": F.col("_budget") - F.col("_nx") * F.col("_ny")} | dict(zip(BOX, (x0, x1, y0, y1), strict=True))).select(*rest, "_x", "_y", *BOX)
    made = StructType([p.schema[c] for c in rest] + [StructField(c, LongType()) for c in ("path", *BOX)])
    spread = p.mapInArrow(lambda batches: (cells for batch in batches for cells in cells_of(batch, rest)), made)
    wide = F.col("_v").cast("decimal(19,0)")
    sums = spread.groupBy(*cell, *BOX).agg(F.count(F.lit(1)).alias("pixels"), F.sum("_v").alias("_s"), F.sum(wide * wide).alias("_ss"), F.max("_room").alias("_room"))
    n, s = F.col("pixels").cast("decimal(12,0)"), F.col("_s").cast("decimal(19,0)")
    error = F.call_function("div", n * F.col("_ss").cast("decimal(26,0)") - s * s, n)
    nodes = stored(sums.select(*cell, *BOX, "pixels", (F.col("_s") / F.col("pixels")).alias("mean"), error.alias("error"), "_room"), "cells")
    splittable = nodes.filter("x1 - x0 > 1 or y1 - y0 > 1")
    depth = F.floor(F.log2(F.col("path").cast("double")))
    split = best_rows(splittable.select(*cell, "error", "_room"), keys, F.col("error"), [depth, F.col("grid_y"), F.col("grid_x"), F.col("path")], F.col("_room")).select(*[F.col(c).alias(f"_split_{c}") for c in cell])
    is_at = lambda path: [F.col(c).eqNullSafe(F.col(f"_split_{c}")) for c in cell[:-1]] + [path == F.col("_split_path")]
    made = nodes.filter("path = 1").unionByName(nodes.filter("path > 1").join(split, is_at(F.call_function("div", F.col("path"), F.lit(2))), "left_semi"))
    return made.join(split, is_at(F.col("path")), "left_anti").select(*cell, *BOX, "pixels", "mean", "error")
