"""Images as rows of pixels: resampling to a bounded size by the areas that pixels share.

The reference describes a bounded decode and exports of a chosen size in prose
only; this follows the prose and claims no parity beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Long side of a picture that is kept decoded.
CACHED_SIDE = 4096


def shares(at: Column, size: Column, target: Column) -> Column:
    """Array of (cell, share): the cells of ``target`` that a pixel of ``size`` overlaps in one direction, and by how much of a cell."""
    scale = target.cast("double") / size
    low, high = at * scale, F.least(target.cast("double"), (at + 1) * scale)
    first = F.least(F.floor(low), target - 1).cast("long")
    last = F.greatest(first, F.ceil(high) - 1).cast("long")
    each = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("cell"), (F.least(high, (i + 1).cast("double")) - F.greatest(low, i.cast("double"))).alias("share")))
    return F.filter(each, lambda x: x["share"] > 0)


def resample(pixels: DataFrame, keys: list[str], x: Column, y: Column, width: Column, height: Column, new_width: Column, new_height: Column, channels: dict[str, Column]) -> DataFrame:
    """(keys, x, y, one column per channel, coverage) of images with the new sizes, up or down.

    Each pixel adds to the target cells that it overlaps, weighted by area, so the
    sum over an image grows by exactly the change of its area.  A pixel meets as
    many cells as lie under it: up to four when shrinking.  The map tasks add up what
    meets in a cell, and no task holds a whole image.  ``coverage`` is the share of a
    cell that pixels cover, 1 where none are missing; a channel is their average.
    Pixels outside their image, and images without a positive size, give nothing.
    """
    rows = pixels.select(*keys, x.cast("long").alias("_x"), y.cast("long").alias("_y"), width.cast("long").alias("_w"), height.cast("long").alias("_h"), new_width.cast("long").alias("_tw"), new_height.cast("long").alias("_th"), *[c.cast("double").alias(f"_c_{name}") for name, c in channels.items()])
    rows = rows.filter("_w > 0 and _h > 0 and _tw > 0 and _th > 0 and _x >= 0 and _y >= 0 and _x < _w and _y < _h")
    spread = rows.withColumn("_sx", F.explode(shares(F.col("_x"), F.col("_w"), F.col("_tw")))).withColumn("_sy", F.explode(shares(F.col("_y"), F.col("_h"), F.col("_th"))))
    area = F.col("_sx.share") * F.col("_sy.share")
    sums = spread.groupBy(*keys, F.col("_sx.cell").alias("x"), F.col("_sy.cell").alias("y")).agg(F.sum(area).alias("coverage"), *[F.sum(area * F.col(f"_c_{name}")).alias(name) for name in channels])
    return sums.select(*keys, "x", "y", *[(F.col(name) / F.col("coverage")).alias(name) for name in channels], "coverage")
