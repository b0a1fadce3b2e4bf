"""Compositing and image measures with published or documented formulas.

The reference describes these in prose only; they follow the prose and public
definitions and claim no parity beyond that.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ranking import in_blocks, numbered

# The documented range of learned opacity.
LEARNED_LOW, LEARNED_HIGH = 0.005, 0.995
# The shares of red, green and blue in lightness (ITU-R BT.709).
LIGHTNESS = (0.2126, 0.7152, 0.0722)


def transmittance(df: DataFrame, keys: list[str], order: list[str], alpha: Column, out: str = "transmittance") -> DataFrame:
    """Adds the share of light that the layers in front of a row let through (1 for the first), front to back within ``keys``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.product(F.lit(1.0) - alpha).over(before), F.lit(1.0)))


def composite(df: DataFrame, keys: list[str], order: list[str], alpha: Column, value: Column) -> DataFrame:
    """(keys, layers, color, coverage) of alpha layers, front to back.

    Layers in a row are one layer: with the light that passes all of them, and the
    colour and coverage that they add under full light.  So a stack is folded in
    blocks of its layers, and a stack of any depth by several tasks.
    """
    cut = in_blocks(df.select(*keys, *order, alpha.alias("_a"), value.alias("_v")), keys, order)
    lit = transmittance(cut, [*keys, "_block"], order, F.col("_a"), "_t")
    weight = F.col("_a") * F.col("_t")
    blocks = lit.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"), F.product(F.lit(1.0) - F.col("_a")).alias("_pass"), F.sum(weight * F.col("_v")).alias("_color"), F.sum(weight).alias("_cover"))
    behind = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a few blocks of a stack
    seen = blocks.withColumn("_light", F.coalesce(F.product("_pass").over(behind), F.lit(1.0)))
    return seen.groupBy(*keys).agg(F.sum("_n").alias("layers"), F.sum(F.col("_light") * F.col("_color")).alias("color"), F.sum(F.col("_light") * F.col("_cover")).alias("coverage"))


def opacity(learned: Column, along: Column, short_edge: Column, long_edge: Column, radial: Column, center_max: Column, edge_min: Column) -> Column:
    """Learned opacity (held in its range) times a linear run from the short to the long edge, times one from centre to perimeter.

    ``along`` and ``radial`` are shares of the way, held in 0 to 1.
    """
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    held = F.greatest(F.lit(LEARNED_LOW), F.least(F.lit(LEARNED_HIGH), learned))
    return held * (short_edge + (long_edge - short_edge) * unit(along)) * (center_max + (edge_min - center_max) * unit(radial))


def export_parity(df: DataFrame, keys: list[str], alpha_difference: Column, premultiplied_difference: Column) -> DataFrame:
    """(keys, alpha_maximum, premultiplied_maximum, parity): alpha may differ by one step, and colour by one more if alpha does."""
    found = df.groupBy(*keys).agg(F.max(alpha_difference).alias("alpha_maximum"), F.max(premultiplied_difference).alias("premultiplied_maximum"))
    tolerance = F.when(F.col("alpha_maximum") > 0, 2).otherwise(1)
    return found.withColumn("parity", F.coalesce((F.col("alpha_maximum") <= 1) & (F.col("premultiplied_maximum") <= tolerance), F.lit(True)))


def image_error(df: DataFrame, keys: list[str], expected: Column, measured: Column, peak: float = 255.0) -> DataFrame:
    """(keys, samples, l1, mse, psnr) of paired samples; equal images have a null PSNR, as it has no bound."""
    gap = expected - measured
    found = df.groupBy(*keys).agg(F.count(gap).alias("samples"), F.avg(F.abs(gap)).alias("l1"), F.avg(gap * gap).alias("mse"))
    return found.withColumn("psnr", F.when(F.col("mse") > 0, F.lit(10.0) * F.log10(F.lit(peak * peak) / F.col("mse"))))


# The stabilising constants of the published index, and the usual block.
SSIM_K1, SSIM_K2 = 0.01, 0.03
SSIM_BLOCK, SSIM_STRIDE = 8, 4


def ssim(df: DataFrame, keys: list[str], row: Column, column: Column, expected: Column, measured: Column, peak: float = 255.0, block: int = SSIM_BLOCK, stride: int = SSIM_STRIDE) -> DataFrame:
    """(keys, blocks, ssim): the structural similarity index (Wang et al., 2004) over flat square blocks, averaged.

    This is the block form of the index, with equal weights inside a block, and not
    the form with a Gaussian window of 11 pixels; the two give different numbers.

    Blocks of ``block`` pixels start at every ``stride`` rows and columns and lie
    whole inside the image.  Each pixel adds its five moments to the blocks that
    cover it, which the map tasks combine, so a block is one row in the shuffle.
    """
    pixels = df.select(*keys, row.cast("long").alias("_r"), column.cast("long").alias("_c"), expected.cast("double").alias("_x"), measured.cast("double").alias("_y"))
    first = lambda at: F.greatest(F.lit(0), F.ceil((at - block + 1) / stride)).cast("long")
    starts = lambda at: F.explode(F.sequence(first(at), F.floor(at / stride).cast("long")))
    covered = pixels.withColumn("_br", starts(F.col("_r"))).withColumn("_bc", starts(F.col("_c")))
    x, y = F.col("_x"), F.col("_y")
    sums = covered.groupBy(*keys, "_br", "_bc").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(n) for v, n in ((x, "_mx"), (y, "_my"), (x * x, "_mxx"), (y * y, "_myy"), (x * y, "_mxy"))]).filter(F.col("_n") == block * block)
    mx, my = F.col("_mx"), F.col("_my")
    c1, c2 = (SSIM_K1 * peak) ** 2, (SSIM_K2 * peak) ** 2
    value = ((2 * mx * my + c1) * (2 * (F.col("_mxy") - mx * my) + c2)) / ((mx * mx + my * my + c1) * (F.col("_mxx") - mx * mx + F.col("_myy") - my * my + c2))
    return sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks"), F.avg(value).alias("ssim"))


# Side and spread of the published index's window.
SSIM_SIDE, SSIM_SIGMA = 11, 1.5
#: Side of the squares in which tasks hold the windows of an image.
SSIM_TILE = 256


def ssim_windowed(df: DataFrame, keys: list[str], row: Column, column: Column, expected: Column, measured: Column, peak: float = 255.0, side: int = SSIM_SIDE, sigma: float = SSIM_SIGMA, tile: int = SSIM_TILE) -> DataFrame:
    """(keys, windows, ssim): the structural similarity index (Wang et al., 2004) with its Gaussian window, averaged over all windows.

    A window starts at every pixel from which it lies whole inside the image; one that
    misses a pixel, or meets a null on either side, does not count.  An image without
    a window has a null ``ssim``.  A pixel given twice is the mean.

    Tasks work on tiles of ``tile`` windows a side with the ``side - 1`` rows and
    columns behind them, so a task holds one tile, whatever the image's size, and
    hands on a count and a sum.
    """
    rim = side - 1
    weights = np.exp(-((np.arange(side) - rim / 2) ** 2) / (2 * sigma * sigma))
    weights /= weights.sum()
    c1, c2 = (SSIM_K1 * peak) ** 2, (SSIM_K2 * peak) ** 2
    pixels = df.select(*keys, row.cast("long").alias("_r"), column.cast("long").alias("_c"), expected.cast("double").alias("_x"), measured.cast("double").alias("_y"))
    near = lambda at: F.explode(F.sequence(F.floor((at - rim) / tile), F.floor(at / tile)))
    copies = pixels.filter("_r is not null and _c is not null").withColumn("_tr", near(F.col("_r"))).withColumn("_tc", near(F.col("_c")))
    # Tiles are in place before copies of a pixel are joined, so that the join needs no shuffle of its own.
    once = copies.repartition(*keys, "_tr", "_tc").groupBy(*keys, "_tr", "_tc", "_r", "_c").agg(F.avg("_x").alias("_x"), F.avg("_y").alias("_y"))
    kinds = pixels.schema
    out = StructType([kinds[k] for k in keys]).add("_n", "long").add("_s", "double")

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        at = tuple(frame[own].to_numpy() - int(frame[t].iat[0]) * tile for own, t in (("_r", "_tr"), ("_c", "_tc")))
        x, y = np.full((2, tile + rim, tile + rim), np.nan)
        x[at], y[at] = frame["_x"].to_numpy(dtype=float), frame["_y"].to_numpy(dtype=float)
        moments = np.stack([x, y, x * x, y * y, x * y])
        moments = sum(w * moments[:, i : i + tile] for i, w in enumerate(weights))
        mx, my, mxx, myy, mxy = sum(w * moments[:, :, i : i + tile] for i, w in enumerate(weights))
        value = ((2 * mx * my + c1) * (2 * (mxy - mx * my) + c2)) / ((mx * mx + my * my + c1) * (mxx - mx * mx + myy - my * my + c2))
        there = ~np.isnan(value)
        made = frame.iloc[[0]][keys].copy()
        made["_n"], made["_s"] = int(there.sum()), float(value[there].sum())
        return made

    found = once.groupBy(*keys, "_tr", "_tc").applyInPandas(solve, out)
    return found.groupBy(*keys).agg(F.sum("_n").alias("windows"), (F.sum("_s") / F.when(F.sum("_n") > 0, F.sum("_n"))).alias("ssim"))


def training_colour(red: Column, green: Column, blue: Column, progress: Column, switch: Column) -> tuple[Column, Column, Column]:
    """What a run is trained on: the lightness in all three channels before the selected point of its progress, and the colours from there on.

    Without a point (null, or 0 or less) it is the colours throughout.  Measures of the
    result take the colours themselves.
    """
    shade = sum(c * F.lit(w) for c, w in zip((red, green, blue), LIGHTNESS, strict=True))
    under = F.coalesce(progress < switch, F.lit(False))
    return tuple(F.when(under, shade).otherwise(c) for c in (red, green, blue))


def depth_order(df: DataFrame, keys: list[str], depth: Column, tie: str) -> DataFrame:
    """Adds ``draw_order`` (from 0, far to near) within each view; no task holds a whole view."""
    order = [(depth, True), (F.col(tie), False)]
    return numbered(df, keys, order, "draw_order").withColumn("draw_order", F.col("draw_order").cast("int"))
