"""Paint layers of splats: what children inherit, and colours that are taken anew after a move.

The reference describes these in prose only; this follows the prose and claims no
parity beyond that.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import stored


def inherited(df: DataFrame, id_col: str, parent: Column, layer: Column, out: str = "paint_layer") -> DataFrame:
    """Adds ``out``: a splat's own ``layer``, or that of its nearest ancestor that has one.

    Each round joins the splats that still ask to whom they ask, and takes over either
    the answer or the one that this one asks, so the way to an ancestor is halved and
    takes as many rounds as its length has doublings.  A round is written to the
    shared folder.  ``out`` is null where no ancestor has a layer, a parent has no
    row, or the ancestors form a ring: after as many rounds as the rows have doublings
    only rings still ask.  Ids name one splat each; a splat with a null id gets its
    own layer or its ancestors', but has no children.  A parent that very many splats
    ask is the side of a join that adaptive execution splits.
    """
    own = layer.isNotNull()
    rows = stored(df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), layer.alias("layer"), F.when(~own, parent).alias("ask")), "layers")
    known = rows.filter("id is not null").select("id", "layer", "ask")
    many = known.count()
    state = known
    for _ in range(math.ceil(math.log2(many + 1)) + 1 if many else 0):
        if state.filter("ask is not null").isEmpty():
            break
        told = state.select(F.col("id").alias("ask"), F.col("layer").alias("_layer"), F.col("ask").alias("_next"))
        asking = state.filter("ask is not null").join(told, "ask", "left").select("id", F.col("_layer").alias("layer"), F.col("_next").alias("ask"))
        state = stored(state.filter("ask is null").unionByName(asking), "layers")
    told = state.filter("ask is null and layer is not null").select(F.col("id").alias("ask"), F.col("layer").alias("_layer"))
    # Every row asks its parent at last: one more join, which also serves rows without an id.
    return rows.join(told, "ask", "left").select("row", F.coalesce("layer", "_layer").alias(out)).select("row.*", out)


def summed_area(pixels: DataFrame, keys: list[str], x: Column, y: Column, values: Mapping[str, Column]) -> DataFrame:
    """(keys, x, y, pixels, one column per value): sums over all pixels from (0, 0) to each pixel.

    Sums run along the lines and then along the columns, so a task holds a line of
    an image at a time.  A null value adds nothing; a pixel given twice adds twice.
    """
    rows = pixels.select(*keys, x.cast("long").alias("x"), y.cast("long").alias("y"), *[v.cast("double").alias(n) for n, v in values.items()])
    once = rows.groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("pixels"), *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in values])
    names = ["pixels", *values]
    line, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    return once.select(*keys, "x", "y", *[F.sum(n).over(line).alias(n) for n in names]).select(*keys, "x", "y", *[F.sum(n).over(column).alias(n) for n in names])


def repaired(splats: DataFrame, pixels: DataFrame, keys: list[str], id_col: str, moved: Column, box: tuple[Column, Column, Column, Column], x: Column, y: Column, channels: Mapping[str, Column]) -> DataFrame:
    """``splats`` with the ``channels`` of those that ``moved`` taken anew from their footprint in the image, and ``repaired``, which says so.

    ``channels`` maps columns of ``splats`` to expressions of ``pixels``, and ``box`` is
    the first and last column and the first and last row of a footprint.  Its mean
    colour is the difference of four places of a table of sums, so the work for a splat
    is the same at any size.  Footprints are cut at the image's edges; those wholly
    outside, of no area, or with a null side keep their colour, as do splats of keys
    without an image.  Images are whole rectangles of pixels from (0, 0).  Ids name
    one splat each within ``keys``.
    """
    named = {f"_m{i}": c for i, c in enumerate(channels.values())}
    sums = stored(summed_area(pixels, keys, x, y, named), "summed-area")
    sizes = sums.groupBy(*keys).agg(F.max("x").alias("_w"), F.max("y").alias("_h"))
    left, right, top, bottom = (c.cast("long") for c in box)
    asked = splats.filter(moved).select(*keys, F.col(id_col).alias("_id"), left.alias("_l"), right.alias("_r"), top.alias("_t"), bottom.alias("_b")).join(sizes, keys)
    held = asked.select(*keys, "_id", F.greatest(F.lit(0), "_l").alias("_l"), F.least("_w", "_r").alias("_r"), F.greatest(F.lit(0), "_t").alias("_t"), F.least("_h", "_b").alias("_b"), (F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_t").isNotNull() & F.col("_b").isNotNull()).alias("_whole"))
    corner = lambda a, b, sign: F.struct(a.alias("x"), b.alias("y"), F.lit(sign).alias("sign"))
    l, r, t, b = (F.col(c) for c in ("_l", "_r", "_t", "_b"))  # noqa: E741
    four = F.array(corner(r, b, 1), corner(l - 1, b, -1), corner(r, t - 1, -1), corner(l - 1, t - 1, 1))
    corners = held.filter("_whole and _l <= _r and _t <= _b").select(*keys, "_id", F.explode(four).alias("_at")).select(*keys, "_id", "_at.*").filter("x >= 0 and y >= 0")
    signed = lambda n: F.sum(F.col("sign") * F.col(n))
    means = corners.join(sums, [*keys, "x", "y"]).groupBy(*keys, "_id").agg(*[(signed(n) / signed("pixels")).alias(n) for n in named])
    fresh = means.select(*[F.col(k).alias(f"_own{i}") for i, k in enumerate(keys)], "_id", *named)
    both = splats.join(fresh, [*[splats[k] == fresh[f"_own{i}"] for i, k in enumerate(keys)], splats[id_col] == fresh["_id"]], "left")
    new = dict(zip(channels, named, strict=True))
    was = fresh["_id"].isNotNull()
    return both.select(*[F.when(was, fresh[new[c]]).otherwise(splats[c]).alias(c) if c in new else splats[c] for c in splats.columns], was.alias("repaired"))
