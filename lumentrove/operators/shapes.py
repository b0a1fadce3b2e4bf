"""Paint shapes by layer: a deterministic mix with exact shares, and edges that taper.

The reference describes these in prose only; this follows the prose and claims no
parity beyond that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

#: The share of the way that each next ratio moves, the golden section.
GOLDEN = 0.6180339887498949

# The documented range of a stroke's long side over its short side, and what two families of strokes keep at least.
ASPECT_LOW, ASPECT_HIGH = 1.0, 8.0
ASPECT_FLOORS = {"ribbon": 2.2, "accent": 2.8}


def quotas(total: Column, weights: list[Column]) -> Column:
    """Array of whole numbers that add up to ``total`` in proportion to ``weights``, by largest remainder; of equal remainders the first wins.

    Null, negative and NaN weights are zero; if none is positive, all are equal.
    """
    held = F.array(*[F.when((w > 0) & ~F.isnan(w), w).otherwise(0.0) for w in (x.cast("double") for x in weights)])
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    fair = F.when(sum_of(held) > 0, held).otherwise(F.array(*[F.lit(1.0)] * len(weights)))
    exact = F.transform(fair, lambda w: total * w / sum_of(fair))
    whole = F.transform(exact, lambda x: F.floor(x))
    left = total - F.aggregate(whole, F.lit(0).cast("long"), lambda s, x: s + x)
    rest = lambda x: x - F.floor(x)
    ahead = lambda x, i: F.size(F.filter(exact, lambda y, j: (rest(y) > rest(x)) | ((rest(y) == rest(x)) & (j < i))))
    return F.transform(exact, lambda x, i: F.floor(x) + F.when(ahead(x, i) < left, 1).otherwise(0))


def mix(df: DataFrame, layer: list[str], order: list[tuple[Column, bool]], shares: Mapping[str, Column], out: str = "shape") -> DataFrame:
    """Adds to each row its ``nth`` and ``layer_rows`` (number from 0 and count in its layer) and ``out``, one of the names of ``shares``.

    ``shares`` are weights, expressions of the layer's columns.  A layer's counts are
    its quotas exactly, so no share is off by a whole row, and names are diffused
    over the order: the first takes every row at which the running total of its quota
    passes a whole number, the next does the same among the rows that are left.
    The result depends on the order alone and not on partitions.
    """
    names = list(shares)
    big = lambda c: c.cast("decimal(19,0)")
    steps = lambda place, part, whole: F.call_function("div", big(place) * big(part), big(whole))
    at = numbered(df, layer, order, "nth", "layer_rows").withColumn("_quota", quotas(F.col("layer_rows"), list(shares.values())))
    taken = F.lit(None).cast("string")
    place, whole = "nth", "layer_rows"
    for i, name in enumerate(names):
        before = F.when(F.col(whole) > 0, steps(F.col(place), F.get("_quota", F.lit(i)), F.col(whole))).otherwise(0)
        until = F.when(F.col(whole) > 0, steps(F.col(place) + 1, F.get("_quota", F.lit(i)), F.col(whole))).otherwise(0)
        at = at.withColumns({f"_before{i}": before, f"_hit{i}": until > before})
        at = at.withColumns({f"_place{i}": F.col(place) - F.col(f"_before{i}"), f"_whole{i}": F.col(whole) - F.get("_quota", F.lit(i))})
        place, whole = f"_place{i}", f"_whole{i}"
    for i in reversed(range(len(names))):
        taken = F.when(F.col(f"_hit{i}"), names[i]).otherwise(taken)
    return at.select(*df.columns, "nth", "layer_rows", taken.alias(out))


def edge_ratio(shape: Column, nth: Column, low: Column, high: Column) -> Column:
    """Short edge over long edge: ``low`` for a triangle, ``high`` for a rectangle, and for a trapezoid a place between them that moves by the golden section."""
    low, high = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in (low, high))
    way = (nth + 1) * F.lit(GOLDEN)
    return F.when(shape == "triangle", low).when(shape == "rectangle", high).otherwise(low + (high - low) * (way - F.floor(way)))


def tapered(width: Column, height: Column, ratio: Column, keep_area: bool = True) -> tuple[Column, Column, Column]:
    """Long edge, short edge and height of a trapezoid in place of a rectangle; with ``keep_area`` it covers the rectangle's area, at the same aspect."""
    grown = F.sqrt(F.lit(2.0) / (F.lit(1.0) + ratio)) if keep_area else F.lit(1.0)
    return width * grown, width * grown * ratio, height * grown


def stroke_size(long_side: Column, short_side: Column, family: Column, low: Column, high: Column, floors: Mapping[str, float] | None = None) -> tuple[Column, Column, Column]:
    """Long side, short side and aspect of a brush stroke, its aspect held between ``low`` and ``high`` at the same area.

    ``floors`` raise ``low`` for some families (``ASPECT_FLOORS`` for the documented
    ones), but never above ``high``.  Limits below 1 are 1, null limits the default
    ones, and a ``low`` above ``high`` is ``high``.  Sides that are null or not positive give nulls.
    """
    own = F.lit(ASPECT_LOW)
    for name, least in (floors or {}).items():
        own = F.when(family == name, F.lit(least)).otherwise(own)
    most = F.greatest(F.lit(1.0), F.coalesce(high, F.lit(ASPECT_HIGH)))
    least = F.least(most, F.greatest(F.lit(1.0), F.coalesce(low, F.lit(ASPECT_LOW)), own))
    sound = (long_side > 0) & (short_side > 0)
    aspect = F.when(sound, F.greatest(least, F.least(most, long_side / short_side)))
    area = long_side * short_side
    return F.sqrt(area * aspect), F.sqrt(area / aspect), aspect


def stroke_width(short_side: Column, start: Column, end: Column, learned: Column, along: Column) -> Column:
    """Width of a stroke a share ``along`` of its way: from the width times ``start`` to the width times ``end``, by the ``learned`` part (0 to 1) of that taper; equal ends give none."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return short_side * F.when(start == end, start).otherwise(start + (end - start) * unit(learned) * unit(along))
