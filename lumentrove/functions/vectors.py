"""Three-component vectors as triples of DOUBLE columns.

Components stay separate columns rather than arrays, so that every expression
is part of whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import EPSILON

Vec = tuple[Column, Column, Column]


def cols(prefix: str) -> Vec:
    return (F.col(f"{prefix}_x"), F.col(f"{prefix}_y"), F.col(f"{prefix}_z"))


def named(prefix: str, v: Vec) -> dict[str, Column]:
    return {f"{prefix}_{c}": x for c, x in zip("xyz", v, strict=True)}


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def length(v: Vec) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Vec, size: Column | None = None) -> Vec:
    """Unit vector; a length that is not finite or under 1e-9 gives zeros.  ``size``: the length, if it is at hand."""
    size = length(v) if size is None else size
    bad = F.isnan(size) | (size == float("inf")) | (size < EPSILON)
    return tuple(F.when(bad, F.lit(0.0)).otherwise(F.try_divide(x, size)) for x in v)


def pixel_error(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.hypot(ax - bx, ay - by)
