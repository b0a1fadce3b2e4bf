"""Numeric and formatting column expressions with the semantics of loosely typed numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9
MAX_ANGLE = 89.0
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def finite(value: Column, fallback: float | Column = 0.0) -> Column:
    """A DOUBLE column where it is finite, else the fallback; null counts as missing."""
    back = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(back)


def finite_text(text: Column, fallback: float = 0.0) -> Column:
    """``finite`` of a STRING column: blank is 0, and only plain decimal notation counts as a number."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = F.when(trimmed.rlike(NUMERIC), trimmed.try_cast("double"))
    return F.when(text.isNull(), F.lit(fallback)).when(trimmed == "", F.lit(0.0)).otherwise(finite(number, fallback))


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.greatest(as_column(low), F.least(as_column(high), value))


def clamp_angle(value: Column) -> Column:
    """Degrees within +-89; NaN and infinities are 0."""
    return clamp(finite(value), -MAX_ANGLE, MAX_ANGLE)


def to_radians(degrees: Column) -> Column:
    return degrees * F.lit(math.pi) / F.lit(180.0)


def to_degrees(radians: Column) -> Column:
    return radians * F.lit(180.0) / F.lit(math.pi)


def or_default(value: Column, default: float) -> Column:
    """The value unless it is null, NaN or 0."""
    return F.when(value.isNull() | F.isnan(value) | (value == 0), F.lit(float(default))).otherwise(value)


def fixed6(value: Column) -> Column:
    """Six decimals; negative zero prints as zero."""
    return F.format_string("%.6f", value + F.lit(0.0))


def angle_key(pitch: Column, yaw: Column) -> Column:
    """De-duplication key of a camera, from unclamped angles."""
    return F.format_string("%.6f:%.6f", finite(pitch) + F.lit(0.0), finite(yaw) + F.lit(0.0))


def shared_fov(fov: Column) -> Column:
    """Field of view within 25..55 degrees; unset or 0 is 50."""
    return clamp(or_default(fov, 50.0), 25.0, 55.0)


def max_camera_angle(angle: Column) -> Column:
    """Largest orbit angle within 0..89 degrees; unset or 0 is 89."""
    return clamp(or_default(angle, MAX_ANGLE), 0.0, MAX_ANGLE)


def sort_timeout_ms(vertices: Column) -> Column:
    """5 to 30 seconds, growing by a second per 50,000 vertices."""
    return clamp(F.lit(5000.0) + vertices.cast("double") / F.lit(50000.0) * F.lit(1000.0), 5000.0, 30000.0)


def radius_mode(mode: Column) -> Column:
    return F.when(mode == "fit", F.lit("fit")).otherwise(F.lit("training"))


def padded_id(index: Column, prefix: str = "fib") -> Column:
    """``fib-07``: at least two digits, never cut."""
    return F.format_string(f"{prefix}-%02d", index)


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison across engines, without negative zero."""
    return F.round(value, digits) + F.lit(0.0)
