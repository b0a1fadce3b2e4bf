"""Pose tables on the front hemisphere, and the least orbit radius that shows a frame from all of them."""

from __future__ import annotations

import math
from collections.abc import Callable
from types import ModuleType
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import vectors as V
from ..functions.scalars import EPSILON, MAX_ANGLE, clamp, finite, padded_id, to_degrees, to_radians
from .projection import FOV, half_tangent, with_pose

COUNT = 49
#: Poses of a caller's table that one row of the block table holds.
POSE_BLOCK = 1024
LEAST_RADIUS = 0.01
GOLDEN_ANGLE = math.pi * (3 - math.sqrt(5))


def explode_poses(df: DataFrame, count: Column, max_polar: Column) -> DataFrame:
    """Each row of ``df`` with its own spiral: ``count`` poses of equal area on the cap of ``max_polar`` degrees, by golden angles.

    A count or an angle that is no finite number is 49 or 89; there are two poses at least.
    """
    least = F.cos(to_radians(clamp(finite(max_polar, MAX_ANGLE), 0.0, MAX_ANGLE)))
    n = F.greatest(F.lit(2), F.floor(finite(count, float(COUNT)) + 0.5).cast("int"))
    out = df.withColumns({"_n": n, "_least": least}).withColumn("index", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    out = out.withColumns({"id": padded_id(F.col("index")), "fraction": F.col("index") / (F.col("_n") - 1).cast("double")})
    out = out.withColumn("_cos", F.lit(1.0) - F.col("fraction") * (F.lit(1.0) - F.col("_least")))
    out = out.withColumns({"_polar": F.acos(clamp(F.col("_cos"), -1.0, 1.0)), "_az": F.when(F.col("index") == 0, 0.0).otherwise((F.col("index") * F.lit(GOLDEN_ANGLE)) % F.lit(2 * math.pi))})
    out = out.withColumns({"dir_x": F.sin("_polar") * F.cos("_az"), "dir_y": F.sin("_polar") * F.sin("_az"), "dir_z": F.col("_cos")})
    return out.select(*df.columns, "index", "id", "fraction", to_degrees(F.col("_polar")).alias("polar_degrees"), to_degrees(F.col("_az")).alias("azimuth_degrees"), to_degrees(F.asin(clamp(F.col("dir_y"), -1.0, 1.0))).alias("pitch_degrees"), to_degrees(F.atan2("dir_x", "dir_z")).alias("yaw_degrees"), "dir_x", "dir_y", "dir_z")


def fibonacci_poses(spark: SparkSession, count: float | None = COUNT, max_polar: float | None = MAX_ANGLE) -> DataFrame:
    """One spiral as a table of its own."""
    one = spark.range(1).select(F.lit(count).cast("double").alias("_count"), F.lit(max_polar).cast("double").alias("_cap"))
    return explode_poses(one, F.col("_count"), F.col("_cap")).drop("_count", "_cap")


#: The default poses: share of the cap's depth and azimuth.
SPIRAL = tuple((i / (COUNT - 1), (i * GOLDEN_ANGLE) % (2 * math.pi)) for i in range(COUNT))


def corner_bound(lib: ModuleType, greatest: Callable, fx: Any, fy: Any, reach_x: Any, reach_y: Any, x: Any, y: Any, z: Any) -> Any:
    """The radius below which a corner of the frame (fx, fy) leaves the margin in direction (x, y, z), as columns or as arrays.

    Of the four corners the one that comes nearest the camera decides for each sign of
    the offset along the up axis, and all four have one offset along the right axis.
    """
    level = lib.sqrt(x * x + z * z)
    across = fx * lib.abs(z) / (level * reach_x)
    near_x, near_y = fx * x, fy * y
    lean, rise = fx * x * y / level, fy * level
    same, other = lib.abs(rise - lean) / reach_y, lib.abs(rise + lean) / reach_y
    return greatest(greatest(across, same) + lib.abs(near_x + near_y), greatest(across, other) + lib.abs(near_x - near_y))


def least_bound(directions: Column) -> Column:
    """The largest ``corner_bound`` of the frame (_fx, _fy) over an array of directions."""
    step = lambda most, d: F.greatest(most, corner_bound(F, F.greatest, F.col("_fx"), F.col("_fy"), F.col("_reach_x"), F.col("_reach_y"), d["x"], d["y"], d["z"]))
    return F.aggregate(directions, F.lit(float("-inf")), step)


@F.pandas_udf(DoubleType())
def spiral_bound(fx: pd.Series, fy: pd.Series, reach_x: pd.Series, reach_y: pd.Series, least: pd.Series) -> pd.Series:
    """The largest ``corner_bound`` over the default poses on a cap whose smallest cosine is ``least``, for a batch of frames at once."""
    frame, least = [c.to_numpy() for c in (fx, fy, reach_x, reach_y)], least.to_numpy()
    most = np.full(len(least), -np.inf)
    with np.errstate(all="ignore"):
        for share, turn in SPIRAL:
            z = 1.0 - share * (1.0 - least)
            flat = np.sqrt(np.maximum(0.0, 1.0 - z * z))
            most = np.maximum(most, corner_bound(np, np.maximum, *frame, flat * math.cos(turn), flat * math.sin(turn), z))
    return pd.Series(most)


def pose_blocks(poses: DataFrame, blocks: int) -> DataFrame:
    """(directions): the caller's poses (pitch_degrees, yaw_degrees), held in the front cone, in ``blocks`` arrays."""
    posed = with_pose(poses.select(F.col("pitch_degrees").alias("_in_p"), F.col("yaw_degrees").alias("_in_y")), F.col("_in_p"), F.col("_in_y"), F.lit(1.0))
    rows = posed.select(F.struct((-F.col("fwd_x")).alias("x"), (-F.col("fwd_y")).alias("y"), (-F.col("fwd_z")).alias("z")).alias("d"))
    return rows.groupBy(F.pmod(F.xxhash64("d"), F.lit(blocks)).alias("block")).agg(F.collect_list("d").alias("directions")).select("directions")


def fit_radius(frames: DataFrame, keys: list[str], half_x: Column, half_y: Column, width: Column, height: Column, fov: Column | None = None, margin: Column | None = None, max_angle: Column | None = None, poses: DataFrame | None = None) -> DataFrame:
    """Each frame's ``keys`` with ``fit_radius``; rows with equal keys stay apart.

    A corner's offset along the camera's right and up axes does not depend on
    the radius and its depth grows by one with it, so every pose and corner
    bounds the radius from below by a closed expression; the fit is the
    largest bound, held between 1.001 and 32 half diagonals.  The default poses,
    bent for each row by its ``max_angle``, are taken in numpy on whole batches of
    frames, so a frame is fitted where it is read, without join or shuffle.

    ``poses`` (pitch_degrees, yaw_degrees) replaces them; an empty table counts
    as none given.  Tables of up to ``POSE_BLOCK`` poses reach the frames as one row;
    larger ones as several, whose bounds are then folded by their maximum.

    A camera is never nearer than 0.01, so a smaller bound leaves the lower end of
    the range; where the field of view has no positive tangent nothing fits, and
    the upper end is the result.
    """
    held = lambda c, low, high, back: clamp(finite(c, back), low, high) if c is not None else F.lit(back)
    field = F.greatest(F.lit(1.0), finite(fov, FOV)) if fov is not None else F.lit(FOV)
    x, y = finite(half_x, 1.0), finite(half_y, 1.0)
    out = frames.select(*keys, x.alias("_x"), y.alias("_y"), (F.greatest(F.lit(1.0), finite(width, 1.0)) / F.greatest(F.lit(1.0), finite(height, 1.0))).alias("_aspect"), half_tangent(field).alias("_tan"), held(margin, 0.5, 0.98, 0.9).alias("_margin"), F.cos(to_radians(held(max_angle, 0.0, MAX_ANGLE, MAX_ANGLE))).alias("_least"))
    out = out.withColumns({"_fx": F.greatest(F.lit(EPSILON), F.col("_x")), "_fy": F.greatest(F.lit(EPSILON), F.col("_y")), "_s": F.greatest(F.lit(EPSILON), F.hypot("_x", "_y")), "_reach_y": F.greatest(F.lit(EPSILON), F.col("_margin") * F.col("_tan"))})
    out = out.withColumn("_reach_x", F.col("_reach_y") * F.col("_aspect"))
    given = 0 if poses is None else poses.count()
    if not given:
        bounded = out.withColumn("_r", spiral_bound("_fx", "_fy", "_reach_x", "_reach_y", "_least"))
    else:
        blocks = -(-given // POSE_BLOCK)
        table = pose_blocks(poses, blocks)
        if blocks == 1:
            bounded = out.crossJoin(F.broadcast(table)).withColumn("_r", least_bound(F.col("directions")))  # one row of bounded size
        else:
            # Equal rows have equal bounds, so they are folded together and written out again.
            many = table.count()
            folded = out.crossJoin(table).withColumn("_r", least_bound(F.col("directions"))).groupBy(*out.columns).agg(F.max("_r").alias("_r"), F.count(F.lit(1)).alias("_rows"))
            bounded = folded.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"_rows div {many}"))))
    low, high = F.col("_s") * 1.001, F.col("_s") * 32.0
    return bounded.select(*keys, F.when(F.col("_tan") <= 0, high).when(F.col("_r") <= LEAST_RADIUS, low).otherwise(clamp(F.col("_r"), low, high)).alias("fit_radius"))


def canonical_radius(frames: DataFrame, keys: list[str], half_x: Column, half_y: Column, **options: Column) -> DataFrame:
    """``fit_radius`` in a viewport of the frame's own shape, 1024 pixels on the long side."""
    x, y = F.greatest(F.lit(EPSILON), finite(half_x, 1.0)), F.greatest(F.lit(EPSILON), finite(half_y, 1.0))
    scale = F.lit(1024.0) / F.greatest(x, y)
    return fit_radius(frames, keys, half_x, half_y, x * scale, y * scale, **options)


def all_inside(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Per key whether every row fulfils the condition; a key with null conditions only holds (no counterexample)."""
    return df.groupBy(*keys).agg(F.coalesce(F.bool_and(condition), F.lit(True)).alias("all_inside"), F.coalesce(F.bool_or(condition), F.lit(False)).alias("any_inside"))


def unit_axis_check(df: DataFrame) -> Column:
    """Largest departure of fwd, right and up from an orthonormal triple."""
    f, r, u = V.cols("fwd"), V.cols("right"), V.cols("up")
    return F.greatest(*[F.abs(V.dot(a, a) - 1) for a in (f, r, u)], *[F.abs(V.dot(a, b)) for a, b in ((f, r), (f, u), (r, u))])
