"""Orbit cameras: clamped angles, poses, and perspective projection of points.

Each function adds columns to a DataFrame in stages, so that an intermediate
value is computed once and reused by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalars import EPSILON, MAX_ANGLE, clamp, clamp_angle, finite, to_degrees, to_radians

FOV = 50.0
#: Signs of a frame's corners in drawing order.
CORNERS = ((-1, 1), (1, 1), (1, -1), (-1, -1))


def direction_of(pitch: Column, yaw: Column) -> V.Vec:
    return (F.sin(yaw) * F.cos(pitch), F.sin(pitch), F.cos(yaw) * F.cos(pitch))


def with_orbit_angles(df: DataFrame, pitch: Column, yaw: Column, max_polar: Column | float = MAX_ANGLE) -> DataFrame:
    """Adds pitch_degrees, yaw_degrees, polar_degrees and dir_{x,y,z}: angles held in the front cone of ``max_polar``."""
    limit = to_radians(clamp(finite(max_polar, MAX_ANGLE) if isinstance(max_polar, Column) else F.lit(float(max_polar)), 0.0, MAX_ANGLE))
    out = df.withColumns({"_p": to_radians(clamp_angle(pitch)), "_y": to_radians(clamp_angle(yaw)), "_m": limit})
    out = out.withColumns(V.named("_d", direction_of(F.col("_p"), F.col("_y"))))
    out = out.withColumns({"_polar": F.acos(clamp(F.col("_d_z"), -1.0, 1.0)), "_az": F.atan2("_d_y", "_d_x")})
    out = out.withColumn("_in", F.col("_polar") <= F.col("_m") + EPSILON)
    capped = (F.sin("_m") * F.cos("_az"), F.sin("_m") * F.sin("_az"), F.cos("_m"))
    pick = lambda inside, outside: F.when(F.col("_in"), inside).otherwise(outside)
    out = out.withColumns({f"dir_{c}": pick(F.col(f"_d_{c}"), x) for c, x in zip("xyz", capped, strict=True)})
    out = out.withColumns({"pitch_degrees": to_degrees(pick(F.col("_p"), F.asin(clamp(F.col("dir_y"), -1.0, 1.0)))), "yaw_degrees": to_degrees(pick(F.col("_y"), F.atan2("dir_x", "dir_z"))), "polar_degrees": to_degrees(pick(F.col("_polar"), F.col("_m")))})
    return out.drop("_p", "_y", "_m", "_d_x", "_d_y", "_d_z", "_polar", "_az", "_in")


def with_pose(df: DataFrame, pitch: Column | float, yaw: Column | float, radius: Column | float) -> DataFrame:
    """Adds the clamped angles, radius, pos_*, fwd_*, right_* and up_* of a camera that looks at the origin.

    Give one camera for all rows as three numbers, not as literal columns: its
    pose is then worked out once and joined as a table of one row.  As literals
    the optimizer would put every stage's expression into the next one's.
    """
    if all(isinstance(x, (int, float)) for x in (pitch, yaw, radius)):
        camera = df.sparkSession.createDataFrame([(float(pitch), float(yaw), float(radius))], "_cp double, _cy double, _cr double")
        posed = with_pose(camera, F.col("_cp"), F.col("_cy"), F.col("_cr")).drop("_cp", "_cy", "_cr")
        return df.crossJoin(F.broadcast(posed))  # one row by construction
    pitch, yaw, radius = (x if isinstance(x, Column) else F.lit(float(x)) for x in (pitch, yaw, radius))
    return with_axes(with_position(df, pitch, yaw, radius), tuple(-x for x in V.cols("pos")))


def with_position(df: DataFrame, pitch: Column, yaw: Column, radius: Column) -> DataFrame:
    """Adds the clamped angles, radius and pos_* of a camera in orbit around the origin."""
    out = with_orbit_angles(df, pitch, yaw).drop("dir_x", "dir_y", "dir_z")
    out = out.withColumns({"radius": F.greatest(F.lit(0.01), finite(radius, 1.0)), "_p": to_radians(F.col("pitch_degrees")), "_y": to_radians(F.col("yaw_degrees"))})
    return out.withColumns(V.named("pos", tuple(F.col("radius") * x for x in direction_of(F.col("_p"), F.col("_y"))))).drop("_p", "_y")


def with_axes(df: DataFrame, towards: V.Vec) -> DataFrame:
    """Adds unit vectors fwd_* (along ``towards``), right_* and up_*."""
    up_axis = (F.lit(0.0), F.lit(1.0), F.lit(0.0))
    out = df.withColumns(V.named("fwd", V.normalize(towards)))
    out = out.withColumns(V.named("right", V.normalize(V.cross(V.cols("fwd"), up_axis))))
    return out.withColumns(V.named("up", V.normalize(V.cross(V.cols("right"), V.cols("fwd")))))


def with_contract(df: DataFrame, frame_width: Column, frame_height: Column, width: Column, height: Column, pitch: Column | float, yaw: Column | float, radius: Column | float, fov: Column) -> DataFrame:
    """Adds a pose and fov_degrees, tan_half_fov, aspect, frame_x, frame_y, view_width, view_height of a planar painting's camera.

    Frame sides are divided by the longer one, and by 1 if both are shorter.
    """
    out = with_pose(df, pitch, yaw, radius)
    out = out.withColumns({"view_width": F.greatest(F.lit(1.0), finite(width, 1.0)), "view_height": F.greatest(F.lit(1.0), finite(height, 1.0)), "fov_degrees": F.greatest(F.lit(1.0), finite(fov, FOV)), "_w": finite(frame_width, 1.0), "_h": finite(frame_height, 1.0)})
    side = F.greatest(F.lit(1.0), F.col("_w"), F.col("_h"))
    return out.withColumns({"tan_half_fov": half_tangent(F.col("fov_degrees")), "aspect": F.col("view_width") / F.col("view_height"), "frame_x": F.greatest(F.lit(EPSILON), F.col("_w") / side), "frame_y": F.greatest(F.lit(EPSILON), F.col("_h") / side)}).drop("_w", "_h")


def half_tangent(fov_degrees: Column) -> Column:
    return F.tan(fov_degrees * F.lit(math.pi) / F.lit(360.0))


def usable(*parts: Column, depth: Column) -> Column:
    total = depth
    for p in parts:
        total = total + p
    return ~F.isnan(total) & (F.abs(total) < float("inf")) & ~F.isnan(depth) & (depth > EPSILON)


def project_planar(df: DataFrame, px: Column, py: Column, z: Column) -> DataFrame:
    """Adds ndc_x, ndc_y (downwards), depth and valid for a point of the painting's plane, under ``with_contract``."""
    out = df.withColumns({"_wx": F.col("frame_x") * finite(px), "_wy": -F.col("frame_y") * finite(py), "_wz": finite(z)})
    world = (F.col("_wx"), F.col("_wy"), F.col("_wz"))
    out = out.withColumn("depth", F.col("radius") + V.dot(world, V.cols("fwd")))
    reach = F.col("depth") * F.col("tan_half_fov")
    out = out.withColumns({"ndc_x": V.dot(world, V.cols("right")) / F.greatest(F.lit(EPSILON), reach * F.col("aspect")), "ndc_y": -V.dot(world, V.cols("up")) / F.greatest(F.lit(EPSILON), reach)})
    return out.withColumn("valid", usable(F.col("ndc_x"), F.col("ndc_y"), depth=F.col("depth"))).drop("_wx", "_wy", "_wz")


def unproject_planar(df: DataFrame, u: Column, v: Column, z: Column) -> DataFrame:
    """Adds plane_x, plane_y and plane_valid: the point of the plane at height ``z`` seen at (u, v).

    The ray from the camera through (u, v) is followed to the plane.  A ray
    along the plane (its slope against the plane, in units of the frame and the
    lens, is below the tolerance) gives the origin and false; a z that is no
    number gives no number and false.
    """
    across = F.greatest(F.lit(EPSILON), F.col("tan_half_fov") * F.col("aspect"))
    upwards = F.greatest(F.lit(EPSILON), F.col("tan_half_fov"))
    out = df.withColumns({"_a": finite(u) * across, "_b": finite(v) * upwards, "_z": F.coalesce(z, F.lit(0.0)), "_unit": F.col("frame_x") * F.col("frame_y") / (across * upwards)})
    out = out.withColumns(V.named("_ray", tuple(f + F.col("_a") * r - F.col("_b") * t for f, r, t in zip(V.cols("fwd"), V.cols("right"), V.cols("up"), strict=True))))
    slope = F.col("_ray_z") * F.col("_unit")
    out = out.withColumn("_along", F.isnan(slope) | (F.abs(slope) == float("inf")) | (F.abs(slope) < EPSILON))
    out = out.withColumn("_reach", F.try_divide(F.col("_z") - F.col("pos_z"), F.col("_ray_z")))
    hit = lambda axis, unit: F.when(F.col("_along"), F.lit(0.0)).otherwise((F.col(f"pos_{axis}") + F.col("_reach") * F.col(f"_ray_{axis}")) / unit)
    out = out.withColumns({"plane_x": hit("x", F.col("frame_x")), "plane_y": hit("y", -F.col("frame_y"))})
    total = F.col("plane_x") + F.col("plane_y")
    return out.withColumn("plane_valid", ~F.col("_along") & ~F.isnan(total) & (F.abs(total) < float("inf"))).drop("_a", "_b", "_z", "_unit", "_ray_x", "_ray_y", "_ray_z", "_along", "_reach")


def project_world(df: DataFrame, point: V.Vec, width: Column, height: Column, fov: Column, prefix: str = "") -> DataFrame:
    """Adds {prefix}x, y (pixels, downwards), ndc_x, ndc_y (upwards), depth and valid of a world point under ``with_pose``."""
    out = df.withColumns({"_w": F.greatest(F.lit(1.0), finite(width, 1.0)), "_h": F.greatest(F.lit(1.0), finite(height, 1.0))} | V.named("_rel", tuple(finite(p) - q for p, q in zip(point, V.cols("pos"), strict=True))))
    out = out.withColumn(f"{prefix}depth", V.dot(V.cols("_rel"), V.cols("fwd")))
    out = out.withColumn("_hh", F.col(f"{prefix}depth") * half_tangent(F.greatest(F.lit(1.0), finite(fov, FOV))))
    out = out.withColumns({f"{prefix}ndc_x": V.dot(V.cols("_rel"), V.cols("right")) / F.greatest(F.lit(EPSILON), F.col("_hh") * F.col("_w") / F.col("_h")), f"{prefix}ndc_y": V.dot(V.cols("_rel"), V.cols("up")) / F.greatest(F.lit(EPSILON), F.col("_hh"))})
    x, y = F.col(f"{prefix}ndc_x"), F.col(f"{prefix}ndc_y")
    out = out.withColumns({f"{prefix}x": (x + 1) * F.col("_w") * 0.5, f"{prefix}y": (1 - y) * F.col("_h") * 0.5, f"{prefix}valid": usable(x, y, depth=F.col(f"{prefix}depth"))})
    return out.drop("_w", "_h", "_rel_x", "_rel_y", "_rel_z", "_hh")


def frame_corner(half_x: Column, half_y: Column, corner: int) -> V.Vec:
    """The world point of a frame's corner (0 to 3)."""
    sx, sy = CORNERS[corner]
    held = lambda x: F.greatest(F.lit(EPSILON), finite(x, 1.0))
    return (held(half_x) * sx, held(half_y) * sy, F.lit(0.0))


def explode_frame_corners(df: DataFrame, half_x: Column, half_y: Column) -> DataFrame:
    """Four rows per frame: corner (0 to 3) and corner_x, corner_y, corner_z = 0."""
    rows = F.array(*[F.struct(F.lit(i).alias("corner"), *[p.alias(f"corner_{c}") for p, c in zip(frame_corner(half_x, half_y, i), "xyz", strict=True)]) for i in range(len(CORNERS))])
    return df.withColumn("_c", F.explode(rows)).select(*df.columns, "_c.*")


def project_frame_corners(df: DataFrame, half_x: Column, half_y: Column, width: Column, height: Column, fov: Column) -> DataFrame:
    """The four corners of each posed frame, projected."""
    return project_world(explode_frame_corners(df, half_x, half_y), V.cols("corner"), width, height, fov)


def inside(margin: float | Column, prefix: str = "") -> Column:
    """Whether a projected point is valid and within the margin of both axes."""
    return F.col(f"{prefix}valid") & (F.abs(F.col(f"{prefix}ndc_x")) <= margin) & (F.abs(F.col(f"{prefix}ndc_y")) <= margin)


def camera_diagnostics(df: DataFrame, half_x: Column, half_y: Column, width: Column, height: Column, pitch: Column | float, yaw: Column | float, radius: Column | float, fov: Column) -> DataFrame:
    """Pose, projected origin (center_*) and the four projected corners, a row each."""
    origin = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    posed = project_world(with_pose(df, pitch, yaw, radius), origin, width, height, fov, "center_")
    return project_frame_corners(posed, half_x, half_y, width, height, fov)
