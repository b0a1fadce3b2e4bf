"""Queries over the test tables, and what DuckDB says for the same tables.

Tables stand in for the inputs of camera tools: events are cameras (pitch from
the value, yaw from ``props.k``), embeddings are points, parts are frames,
pages and documents are texts.  Doubles are rounded to six decimals on both
sides, as sums and trigonometric functions may differ in the last bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, markup, scalars
from ..functions import vectors as V
from ..operators import cameras, compositing, images, poses, projection, rules
from ..sources import ply, stores
from ..streaming import sessions
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RADIUS, VIEW_WIDTH, VIEW_HEIGHT = 3.0, 1280.0, 720.0


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: Column | str) -> Column:
    return scalars.rounded(F.col(column) if isinstance(column, str) else column)


def rounded_all(df: DataFrame, *columns: str) -> list[Column]:
    return [r6(c).alias(c) for c in columns]


def event_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_type") == "view", "front").otherwise("virtual").alias("kind"), (F.col("value") - 100).alias("pitch_degrees"), (k - 50).alias("yaw_degrees"), (F.col("user_id") % 5).cast("double").alias("multiplicity"), F.lit("7").alias("active_camera_id"), F.lit(RADIUS).alias("orbit_radius"), F.lit(16 / 9).alias("image_aspect"))


def chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(vec_id, label, piece, v0, v1, ...): every embedding in consecutive pieces of ``size`` numbers, the last filled with zeros."""
    e = F.col("embedding")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(e) / size).cast("int") - 1), lambda i: F.struct(*[F.coalesce(F.get(e, i * size + j).cast("double"), F.lit(0.0)).alias(f"v{j}") for j in range(size)]))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(pieces).alias("piece", "_v")).select("vec_id", "label", "piece", "_v.*")


def chunks_sql(size: int) -> str:
    values = ", ".join(f"coalesce(embedding[{size} * piece + {j + 1}], 0)::DOUBLE AS v{j}" for j in range(size))
    return f"(SELECT vec_id, label, piece::INTEGER AS piece, {values} FROM (SELECT *, unnest(range((len(embedding) + {size - 1}) // {size})) AS piece FROM embeddings) AS x)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir, 3).select("vec_id", "piece", *[F.col(f"v{i}").alias(f"p_{c}") for i, c in enumerate("xyz")])


def part_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / F.lit(20.0)).alias("half_x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("half_y"))


# --- angles and poses ------------------------------------------------------


@query(f"""
WITH {sql.orbit("SELECT event_id, value - 100 AS pitch, (props->>'$.k')::DOUBLE - 50 AS yaw FROM events", "89")}
SELECT event_id, {sql.r6("pitch_degrees", "yaw_degrees", "polar_degrees", "dir_x", "dir_y", "dir_z")} FROM orbit
""")
def clamp_orbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = event_cameras(spark, sf_dir).select(F.col("ord").alias("event_id"), F.col("pitch_degrees").alias("a"), F.col("yaw_degrees").alias("b"))
    out = projection.with_orbit_angles(cams, F.col("a"), F.col("b"))
    return out.select("event_id", *rounded_all(out, "pitch_degrees", "yaw_degrees", "polar_degrees", "dir_x", "dir_y", "dir_z"))


@query(f"""
WITH {sql.orbit("SELECT event_id, value - 100 AS pitch, (props->>'$.k')::DOUBLE - 50 AS yaw FROM events", "89")},
{sql.pose("greatest(0.01, 1 + event_id % 7)")}
SELECT event_id, {sql.r6("radius", "pos_x", "pos_y", "pos_z", "fwd_x", "fwd_y", "fwd_z", "right_x", "right_y", "right_z", "up_x", "up_y", "up_z")} FROM pose
""")
def camera_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = event_cameras(spark, sf_dir).select(F.col("ord").alias("event_id"), F.col("pitch_degrees").alias("a"), F.col("yaw_degrees").alias("b"))
    out = projection.with_pose(cams, F.col("a"), F.col("b"), (1 + F.col("event_id") % 7).cast("double"))
    return out.select("event_id", *rounded_all(out, "radius", *[f"{v}_{c}" for v in ("pos", "fwd", "right", "up") for c in "xyz"]))


@query(f"""
WITH p AS (SELECT vec_id, piece, v0 AS x, v1 AS y, v2 AS z FROM {chunks_sql(3)} AS e),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS len FROM p)
SELECT vec_id, piece, {sql.r6("len")}, {", ".join(f"round(CASE WHEN len < 1e-9 THEN 0 ELSE {c} / len END, 6) + 0.0 AS unit_{c}" for c in "xyz")} FROM n
""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    p = p.withColumn("len", V.length(V.cols("p")))
    unit = V.normalize(V.cols("p"), F.col("len"))
    return p.select("vec_id", "piece", r6("len").alias("len"), *[r6(x).alias(f"unit_{c}") for x, c in zip(unit, "xyz", strict=True)])


@query(f"""
WITH {sql.spirals("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_suppkey % 60 END AS count, s_suppkey % 100 AS cap FROM supplier")}
SELECT s_suppkey, index, id, {sql.r6("fraction", "polar_degrees", "azimuth_degrees", "pitch_degrees", "yaw_degrees", "dir_x", "dir_y", "dir_z")} FROM fib
""")
def fib_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spiral for each supplier, of a size and a cap of its own; every fifth has the default size."""
    key = F.col("s_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(key % 5 != 0, key % 60).cast("double").alias("count"), (key % 100).cast("double").alias("cap"))
    out = poses.explode_poses(suppliers, F.col("count"), F.col("cap"))
    return out.select("s_suppkey", "index", "id", *rounded_all(out, "fraction", "polar_degrees", "azimuth_degrees", "pitch_degrees", "yaw_degrees", "dir_x", "dir_y", "dir_z"))


# --- projections -----------------------------------------------------------


@query(f"""
WITH {sql.orbit(f"SELECT vec_id, piece, v0 * 4 AS px, v1 * 4 AS py, v2 * 4 AS pz, 15.0 AS pitch, -30.0 AS yaw FROM {chunks_sql(3)} AS e", "89")},
{sql.pose("1.5")},
{sql.projected("px", "py", "pz", "1280.0", "720.0", "50.0")}
SELECT vec_id, piece, {sql.r6("depth", *[f"CASE WHEN valid THEN {c} END AS {c}" for c in ("ndc_x", "ndc_y", "x", "y")])}, valid FROM projected
""")
def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places on the screen of points before the camera; those behind it have none."""
    p = points(spark, sf_dir)
    posed = projection.with_pose(p, 15.0, -30.0, 1.5)
    out = projection.project_world(posed, tuple(x * 4 for x in V.cols("p")), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), F.lit(50.0))
    return out.select("vec_id", "piece", r6("depth").alias("depth"), *[r6(F.when(F.col("valid"), F.col(c))).alias(c) for c in ("ndc_x", "ndc_y", "x", "y")], "valid")


@query(f"""
WITH {sql.orbit(f"SELECT vec_id, piece, v0 AS px, v1 AS py, v2 AS pz, vec_id % 60 - 30.0 AS pitch, vec_id % 80 - 40.0 AS yaw FROM {chunks_sql(3)} AS e", "89")},
{sql.pose("2.0")},
w AS (SELECT *, px AS wx, -0.5625 * py AS wy, pz AS wz, tan(radians(25.0)) AS t FROM pose),
d AS (SELECT *, radius + (wx * fwd_x + wy * fwd_y + wz * fwd_z) AS depth FROM w),
n AS (SELECT *, (wx * right_x + wy * right_y + wz * right_z) / greatest(1e-9, depth * t * (1280.0 / 720.0)) AS ndc_x, -(wx * up_x + wy * up_y + wz * up_z) / greatest(1e-9, depth * t) AS ndc_y FROM d)
SELECT vec_id, piece, {sql.r6("ndc_x", "ndc_y", "depth")}, depth > 1e-9 AS valid, round(px, 6) + 0.0 AS plane_x, round(py, 6) + 0.0 AS plane_y, true AS plane_valid FROM n
""")
def planar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a plane are projected and found again."""
    p = points(spark, sf_dir)
    seen = projection.with_contract(p, F.lit(1280.0), F.lit(720.0), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), (F.col("vec_id") % 60 - 30).cast("double"), (F.col("vec_id") % 80 - 40).cast("double"), F.lit(2.0), F.lit(50.0))
    seen = projection.project_planar(seen, F.col("p_x"), F.col("p_y"), F.col("p_z"))
    out = projection.unproject_planar(seen, F.col("ndc_x"), F.col("ndc_y"), F.col("p_z"))
    return out.select("vec_id", "piece", *rounded_all(out, "ndc_x", "ndc_y", "depth"), "valid", *rounded_all(out, "plane_x", "plane_y"), "plane_valid")


CORNER_SQL = "(VALUES (0, -1, 1), (1, 1, 1), (2, 1, -1), (3, -1, -1)) AS c(corner, sx, sy)"


@query(f"""
WITH {sql.orbit(f"SELECT p_partkey, corner, p_size / 20.0::DOUBLE * sx AS px, p_retailprice / 1000.0::DOUBLE * sy AS py, 0.0 AS pz, 20.0 AS pitch, p_partkey % 90 - 45.0 AS yaw FROM part, {CORNER_SQL}", "89")},
{sql.pose("3.0")},
{sql.projected("px", "py", "pz", "1280.0", "720.0", "50.0")}
SELECT p_partkey, corner, round(px, 6) + 0.0 AS corner_x, round(py, 6) + 0.0 AS corner_y, {sql.r6("ndc_x", "ndc_y", "depth", "x", "y")}, valid, valid AND abs(ndc_x) <= 0.9 AND abs(ndc_y) <= 0.9 AS inside FROM projected
""")
def frame_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = part_frames(spark, sf_dir)
    out = projection.camera_diagnostics(frames, F.col("half_x"), F.col("half_y"), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), F.lit(20.0), (F.col("p_partkey") % 90 - 45).cast("double"), F.lit(RADIUS), F.lit(50.0))
    return out.select("p_partkey", "corner", *rounded_all(out, "corner_x", "corner_y", "ndc_x", "ndc_y", "depth", "x", "y"), "valid", projection.inside(0.9).alias("inside"))


@query(f"""
WITH {sql.orbit("SELECT p_partkey, p_partkey % 120 - 60.0 AS pitch, p_partkey % 100 - 50.0 AS yaw FROM part", "89")},
{sql.pose("3.0")},
{sql.projected("0.0", "0.0", "0.0", "1280.0", "720.0", "50.0")}
SELECT p_partkey, {sql.r6("depth", "x", "y")}, valid FROM projected
""")
def frame_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = part_frames(spark, sf_dir)
    posed = projection.with_pose(frames, (F.col("p_partkey") % 120 - 60).cast("double"), (F.col("p_partkey") % 100 - 50).cast("double"), F.lit(RADIUS))
    out = projection.project_world(posed, (F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), F.lit(50.0))
    return out.select("p_partkey", *rounded_all(out, "depth", "x", "y"), "valid")


FRAMES_SQL = "SELECT p_partkey, p_size / 20.0::DOUBLE AS fx, p_retailprice / 1000.0::DOUBLE AS fy, {view} FROM part"


@query(sql.fit(FRAMES_SQL.format(view="(1280.0 / 720.0)::DOUBLE AS aspect")))
def fit_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = part_frames(spark, sf_dir)
    out = poses.fit_radius(frames, ["p_partkey"], F.col("half_x"), F.col("half_y"), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT))
    return out.select("p_partkey", r6("fit_radius").alias("fit_radius"))


def view_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as frames of viewers that differ in field of view, largest angle and margin; every third is tiny."""
    key = F.col("p_partkey")
    scale = F.when(key % 3 == 0, 0.0005).otherwise(1.0)
    options = {"fov": (key % 70).cast("double"), "angle": (key % 95).cast("double"), "margin": (key % 110).cast("double") / 100}
    return part_frames(spark, sf_dir).withColumns({"half_x": F.col("half_x") * scale, "half_y": F.col("half_y") * scale} | options)


@query(sql.fit_views("""
SELECT p_partkey, p_size / 20.0::DOUBLE * k AS fx, p_retailprice / 1000.0::DOUBLE * k AS fy, (800.0 / 600.0)::DOUBLE AS aspect, greatest(25, least(55, CASE WHEN p_partkey % 70 = 0 THEN 50 ELSE p_partkey % 70 END)) AS fov,
       CASE WHEN p_partkey % 95 = 0 THEN 89 ELSE least(89, p_partkey % 95) END AS cap, greatest(0.5, least(0.98, p_partkey % 110 / 100.0::DOUBLE)) AS margin FROM (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0.0005 ELSE 1 END::DOUBLE AS k FROM part) AS p
"""))
def fit_radius_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = view_frames(spark, sf_dir)
    out = poses.fit_radius(frames, ["p_partkey"], F.col("half_x"), F.col("half_y"), F.lit(800.0), F.lit(600.0), fov=scalars.shared_fov(F.col("fov")), max_angle=scalars.max_camera_angle(F.col("angle")), margin=F.col("margin"))
    return out.select("p_partkey", r6("fit_radius").alias("fit_radius"))


@query(sql.fit(FRAMES_SQL.format(view="greatest(1, p_size / 20.0::DOUBLE * 1024 / greatest(p_size / 20.0::DOUBLE, p_retailprice / 1000.0::DOUBLE)) / greatest(1, p_retailprice / 1000.0::DOUBLE * 1024 / greatest(p_size / 20.0::DOUBLE, p_retailprice / 1000.0::DOUBLE)) AS aspect")))
def canonical_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = part_frames(spark, sf_dir)
    out = poses.canonical_radius(frames, ["p_partkey"], F.col("half_x"), F.col("half_y"))
    return out.select("p_partkey", r6("fit_radius").alias("fit_radius"))


@query(f"""
WITH {sql.orbit(f"SELECT p_partkey, corner, p_size / 20.0::DOUBLE * sx AS px, p_retailprice / 1000.0::DOUBLE * sy AS py, 0.0 AS pz, 20.0 AS pitch, p_partkey % 90 - 45.0 AS yaw FROM part, {CORNER_SQL}", "89")},
{sql.pose("3.0")},
{sql.projected("px", "py", "pz", "1280.0", "720.0", "50.0")}
SELECT p_partkey, coalesce(bool_and(valid AND abs(ndc_x) <= 0.9 AND abs(ndc_y) <= 0.9), true) AS all_inside, coalesce(bool_or(valid AND abs(ndc_x) <= 0.9 AND abs(ndc_y) <= 0.9), false) AS any_inside FROM projected GROUP BY 1
""")
def frames_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = part_frames(spark, sf_dir)
    seen = projection.camera_diagnostics(frames, F.col("half_x"), F.col("half_y"), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), F.lit(20.0), (F.col("p_partkey") % 90 - 45).cast("double"), F.lit(RADIUS), F.lit(50.0))
    return poses.all_inside(seen, ["p_partkey"], projection.inside(0.9))


@query(f"""
WITH {sql.orbit(f"SELECT p_partkey, corner, p_size / 20.0::DOUBLE * sx AS px, p_retailprice / 1000.0::DOUBLE * sy AS py, 0.0 AS pz, 20.0 AS pitch, 10.0 AS yaw FROM part, {CORNER_SQL}", "89")},
{sql.pose("32.0")},
{sql.projected("px", "py", "pz", "1280.0", "720.0", "50.0")},
m AS (SELECT p_partkey, x - round(x, 2) AS ex, y - round(y, 2) AS ey FROM projected)
SELECT p_partkey, round(max(sqrt(ex * ex + ey * ey)), 6) + 0.0 AS corner_error_max_px FROM m GROUP BY 1
""")
def corner_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of corners that were kept with two decimals."""
    frames = part_frames(spark, sf_dir)
    exact = projection.camera_diagnostics(frames, F.col("half_x"), F.col("half_y"), F.lit(VIEW_WIDTH), F.lit(VIEW_HEIGHT), 20.0, 10.0, 32.0, F.lit(50.0)).select("p_partkey", "corner", "x", "y")
    kept = exact.select("p_partkey", "corner", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))
    out = cameras.corner_error(exact, kept, ["p_partkey"])
    return out.select("p_partkey", r6("corner_error_max_px").alias("corner_error_max_px"))


# --- camera pools ----------------------------------------------------------

MARKERS_SQL = f"""
c AS (SELECT event_id AS ord, event_id::VARCHAR AS id, CASE WHEN event_type = 'view' THEN 'front' ELSE 'virtual' END AS kind, value - 100 AS pitch, (props->>'$.k')::DOUBLE - 50 AS yaw, greatest(1, floor((user_id % 5)::DOUBLE + 0.5))::BIGINT AS m FROM events),
k AS (SELECT *, printf('%.6f:%.6f', pitch + 0.0, yaw + 0.0) AS angle_key FROM c),
g AS (SELECT angle_key, min(ord) AS first_ord, arg_min(id, ord) AS first_id, arg_min(kind, ord) AS kind, arg_min(pitch, ord) AS pitch, arg_min(yaw, ord) AS yaw, count(*) AS cameras, sum(m)::BIGINT AS multiplicity, bool_or(id = '7') AS active FROM k GROUP BY angle_key)"""


@query(f"""
WITH {MARKERS_SQL},
{sql.orbit("SELECT * FROM g", "89")}
SELECT angle_key, first_ord, first_id, kind, {sql.r6("pitch_degrees", "yaw_degrees")}, 50.0::DOUBLE AS fov_degrees, cameras, multiplicity, active FROM orbit ORDER BY first_ord
""")
def camera_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cameras.dedupe_cameras(event_cameras(spark, sf_dir))
    out = projection.with_orbit_angles(found, F.col("raw_pitch"), F.col("raw_yaw"))
    return out.select("angle_key", "first_ord", "first_id", "kind", *rounded_all(out, "pitch_degrees", "yaw_degrees"), "fov_degrees", "cameras", "multiplicity", "active").orderBy("first_ord")


@query("""
WITH c AS (SELECT event_id AS ord, event_id::VARCHAR AS member_id, value - 100 AS pitch, (props->>'$.k')::DOUBLE - 50 AS yaw FROM events)
SELECT printf('%.6f:%.6f', pitch + 0.0, yaw + 0.0) AS angle_key, ord, member_id FROM c
""")
def camera_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.marker_members(event_cameras(spark, sf_dir))


@query(f"""
WITH {MARKERS_SQL}
SELECT count(*) AS marker_count, coalesce(sum(multiplicity), 0)::BIGINT AS sample_count, count(*) FILTER (WHERE kind = 'front') AS front_count, count(*) FILTER (WHERE kind <> 'front') AS virtual_count,
       coalesce(sum(multiplicity) FILTER (WHERE kind = 'front'), 0)::BIGINT AS front_samples, coalesce(sum(multiplicity) FILTER (WHERE kind <> 'front'), 0)::BIGINT AS virtual_samples, bool_or(active) AS any_active FROM g
""")
def camera_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.marker_summary(cameras.dedupe_cameras(event_cameras(spark, sf_dir)))


@query(f"""
WITH {MARKERS_SQL},
{sql.orbit("SELECT *, 3.0::DOUBLE AS scale_radius FROM g", "89")},
{sql.pose("3.0")},
f AS (SELECT *, radius * 0.055 AS d, radius * 0.055 * tan(radians(25.0)) AS hh, radius * 0.055 * tan(radians(25.0)) * (16 / 9::DOUBLE) AS hw, radius * CASE WHEN active THEN 0.025 ELSE 0.016 END AS s FROM pose),
cc AS (SELECT first_ord, active, kind, corner, pos_x, pos_y, pos_z, s, {", ".join(f"pos_{c} + fwd_{c} * d + right_{c} * hw * sx + up_{c} * hh * sy AS c_{c}" for c in "xyz")} FROM f, {CORNER_SQL}),
segs AS (
  SELECT first_ord, active, kind, axis AS segment, 'axis' AS part, pos_x - CASE WHEN axis = 0 THEN s ELSE 0 END AS from_x, pos_y - CASE WHEN axis = 1 THEN s ELSE 0 END AS from_y, pos_z - CASE WHEN axis = 2 THEN s ELSE 0 END AS from_z,
         pos_x + CASE WHEN axis = 0 THEN s ELSE 0 END AS to_x, pos_y + CASE WHEN axis = 1 THEN s ELSE 0 END AS to_y, pos_z + CASE WHEN axis = 2 THEN s ELSE 0 END AS to_z FROM f, (VALUES (0), (1), (2)) AS a(axis)
  UNION ALL SELECT first_ord, active, kind, 3 + 2 * corner, 'spoke', pos_x, pos_y, pos_z, c_x, c_y, c_z FROM cc
  UNION ALL SELECT a.first_ord, a.active, a.kind, 4 + 2 * a.corner, 'edge', a.c_x, a.c_y, a.c_z, b.c_x, b.c_y, b.c_z FROM cc a JOIN cc b ON a.first_ord = b.first_ord AND b.corner = (a.corner + 1) % 4)
SELECT first_ord, segment, part, CASE WHEN active THEN 'active' ELSE kind END AS style, {sql.r6("from_x", "from_y", "from_z", "to_x", "to_y", "to_z")} FROM segs
""")
def marker_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = cameras.with_frustum(cameras.dedupe_cameras(event_cameras(spark, sf_dir)))
    out = cameras.marker_segments(markers, ["first_ord"])
    return out.select("first_ord", "segment", "part", "style", *rounded_all(out, "from_x", "from_y", "from_z", "to_x", "to_y", "to_z"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool per user, in the form in which viewers send it: its cameras are all the user's events."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    camera = F.struct("event_id", F.struct(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 3 == 0, "front").otherwise("virtual").alias("kind"), (F.col("value") - 100).alias("pitch_degrees"), (F.col("k") - 50).alias("yaw_degrees"), (F.col("event_id") % 4).cast("double").alias("multiplicity")).alias("camera"))
    per = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(camera)), lambda x: F.struct(*[x["camera"][c].alias(c) for c in ("id", "kind", "pitch_degrees", "yaw_degrees", "multiplicity")], F.create_map(F.lit("fov_degrees"), F.lit("40")).alias("intrinsics"))).alias("cameras"), F.min("event_id").cast("string").alias("active_camera_id"))
    return per.select("user_id", "cameras", F.lit(RADIUS).alias("orbit_radius"), F.lit(45.0).alias("fov_degrees"), F.lit(16 / 9).alias("image_aspect"), F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("target"), "active_camera_id", F.lit(70.0).alias("max_angle_degrees"), (F.col("user_id") % 2 == 0).alias("sampling_enabled"))


POOLS_SQL = """
pc AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'front' ELSE 'virtual' END AS kind, printf('%.6f:%.6f', value - 100 + 0.0, (props->>'$.k')::DOUBLE - 50 + 0.0) AS angle_key, greatest(1, event_id % 4) AS m FROM events),
pm AS (SELECT user_id, angle_key, arg_min(kind, event_id) AS kind, sum(m)::BIGINT AS m FROM pc GROUP BY ALL),
pu AS (SELECT user_id, min(event_id) AS first_id FROM events GROUP BY 1),
pa AS (SELECT pu.user_id, first_id, bool_or(pc.event_id IS NOT NULL) AS active FROM pu LEFT JOIN pc ON pc.user_id = pu.user_id AND pc.event_id = first_id GROUP BY ALL),
pools AS (SELECT pa.user_id, count(angle_key) AS marker_count, coalesce(sum(m), 0)::BIGINT AS sample_count, count(*) FILTER (WHERE kind = 'front') AS front_count, count(*) FILTER (WHERE kind <> 'front') AS virtual_count,
          coalesce(sum(m) FILTER (WHERE kind = 'front'), 0)::BIGINT AS front_samples, coalesce(sum(m) FILTER (WHERE kind <> 'front'), 0)::BIGINT AS virtual_samples, any_value(active) AS any_active, pa.user_id % 2 = 0 AS sampling_enabled, any_value(first_id)::VARCHAR AS active_camera_id FROM pa LEFT JOIN pm USING (user_id) GROUP BY pa.user_id)"""


@query(f"WITH {POOLS_SQL} SELECT * FROM pools")
def pool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cameras.pool_summary(snapshots(spark, sf_dir), ["user_id"])


@query(f"""
WITH {POOLS_SQL},
se AS (SELECT user_id, arg_max(value - 100, event_id) AS pitch0, arg_max((props->>'$.k')::DOUBLE - 50, event_id) AS yaw0, count(*) FILTER (WHERE event_type = 'view') AS camera_updates, count(*) FILTER (WHERE event_type = 'purchase') AS sorted_frames FROM events GROUP BY 1),
sv AS (SELECT *, user_id % 3 = 0 AS overview, CASE WHEN user_id % 2 = 0 THEN 4.5 ELSE 3.0 END::DOUBLE AS viewer_radius FROM se),
{sql.orbit("SELECT *, CASE WHEN overview THEN 20 ELSE pitch0 END AS pitch, CASE WHEN overview THEN -42 ELSE yaw0 END AS yaw FROM sv", "89")},
{sql.pose("CASE WHEN overview THEN greatest(3.0, viewer_radius) * 2.65 ELSE viewer_radius END")},
d AS (SELECT *, radius * tan(radians(25.0)) AS hh, (-0.8 - pos_x) * fwd_x + (0.6 - pos_y) * fwd_y + (0 - pos_z) * fwd_z AS cd, (-0.8 - pos_x) * right_x + (0.6 - pos_y) * right_y + (0 - pos_z) * right_z AS cr, (-0.8 - pos_x) * up_x + (0.6 - pos_y) * up_y + (0 - pos_z) * up_z AS cu FROM pose)
SELECT user_id, CASE WHEN overview THEN 'camera-pool-overview' ELSE 'center-orbit' END AS view_mode, {sql.r6("pitch0 AS pitch", "viewer_radius", "radius", "fwd_z", "radius AS center_depth")}, 640.0::DOUBLE AS center_x, 360.0::DOUBLE AS center_y,
       round((cr / greatest(1e-9, cd * tan(radians(25.0)) * 1280 / 720) + 1) * 640, 6) + 0.0 AS corner_x, round((1 - cu / greatest(1e-9, cd * tan(radians(25.0)))) * 360, 6) + 0.0 AS corner_y, 4 AS corners, camera_updates, sorted_frames,
       overview AS visible, marker_count, sample_count, front_count, virtual_count, front_samples, virtual_samples, sampling_enabled, active_camera_id FROM d JOIN pools USING (user_id)
""")
def viewer_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record per session, of which this takes the parts."""
    kind, latest = F.col("event_type"), lambda c: F.max_by(c, F.col("event_id"))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(latest(F.col("value") - 100).alias("pitch"), latest(F.get_json_object("props", "$.k").cast("double") - 50).alias("yaw"), F.count_if(kind == "view").alias("camera_updates"), F.count_if(kind == "purchase").alias("sorted_frames"))
    fixed = {"orbit_radius": RADIUS, "fit_radius": 4.5, "half_x": 0.8, "half_y": 0.6, "width": VIEW_WIDTH, "height": VIEW_HEIGHT, "fov_degrees": 50.0, "vertices": 1000.0, "content_digest": ""}
    sessions_ = e.withColumns({c: F.lit(v) for c, v in fixed.items()} | {"radius_mode": F.when(F.col("user_id") % 2 == 0, "fit").otherwise("training"), "overview": F.col("user_id") % 3 == 0})
    out = cameras.diagnostics(sessions_, cameras.pool_summary(snapshots(spark, sf_dir), ["user_id"]), ["user_id"])
    c, first = F.col("camera"), F.col("camera")["corners"][0]
    numbers = {"pitch": F.col("pitch"), "viewer_radius": F.col("viewer_radius"), "radius": c["radius"], "fwd_z": c["forward"]["z"], "center_depth": c["center"]["depth"], "center_x": c["center"]["x"], "center_y": c["center"]["y"], "corner_x": first["x"], "corner_y": first["y"]}
    return out.select("user_id", c["view_mode"].alias("view_mode"), *[r6(x).alias(n) for n, x in numbers.items()], F.size(c["corners"]).alias("corners"), "presentation.*", "camera_markers.*").drop("training_orbit_radius")


# --- viewer parameters and sessions ----------------------------------------


@query("""
SELECT p_partkey, least(30000, greatest(5000, 5000 + p_partkey * 1000.0::DOUBLE / 50000 * 1000)) AS timeout_ms FROM part
""")
def sort_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.sort_timeout_ms(F.col("p_partkey") * 1000).alias("timeout_ms"))


@query(f"""
WITH e AS (SELECT event_id, value - 100 AS pitch, (props->>'$.k')::DOUBLE - 50 AS yaw, event_type = 'view' AS overview, CASE WHEN event_type = 'click' THEN 4.5 ELSE 3.0 END AS viewer, (user_id % 60)::DOUBLE AS fov, (user_id % 100)::DOUBLE AS angle FROM events)
SELECT event_id, CASE WHEN overview THEN 'camera-pool-overview' ELSE 'center-orbit' END AS view_mode, {sql.r6("CASE WHEN overview THEN 20 ELSE pitch END AS view_pitch", "CASE WHEN overview THEN -42 ELSE yaw END AS view_yaw", "CASE WHEN overview THEN greatest(3.0, viewer) * 2.65 ELSE viewer END AS view_radius")},
       greatest(25, least(55, CASE WHEN fov = 0 THEN 50 ELSE fov END))::DOUBLE AS fov_degrees, greatest(0, least(89, CASE WHEN angle = 0 THEN 89 ELSE angle END))::DOUBLE AS max_angle FROM e
""")
def view_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mode = scalars.radius_mode(F.when(F.col("event_type") == "click", "fit"))
    out = cameras.view_parameters(e, F.col("event_type") == "view", F.col("value") - 100, F.get_json_object("props", "$.k").cast("double") - 50, F.lit(RADIUS), F.lit(4.5), mode)
    return out.select("event_id", "view_mode", *rounded_all(out, "view_pitch", "view_yaw", "view_radius"), scalars.shared_fov((F.col("user_id") % 60).cast("double")).alias("fov_degrees"), scalars.max_camera_angle((F.col("user_id") % 100).cast("double")).alias("max_angle"))


@query("""
SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS pitch, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'error')) AS mode, arg_max(event_id, event_id) FILTER (WHERE event_type = 'signup') AS active_camera FROM events GROUP BY 1
""")
def session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return sessions.last_settings(table(spark, sf_dir, "events"), "user_id", F.col("event_id"), {"pitch": (kind == "click", F.col("value")), "mode": (kind.isin("view", "error"), kind), "active_camera": (kind == "signup", F.col("event_id"))})


SESSION_GAP, SESSION_LATE = "2 DAYS", "1 HOUR"


@query("""
WITH s AS (SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS pitch, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'error')) AS mode, max(ts) AS last_seen FROM events GROUP BY 1)
SELECT user_id, pitch, mode, last_seen + INTERVAL 2 DAYS < (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS closed FROM s
""")
def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream that is read to its end; each session's last row, which says whether it had fallen silent by then."""
    out = f"{stores.shared_folder(spark)}/session-stream-{uuid.uuid4().hex}"
    kind = F.col("event_type")
    source = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*").withColumn("ts", F.col("ts").cast("timestamp"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    sessions.use_rocksdb(spark)
    try:
        stream = sessions.session_stream(events, "user_id", "ts", F.col("event_id"), {"pitch": (kind == "click", F.col("value")), "mode": (kind.isin("view", "error"), kind)}, SESSION_GAP, SESSION_LATE)
        save = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows/*")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("pitch", "mode", "closed"), F.struct("batch", F.col("closed").cast("int"))).alias("last"))
    return last.select("user_id", "last.*")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS camera_updates, count(*) FILTER (WHERE event_type = 'purchase') AS sorted_frames FROM events GROUP BY 1
""")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return sessions.event_counters(table(spark, sf_dir, "events"), "user_id", {"camera_updates": kind == "view", "sorted_frames": kind == "purchase"})


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, user_id, count(*) FILTER (WHERE event_type = 'view') AS camera_updates FROM events GROUP BY 1, 2
""")
def windowed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.windowed_counters(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "user_id", {"camera_updates": F.col("event_type") == "view"})


# --- binary and file sets --------------------------------------------------


@query("""
SELECT p_partkey, p_size::DOUBLE AS vertices, octet_length(encode('ply' || chr(10) || 'format binary_little_endian 1.0' || chr(10) || 'element vertex ' || p_size || chr(10) || 'end_header' || chr(10)))::BIGINT AS bytes FROM part
""")
def ply_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.concat(F.lit("ply\nformat binary_little_endian 1.0\nelement vertex "), F.col("p_size").cast("string"), F.lit("\nend_header\n")).cast("binary")
    return table(spark, sf_dir, "part").select("p_partkey", binary.ply_vertex_count(header).alias("vertices"), F.octet_length(header).cast("long").alias("bytes"))


@query(f"""
SELECT vec_id::INTEGER AS vec_id, piece, {sql.r6("v0::FLOAT::DOUBLE AS x", "v1::FLOAT::DOUBLE AS y", "v2::FLOAT::DOUBLE AS z")} FROM {chunks_sql(3)} AS e
""")
def ply_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as PLY files by tasks, and read back in ranges of records."""
    folder = f"{stores.shared_folder(spark)}/ply-{uuid.uuid4().hex}"
    p = points(spark, sf_dir)
    ply.write_points(p.select(F.col("vec_id").cast("int"), F.col("piece").cast("int"), *[F.col(f"p_{c}").cast("float").alias(c) for c in "xyz"]), folder)
    return ply.read_points(spark, folder).select("vec_id", "piece", *[r6(F.col(c).cast("double")).alias(c) for c in "xyz"])


@query("""
WITH n AS (SELECT label, count(*) AS vectors, sum(((len(embedding) + 2) // 3))::BIGINT AS n FROM embeddings GROUP BY 1)
SELECT sum(n)::BIGINT AS announced, sum(n)::BIGINT AS present, count(*) FILTER (WHERE false) AS problems FROM n
""")
def ply_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of written files announce, and how many records are there."""
    folder = f"{stores.shared_folder(spark)}/ply-{uuid.uuid4().hex}"
    ply.write_points(points(spark, sf_dir).select(F.col("p_x").alias("x"), F.col("p_y").alias("y"), F.col("p_z").alias("z")), folder)
    return ply.point_files(spark, folder).agg(F.sum("announced").alias("announced"), F.sum("present").alias("present"), F.count("problem").alias("problems"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 < 2 THEN 1280 ELSE p_size END::BIGINT AS width, CASE WHEN p_partkey % 5 < 3 THEN 720 ELSE p_partkey % 100000 END::BIGINT AS height, p_partkey % 5 < 2 AS is_screenshot FROM part
""")
def png_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made from the table: signature, first chunk, width and height."""
    number = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    head = F.unhex(F.concat(F.lit(binary.PNG_SIGNATURE + "0000000D49484452"), number(F.when(F.col("p_partkey") % 5 < 2, 1280).otherwise(F.col("p_size"))), number(F.when(F.col("p_partkey") % 5 < 3, 720).otherwise(F.col("p_partkey") % 100000))))
    return table(spark, sf_dir, "part").select("p_partkey", binary.png_width(head).alias("width"), binary.png_height(head).alias("height"), binary.is_screenshot(head).alias("is_screenshot"))


@query("""
WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 11 BETWEEN 1 AND 8 THEN p_partkey % 11 END::INTEGER AS orientation, (p_size * 97 % 9000 + 1)::INTEGER AS width, (p_partkey * 31 % 5000 + 1)::INTEGER AS height FROM part),
d AS (SELECT p_partkey, orientation, CASE WHEN orientation >= 5 THEN height ELSE width END AS w, CASE WHEN orientation >= 5 THEN width ELSE height END AS h FROM p)
SELECT p_partkey, orientation, w AS shown_width, h AS shown_height, greatest(1, floor(w * least(1.0, 4096::DOUBLE / greatest(w, h)) + 0.5))::INTEGER AS cached_width, greatest(1, floor(h * least(1.0, 4096::DOUBLE / greatest(w, h)) + 0.5))::INTEGER AS cached_height FROM d
""")
def image_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JPEG headers made from the table, of both byte orders and with other segments before; every seventh has a broken directory offset."""
    key = F.col("p_partkey")
    word = lambda c, size: F.lpad(F.hex(c.cast("long")), 2 * size, "0")
    swap = lambda c: F.array_join(F.reverse(F.regexp_extract_all(c, F.lit(".."), F.lit(0))), "")
    own = lambda c, size: F.when(key % 2 == 0, word(c, size)).otherwise(swap(word(c, size)))
    filler = F.lit("FFFE0006AABBCCDD")
    entry = lambda tag, value: F.concat(own(F.lit(tag), 2), own(F.lit(3), 2), own(F.lit(1), 4), own(value, 2), F.lit("0000"))
    tiff = F.concat(F.when(key % 2 == 0, "4D4D").otherwise("4949"), own(F.lit(42), 2), own(F.when(key % 7 == 6, 50000).otherwise(8), 4), own(F.lit(2), 2), entry(0x010F, key % 9), entry(0x0112, key % 11), F.lit("00000000"))
    exif = F.concat(F.lit("FFE1"), word(F.length(tiff) / 2 + 8, 2), F.lit("457869660000"), tiff)
    width, height = F.col("p_size") * 97 % 9000 + 1, key * 31 % 5000 + 1
    frame = F.concat(F.lit("FFC0000B08"), word(height, 2), word(width, 2), F.lit("01011100"))
    content = F.unhex(F.concat(F.lit("FFD8"), F.when(key % 3 == 0, filler).otherwise(""), exif, filler, frame, F.lit("FFD9")))
    made = table(spark, sf_dir, "part").select("p_partkey", content.alias("content"))
    probed = binary.with_exif_orientation(made, F.col("content")).withColumn("frame", binary.jpeg_frame(F.col("content")))
    shown = dict(zip(("shown_width", "shown_height"), binary.displayed_size(F.col("frame.width"), F.col("frame.height"), F.col("orientation")), strict=True))
    out = probed.withColumns(shown)
    cached = binary.bounded_size(F.col("shown_width"), F.col("shown_height"), images.CACHED_SIDE)
    return out.select("p_partkey", "orientation", "shown_width", "shown_height", cached[0].alias("cached_width"), cached[1].alias("cached_height"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", binary.digest(text).alias("sha256"), F.octet_length(text).cast("long").alias("bytes"))


@query("""
WITH d AS (SELECT CASE WHEN n_chars % 2 = 0 THEN 'd' ELSE 'moved/d' END || doc_id AS path FROM documents), l AS (SELECT 'd' || doc_id AS path FROM labels)
SELECT path, 'unexpected' AS status FROM d WHERE path NOT IN (SELECT path FROM l)
UNION ALL SELECT path, 'missing' FROM l WHERE path NOT IN (SELECT path FROM d)
""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest lists labelled documents; documents of odd length lie elsewhere."""
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    there = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 2 == 0, name).otherwise(F.concat(F.lit("moved/"), name)).alias("path"))
    return rules.manifest_difference(table(spark, sf_dir, "labels").select(name.alias("path")), there, ["path"])


@query("""
WITH s AS (SELECT CASE WHEN lang = 'fr' THEN 'fr/' ELSE '' END || doc_id AS path, sha256(text) AS h FROM documents),
a AS (SELECT CASE WHEN lang = 'de' THEN 'de/' ELSE '' END || doc_id AS path, sha256(CASE WHEN n_chars % 3 = 0 THEN upper(text) ELSE text END) AS h FROM documents)
SELECT coalesce(s.path, a.path) AS path, s.path IS NOT NULL AS source_file, a.path IS NOT NULL AS artifact_file, coalesce(s.h = a.h, false) AS parity FROM s FULL OUTER JOIN a ON s.path = a.path
""")
def byte_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against copies, of which some are altered and some lie elsewhere."""
    d = table(spark, sf_dir, "documents")
    side = lambda lang, text: d.select(F.concat(F.when(F.col("lang") == lang, f"{lang}/").otherwise(""), F.col("doc_id").cast("string")).alias("path"), text.cast("binary").alias("content"))
    return rules.content_parity(side("fr", F.col("text")), side("de", F.when(F.col("n_chars") % 3 == 0, F.upper("text")).otherwise(F.col("text"))))


@query("""
WITH k AS (SELECT *, CASE doc_id % 7 WHEN 1 THEN 'link' ELSE 'file' END AS kind, 'site/' || doc_id AS path FROM documents),
w AS (SELECT DISTINCT 'site/' || doc_id AS path FROM labels),
c AS (SELECT w.path, k.kind = 'file' AS artifact_file, k.path IS NOT NULL AS source_file, k.kind = 'file' AND doc_id % 5 <> 2 AS same FROM w LEFT JOIN k USING (path)),
r AS (SELECT path, unnest(['regular source file', 'regular artifact file', 'byte parity']) AS rule, unnest([source_file, artifact_file, same]) AS passed FROM c),
l AS (SELECT CASE WHEN kind = 'file' THEN path ELSE path || ' (not a regular file)' END AS path FROM k)
SELECT path, rule, coalesce(passed, false) AS passed FROM r
UNION ALL SELECT path, 'missing', false FROM w WHERE path NOT IN (SELECT path FROM l)
UNION ALL SELECT DISTINCT path, 'unexpected', false FROM l WHERE path NOT IN (SELECT path FROM w)
""")
def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site whose files are the documents: some are links there, some are altered, and those without a label are not asked for."""
    path = F.concat(F.lit("site/"), F.col("doc_id").cast("string")).alias("path")
    d, text = table(spark, sf_dir, "documents"), F.col("text")
    source = d.select(path, F.lit("file").alias("kind"), text.cast("binary").alias("content"))
    artifact = d.select(path, F.when(F.col("doc_id") % 7 == 1, "link").otherwise("file").alias("kind"), F.when(F.col("doc_id") % 5 == 2, F.concat(text, F.lit("!"))).otherwise(text).cast("binary").alias("content"))
    return rules.artifact_rules(table(spark, sf_dir, "labels").select(path), source, artifact)


# --- rules over texts ------------------------------------------------------


@query(r"""
WITH p AS (SELECT page_id, html, regexp_extract_all(html, '(?i)<(?:script|link)\b[^>]*>') AS tags FROM pages),
v AS (SELECT *, list_filter(list_transform(tags, lambda t: regexp_extract(t, '(?i)\b(?:src|href)=["'']([^"'']+)["'']', 1)), lambda x: x <> '') AS assets FROM p)
SELECT page_id, regexp_matches(html, '(?i)<html\b[^>]*\blang=["'']en(?:-[A-Za-z0-9]+)?["'']') AND NOT regexp_matches(html, '[ぁ-んァ-ヶ一-龯々]') AS english,
       trim(regexp_extract(html, '(?i)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)["''][^>]*>', 1)) AS description,
       len(assets)::INTEGER AS assets, coalesce(list_bool_and(list_transform(assets, lambda x: NOT regexp_matches(x, '(?i)^(?:https?:)?//'))), true) AS local_assets,
       NOT regexp_matches(html, '(?i)(?:@import|url)\s*(?:\(|)["'']?(?:https?:)?//') AS local_styles FROM v
""")
def html_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", markup.is_english_document(html).alias("english"), markup.meta_content(html, "description").alias("description"), F.size(markup.asset_references(html)).alias("assets"), markup.assets_are_local(html).alias("local_assets"), markup.css_is_local(html).alias("local_styles"))


# --- compositing -----------------------------------------------------------


@query("""
WITH e AS (SELECT user_id, ts::DATE AS day, event_id, value, (props->>'$.k')::DOUBLE / 100 AS a FROM events),
t AS (SELECT *, coalesce(product(1 - a) OVER (PARTITION BY user_id, day ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS t FROM e)
SELECT user_id, day::VARCHAR AS day, count(*) AS layers, round(sum(a * t * value), 6) + 0.0 AS color, round(sum(a * t), 6) + 0.0 AS coverage FROM t GROUP BY 1, 2
""")
def alpha_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts").cast("string"), "a": F.get_json_object("props", "$.k").cast("double") / 100})
    out = compositing.composite(e, ["user_id", "day"], ["event_id"], F.col("a"), F.col("value"))
    return out.select("user_id", "day", "layers", *rounded_all(out, "color", "coverage"))


@query("""
SELECT event_id, greatest(0.005, least(0.995, value / 500)) * (0.4::DOUBLE + 0.5::DOUBLE * greatest(0, least(1, (props->>'$.k')::DOUBLE / 80))) * (1.0::DOUBLE - 0.7::DOUBLE * greatest(0, least(1, (user_id % 10)::DOUBLE / 8))) AS opacity FROM events
""")
def opacity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = compositing.opacity(F.col("value") / 500, F.get_json_object("props", "$.k").cast("double") / 80, F.lit(0.4), F.lit(0.9), (F.col("user_id") % 10).cast("double") / 8, F.lit(1.0), F.lit(0.3))
    return e.select("event_id", value.alias("opacity"))  # not rounded: decimal ties fall differently in the two engines


@query(f"""
WITH e AS (SELECT label, abs(floor(v0 * 3)::INTEGER) % 3 AS a, abs(floor(v1 * 5)::INTEGER) % 4 AS p FROM {chunks_sql(2)} AS c),
g AS (SELECT label, max(a) AS alpha_maximum, max(p) AS premultiplied_maximum FROM e GROUP BY 1)
SELECT label, alpha_maximum, premultiplied_maximum, alpha_maximum <= 1 AND premultiplied_maximum <= CASE WHEN alpha_maximum > 0 THEN 2 ELSE 1 END AS parity FROM g
""")
def export_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda name, by, most: F.abs(F.floor(F.col(name) * by).cast("int")) % most
    return compositing.export_parity(chunks(spark, sf_dir, 2), ["label"], step("v0", 3, 3), step("v1", 5, 4))


@query(f"""
WITH e AS (SELECT label, round(v0 * 255) AS a, round(v1 * 255) AS b FROM {chunks_sql(2)} AS c),
g AS (SELECT label, count(*) AS samples, avg(abs(a - b)) AS l1, avg((a - b) * (a - b)) AS mse FROM e GROUP BY 1)
SELECT label, samples, round(l1, 6) + 0.0 AS l1, round(mse, 6) + 0.0 AS mse, round(CASE WHEN mse > 0 THEN 10 * log10(255 * 255 / mse) END, 6) + 0.0 AS psnr FROM g
""")
def image_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compositing.image_error(chunks(spark, sf_dir, 2), ["label"], F.round(F.col("v0") * 255), F.round(F.col("v1") * 255))
    return out.select("label", "samples", *rounded_all(out, "l1", "mse", "psnr"))


@query(f"""
WITH p AS (SELECT vec_id // 64 AS image, vec_id % 64 AS r, piece AS c, round(v0 * 255) AS x, round(v0 * 255) + (vec_id * 7 + piece) % 5 - 2 AS y FROM {chunks_sql(1)} AS e),
b AS (SELECT image, br, bc, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(y * y) AS myy, avg(x * y) AS mxy
      FROM p, (SELECT range * 4 AS br FROM range(16)) AS rows, (SELECT range * 4 AS bc FROM range(16)) AS cols WHERE r >= br AND r < br + 8 AND c >= bc AND c < bc + 8 GROUP BY ALL),
s AS (SELECT image, (2 * mx * my + 6.5025) * (2 * (mxy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (mxx - mx * mx + myy - my * my + 58.5225)) AS v FROM b WHERE n = 64)
SELECT image, count(*) AS blocks, round(avg(v), 6) + 0.0 AS ssim FROM s GROUP BY 1
""")
def image_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 embeddings are the rows of an image; the other image has small errors."""
    e = chunks(spark, sf_dir, 1).withColumn("image", F.expr("vec_id div 64"))
    value = F.round(F.col("v0") * 255)
    out = compositing.ssim(e, ["image"], F.col("vec_id") % 64, F.col("piece"), value, value + (F.col("vec_id") * 7 + F.col("piece")) % 5 - 2)
    return out.select("image", "blocks", r6("ssim").alias("ssim"))


GAUSSIAN_MOMENTS = ", ".join(f"sum(k.w * {v}) AS {n}" for n, v in (("mx", "{mx}"), ("my", "{my}"), ("mxx", "{mxx}"), ("myy", "{myy}"), ("mxy", "{mxy}")))


@query(f"""
WITH p AS (SELECT vec_id // 64 AS image, vec_id % 64 AS r, piece AS c, round(v0 * 255) AS x, round(v0 * 255) + (vec_id * 7 + piece) % 5 - 2 AS y FROM {chunks_sql(1)} AS e),
g AS (SELECT range AS i, exp(-(range - 5) * (range - 5) / 4.5::DOUBLE) AS w FROM range(11)),
k AS (SELECT i, w / (SELECT sum(w) FROM g) AS w FROM g),
a AS (SELECT image, r, c - i AS wc, {GAUSSIAN_MOMENTS.format(mx="x", my="y", mxx="x * x", myy="y * y", mxy="x * y")} FROM p, k GROUP BY ALL HAVING count(*) = 11),
b AS (SELECT image, r - i AS wr, wc, {GAUSSIAN_MOMENTS.format(mx="mx", my="my", mxx="mxx", myy="myy", mxy="mxy")} FROM a, k GROUP BY ALL HAVING count(*) = 11),
s AS (SELECT image, (2 * mx * my + 6.5025) * (2 * (mxy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (mxx - mx * mx + myy - my * my + 58.5225)) AS v FROM b)
SELECT image, coalesce(windows, 0) AS windows, ssim FROM (SELECT DISTINCT image FROM p) AS d LEFT JOIN (SELECT image, count(*) AS windows, round(avg(v), 6) + 0.0 AS ssim FROM s GROUP BY 1) AS w USING (image)
""")
def image_similarity_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of ``image_similarity`` under a Gaussian window, in tiles of 24 windows, so that images have several."""
    e = chunks(spark, sf_dir, 1).withColumn("image", F.expr("vec_id div 64"))
    value = F.round(F.col("v0") * 255)
    out = compositing.ssim_windowed(e, ["image"], F.col("vec_id") % 64, F.col("piece"), value, value + (F.col("vec_id") * 7 + F.col("piece")) % 5 - 2, tile=24)
    return out.select("image", "windows", r6("ssim").alias("ssim"))


def resampled_sql(scale: str) -> str:
    """Images of 64 embeddings, one way and the other: ``scale`` is the new long side."""
    return f"""
WITH p AS (SELECT vec_id // 64 AS image, vec_id % 64 AS r, piece AS c, v0 AS v FROM {chunks_sql(1)} AS e),
d AS (SELECT image, max(r) + 1 AS h, max(c) + 1 AS w FROM p GROUP BY 1),
t AS (SELECT *, greatest(1, floor(w * ({scale})::DOUBLE / greatest(w, h) + 0.5))::BIGINT AS tw, greatest(1, floor(h * ({scale})::DOUBLE / greatest(w, h) + 0.5))::BIGINT AS th FROM d),
cx AS (SELECT image, w, tw, c, unnest(range(tw)) AS x FROM t, LATERAL (SELECT unnest(range(w)) AS c) AS cs),
cy AS (SELECT image, h, th, r, unnest(range(th)) AS y FROM t, LATERAL (SELECT unnest(range(h)) AS r) AS rs),
ox AS (SELECT image, c, x, least(x + 1, (c + 1) * tw / w::DOUBLE) - greatest(x, c * tw / w::DOUBLE) AS sx FROM cx WHERE least(x + 1, (c + 1) * tw / w::DOUBLE) > greatest(x, c * tw / w::DOUBLE)),
oy AS (SELECT image, r, y, least(y + 1, (r + 1) * th / h::DOUBLE) - greatest(y, r * th / h::DOUBLE) AS sy FROM cy WHERE least(y + 1, (r + 1) * th / h::DOUBLE) > greatest(y, r * th / h::DOUBLE)),
s AS (SELECT image, x, y, sum(sx * sy) AS coverage, sum(sx * sy * v) AS v FROM p JOIN ox USING (image, c) JOIN oy USING (image, r) GROUP BY ALL HAVING sum(sx * sy) > 1e-9)
SELECT image, x, y, round(v / coverage, 6) + 0.0 AS v, round(coverage, 6) + 0.0 AS coverage FROM s
"""


def resampled(spark: SparkSession, sf_dir: str, side: Column) -> DataFrame:
    e = chunks(spark, sf_dir, 1).withColumns({"image": F.expr("vec_id div 64"), "r": F.col("vec_id") % 64})
    sizes = e.groupBy("image").agg((F.max("r") + 1).alias("h"), (F.max("piece") + 1).alias("w"))
    width, height = binary.bounded_size(F.col("w"), F.col("h"), side, enlarge=True)
    out = images.resample(e.join(sizes, "image"), ["image"], F.col("piece"), F.col("r"), F.col("w"), F.col("h"), width, height, {"v": F.col("v0")})
    return out.filter("coverage > 1e-9").select("image", "x", "y", *rounded_all(out, "v", "coverage"))


@query(resampled_sql("11 + image % 20"))
def image_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, sf_dir, 11 + F.col("image") % 20)


@query(resampled_sql("70 + image % 20"))
def image_enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(spark, sf_dir, 70 + F.col("image") % 20)


@query(f"""
SELECT label, piece, vec_id, (row_number() OVER (PARTITION BY label, piece ORDER BY v0 DESC, vec_id) - 1)::INTEGER AS draw_order FROM {chunks_sql(1)} AS e
""")
def depth_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each place of the embeddings is a view, in which its numbers are depths."""
    out = compositing.depth_order(chunks(spark, sf_dir, 1), ["label", "piece"], F.col("v0"), "vec_id")
    return out.select("label", "piece", "vec_id", "draw_order")


from . import painting, releases  # noqa: E402, F401  (they register their queries here)
