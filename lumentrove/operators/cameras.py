"""Camera pools: markers (one per distinct angle pair), their geometry and their summary.

A pool's cameras are rows.  Columns of a camera: ``ord`` (its place in the
pool), ``id``, ``kind``, ``pitch_degrees``, ``yaw_degrees``, ``multiplicity``
and ``camera_fov``; columns of its pool: ``orbit_radius``, ``pool_fov``,
``image_aspect``, ``target_x``, ``target_y``, ``target_z``, ``active_camera_id``.
Missing ones count as null and take the defaults.  ``keys`` name the columns
that tell pools apart, so that any number of pools is handled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalars import EPSILON, angle_key, finite
from .projection import CORNERS, FOV, frame_corner, half_tangent, project_world, with_axes, with_pose, with_position

POOL_COLUMNS = {"orbit_radius": "double", "pool_fov": "double", "image_aspect": "double", "target_x": "double", "target_y": "double", "target_z": "double", "active_camera_id": "string"}
CAMERA_COLUMNS = {"ord": "long", "id": "string", "kind": "string", "pitch_degrees": "double", "yaw_degrees": "double", "multiplicity": "double", "camera_fov": "double"}

# Marker colours (red, green, blue, alpha), sizes as shares of the orbit radius, and the overview's view.
COLORS = {"active": (1.0, 0.9, 0.18, 1.0), "front": (0.12, 0.72, 0.95, 1.0), "virtual": (1.0, 0.48, 0.12, 1.0)}
ACTIVE_SCALE, SCALE, FRUSTUM_DEPTH = 0.025, 0.016, 0.055
OVERVIEW_PITCH, OVERVIEW_YAW, OVERVIEW_RADIUS = 20.0, -42.0, 2.65

SNAPSHOT = "cameras array<struct<id: string, kind: string, pitch_degrees: double, yaw_degrees: double, multiplicity: double, intrinsics: map<string, string>>>, orbit_radius double, fov_degrees double, image_aspect double, target array<double>, active_camera_id string, max_angle_degrees double, sampling_enabled boolean"


def explode_snapshots(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per camera from rows per pool (the schema ``SNAPSHOT``); a target that has not three parts is the origin.

    A pool without cameras has no rows here; ``pool_summary`` counts it with zeros.
    """
    part = lambda i: F.when(F.size("target") == 3, finite(F.get("target", F.lit(i)))).otherwise(0.0)
    rows = snapshots.select(*keys, "orbit_radius", F.col("fov_degrees").alias("pool_fov"), "image_aspect", part(0).alias("target_x"), part(1).alias("target_y"), part(2).alias("target_z"), "active_camera_id", F.posexplode(F.coalesce("cameras", F.array())).alias("ord", "_c"))
    fields = [F.col("_c")[c].alias(c) for c in ("id", "kind", "pitch_degrees", "yaw_degrees", "multiplicity")]
    fov = F.try_element_at(F.col("_c")["intrinsics"], F.lit("fov_degrees")).try_cast("double")
    return rows.select(*keys, *POOL_COLUMNS, "ord", *fields, fov.alias("camera_fov"), F.col("_c")["intrinsics"].alias("intrinsics"))


def complete(cameras: DataFrame) -> DataFrame:
    absent = {c: F.lit(None).cast(t) for c, t in (CAMERA_COLUMNS | POOL_COLUMNS).items() if c not in cameras.columns}
    return cameras.withColumns(absent) if absent else cameras


def sample_count(multiplicity: Column) -> Column:
    """Times a camera counts: rounded half up, at least once."""
    return F.greatest(F.lit(1.0), F.floor(finite(multiplicity, 1.0) + 0.5).cast("double")).cast("long")


def _given(ident: Column) -> Column:
    return F.when(ident != "", ident)


def dedupe_cameras(cameras: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per pool and distinct angle pair.

    Kind, field of view and angles are those of the first camera (least
    ``ord``), multiplicities add up, and the marker is active if any camera is.
    Every aggregate combines in the map tasks and has a bounded state, so a
    pair that a third of all cameras share is no burden; the members' ids are a
    table of their own (``marker_members``).  ``first_ord`` gives the order of
    first appearance.
    """
    keys = keys or []
    rows = complete(cameras)
    first = F.struct("ord", F.coalesce("id", F.lit("")).alias("id"))
    extra = ["intrinsics"] if "intrinsics" in cameras.columns else []
    carried = F.struct("id", "kind", "pitch_degrees", "yaw_degrees", "camera_fov", *extra, *POOL_COLUMNS)
    found = rows.groupBy(*keys, angle_key(F.col("pitch_degrees"), F.col("yaw_degrees")).alias("angle_key")).agg(
        F.min_by(carried, first).alias("_f"),
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("cameras"),
        F.sum(sample_count(F.col("multiplicity"))).alias("multiplicity"),
        F.bool_or(F.coalesce("id", F.lit("")) == F.coalesce("active_camera_id", F.lit(""))).alias("active"),
    )
    fov = F.greatest(F.lit(1.0), finite(F.col("_f.camera_fov"), F.greatest(F.lit(1.0), finite(F.col("_f.pool_fov"), FOV))))
    return found.select(
        *keys,
        "angle_key",
        "first_ord",
        F.coalesce(_given(F.col("_f.id")), F.col("angle_key")).alias("first_id"),
        F.when(F.col("_f.kind") == "front", "front").otherwise("virtual").alias("kind"),
        finite(F.col("_f.pitch_degrees")).alias("raw_pitch"),
        finite(F.col("_f.yaw_degrees")).alias("raw_yaw"),
        fov.alias("fov_degrees"),
        "cameras",
        "multiplicity",
        "active",
        *[F.col(f"_f.{c}").alias(c) for c in extra],
        F.greatest(F.lit(0.01), finite(F.col("_f.orbit_radius"), 1.0)).alias("orbit_radius"),
        F.greatest(F.lit(EPSILON), finite(F.col("_f.image_aspect"), 1.0)).alias("image_aspect"),
        *[finite(F.col(f"_f.target_{c}")).alias(f"target_{c}") for c in "xyz"],
    )


def marker_members(cameras: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, angle_key, ord, member_id): which cameras a marker stands for; no shuffle."""
    rows = complete(cameras)
    key = angle_key(F.col("pitch_degrees"), F.col("yaw_degrees"))
    return rows.select(*(keys or []), key.alias("angle_key"), "ord", F.coalesce(_given(F.col("id")), key).alias("member_id"))


def with_frustum(markers: DataFrame) -> DataFrame:
    """Adds the marker's pose, seen from its position towards its target, and corner{0..3}_{x,y,z} of its frustum's far side."""
    posed = with_axes(with_position(markers, F.col("raw_pitch"), F.col("raw_yaw"), F.col("orbit_radius")), tuple(F.col(f"target_{c}") - F.col(f"pos_{c}") for c in "xyz"))
    depth = F.col("orbit_radius") * FRUSTUM_DEPTH
    rise = depth * half_tangent(F.col("fov_degrees"))
    posed = posed.withColumns({"_depth": depth, "_hh": rise, "_hw": rise * F.col("image_aspect")})
    corners = {}
    for i, (x, y) in enumerate(CORNERS):
        for c in "xyz":
            corners[f"corner{i}_{c}"] = F.col(f"pos_{c}") + F.col(f"fwd_{c}") * F.col("_depth") + F.col(f"right_{c}") * F.col("_hw") * x + F.col(f"up_{c}") * F.col("_hh") * y
    return posed.withColumns(corners).drop("_depth", "_hh", "_hw")


def marker_style(active: Column, kind: Column) -> Column:
    return F.when(active, F.lit("active")).when(kind == "front", F.lit("front")).otherwise(F.lit("virtual"))


def marker_scale(active: Column, orbit_radius: Column) -> Column:
    return orbit_radius * F.when(active, F.lit(ACTIVE_SCALE)).otherwise(F.lit(SCALE))


def marker_color(style: Column) -> Column:
    made = None
    for name, rgba in COLORS.items():
        value = F.struct(*[F.lit(v).alias(c) for v, c in zip(rgba, "rgba", strict=True)])
        made = F.when(style == name, value) if made is None else made.when(style == name, value)
    return made


def marker_segments(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Eleven line segments per marker of ``with_frustum``: three axes, four spokes, four edges.

    Columns: keys, segment (0 to 10), part, style and the ends from_*, to_*.
    """
    scale = marker_scale(F.col("active"), F.col("orbit_radius"))
    position = V.cols("pos")
    corner = [V.cols(f"corner{i}") for i in range(len(CORNERS))]
    lines: list[tuple[str, V.Vec, V.Vec]] = []
    for axis in range(3):
        moved = lambda sign, axis=axis: tuple(p + scale * sign if i == axis else p for i, p in enumerate(position))
        lines.append(("axis", moved(-1), moved(1)))
    for i in range(len(CORNERS)):
        lines += [("spoke", position, corner[i]), ("edge", corner[i], corner[(i + 1) % len(CORNERS)])]
    rows = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(part).alias("part"), *[x.alias(f"from_{c}") for x, c in zip(a, "xyz", strict=True)], *[x.alias(f"to_{c}") for x, c in zip(b, "xyz", strict=True)]) for n, (part, a, b) in enumerate(lines)])
    return markers.select(*keys, marker_style(F.col("active"), F.col("kind")).alias("style"), F.explode(rows).alias("_s")).select(*keys, "style", "_s.*")


def marker_summary(markers: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of markers and of the cameras behind them, by kind; an empty pool has zeros."""
    front = F.col("kind") == "front"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return markers.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("marker_count"),
        total(F.col("multiplicity")).alias("sample_count"),
        F.count_if(front).alias("front_count"),
        F.count_if(~front).alias("virtual_count"),
        total(F.when(front, F.col("multiplicity")).otherwise(0)).alias("front_samples"),
        total(F.when(front, 0).otherwise(F.col("multiplicity"))).alias("virtual_samples"),
        F.coalesce(F.bool_or("active"), F.lit(False)).alias("any_active"),
    )


def pool_summary(snapshots: DataFrame, keys: list[str]) -> DataFrame:
    """``marker_summary`` of every pool of ``snapshots``, those without cameras included, with its settings."""
    found = marker_summary(dedupe_cameras(explode_snapshots(snapshots, keys), keys), keys)
    settings = snapshots.select(*keys, F.coalesce("sampling_enabled", F.lit(False)).alias("sampling_enabled"), F.coalesce("active_camera_id", F.lit("")).alias("active_camera_id"))
    numbers = [c for c in found.columns if c not in (*keys, "any_active")]
    both = settings.join(found, keys, "left")
    return both.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("any_active", F.lit(False)).alias("any_active"), "sampling_enabled", "active_camera_id")


def view_parameters(df: DataFrame, overview: Column, pitch: Column, yaw: Column, orbit_radius: Column, fit_radius: Column, mode: Column) -> DataFrame:
    """Adds view_mode, viewer_radius, view_pitch, view_yaw and view_radius: what the viewer's camera shows.

    ``mode`` "fit" takes the fitted radius and any other the training one; the
    overview of the pool has a fixed direction and stands back by a fixed factor.
    """
    viewer = F.when(mode == "fit", fit_radius).otherwise(orbit_radius)
    wide = F.greatest(orbit_radius, viewer) * OVERVIEW_RADIUS
    pick = lambda a, b: F.when(overview, a).otherwise(b)
    return df.withColumns({"viewer_radius": viewer, "view_mode": pick(F.lit("camera-pool-overview"), F.lit("center-orbit")), "view_pitch": pick(F.lit(OVERVIEW_PITCH), pitch), "view_yaw": pick(F.lit(OVERVIEW_YAW), yaw), "view_radius": pick(wide, viewer)})


def corner_error(expected: DataFrame, measured: DataFrame, keys: list[str]) -> DataFrame:
    """Largest pixel distance, per key, of corners (keys, corner, x, y) of two projections; corners pair by number."""
    pairs = expected.select(*keys, "corner", "x", "y").join(measured.select(*keys, "corner", F.col("x").alias("_mx"), F.col("y").alias("_my")), [*keys, "corner"])
    return pairs.groupBy(*keys).agg(F.max(V.pixel_error(F.col("x"), F.col("y"), F.col("_mx"), F.col("_my"))).alias("corner_error_max_px"))


#: What ``diagnostics`` asks of a session besides its keys.
SESSION_COLUMNS = ("pitch", "yaw", "orbit_radius", "fit_radius", "radius_mode", "overview", "half_x", "half_y", "width", "height", "fov_degrees", "vertices", "content_digest", "camera_updates", "sorted_frames")


def diagnostics(sessions: DataFrame, pools: DataFrame, keys: list[str]) -> DataFrame:
    """One row per session with its whole state as nested records: presentation, camera and camera_markers.

    ``sessions`` has ``SESSION_COLUMNS``, ``pools`` is a ``pool_summary``; a
    session without a pool has no markers.  The four corners are projected side
    by side, so the only shuffle is that of the two tables' join.
    """
    seen = view_parameters(sessions.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in SESSION_COLUMNS]), F.col("_s_overview"), F.col("_s_pitch"), F.col("_s_yaw"), F.col("_s_orbit_radius"), F.col("_s_fit_radius"), F.col("_s_radius_mode"))
    seen = with_pose(seen, F.col("view_pitch"), F.col("view_yaw"), F.col("view_radius"))
    width, height, fov = F.col("_s_width"), F.col("_s_height"), F.col("_s_fov_degrees")
    points = {"center": (F.lit(0.0), F.lit(0.0), F.lit(0.0))} | {f"corner{i}": frame_corner(F.col("_s_half_x"), F.col("_s_half_y"), i) for i in range(len(CORNERS))}
    for name, point in points.items():
        seen = project_world(seen, point, width, height, fov, f"_{name}_")
    screen = lambda name: F.struct(*[F.col(f"_{name}_{c}").alias(c) for c in ("x", "y", "ndc_x", "ndc_y", "depth", "valid")])
    vector = lambda name: F.struct(*[F.col(f"{name}_{c}").alias(c) for c in "xyz"])
    camera = F.struct(F.col("view_mode"), F.col("pitch_degrees"), F.col("yaw_degrees"), F.col("radius"), vector("pos").alias("position"), vector("fwd").alias("forward"), vector("right").alias("right"), vector("up").alias("up"), screen("center").alias("center"), F.array(*[screen(f"corner{i}") for i in range(len(CORNERS))]).alias("corners"))
    counts = ("marker_count", "sample_count", "front_count", "virtual_count", "front_samples", "virtual_samples")
    markers = F.struct(F.col("_s_overview").alias("visible"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("sampling_enabled", F.lit(False)).alias("sampling_enabled"), F.coalesce("active_camera_id", F.lit("")).alias("active_camera_id"), F.col("_s_orbit_radius").alias("training_orbit_radius"))
    state = [F.col(f"_s_{c}").alias(c) for c in ("pitch", "yaw", "orbit_radius", "fit_radius", "radius_mode", "fov_degrees", "vertices", "content_digest")]
    return seen.join(pools, keys, "left").select(*keys, *state, F.col("viewer_radius"), F.struct(F.col("_s_camera_updates").alias("camera_updates"), F.col("_s_sorted_frames").alias("sorted_frames")).alias("presentation"), camera.alias("camera"), markers.alias("camera_markers"))
