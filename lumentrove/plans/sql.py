"""Building blocks of the DuckDB statements: orbits, poses and projections as common table expressions."""

from __future__ import annotations


def r6(*columns: str) -> str:
    """Columns, or ``expression AS name``, rounded to six decimals without negative zero."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ") if " AS " in c else (c, "", c)
        out.append(f"round({expression}, 6) + 0.0 AS {name}")
    return ", ".join(out)


def orbit(source: str, max_polar: str) -> str:
    """``orbit``: the source's columns with the clamped angles of its pitch and yaw."""
    return f"""
o0 AS (SELECT *, radians(greatest(-89, least(89, pitch))::DOUBLE) AS _p, radians(greatest(-89, least(89, yaw))::DOUBLE) AS _y, radians({max_polar}::DOUBLE) AS _m FROM ({source}) AS src),
o1 AS (SELECT *, sin(_y) * cos(_p) AS _dx, sin(_p) AS _dy, cos(_y) * cos(_p) AS _dz FROM o0),
o2 AS (SELECT *, acos(greatest(-1, least(1, _dz))) AS _polar, atan2(_dy, _dx) AS _az FROM o1),
o3 AS (SELECT *, _polar <= _m + 1e-9 AS _in FROM o2),
o4 AS (SELECT *, CASE WHEN _in THEN _dx ELSE sin(_m) * cos(_az) END AS dir_x, CASE WHEN _in THEN _dy ELSE sin(_m) * sin(_az) END AS dir_y, CASE WHEN _in THEN _dz ELSE cos(_m) END AS dir_z FROM o3),
orbit AS (SELECT *, degrees(CASE WHEN _in THEN _p ELSE asin(dir_y) END) AS pitch_degrees, degrees(CASE WHEN _in THEN _y ELSE atan2(dir_x, dir_z) END) AS yaw_degrees, degrees(CASE WHEN _in THEN _polar ELSE _m END) AS polar_degrees FROM o4)"""


def pose(radius: str) -> str:
    """``pose``: ``orbit`` with position and axes of a camera that looks at the origin."""
    return f"""
p0 AS (SELECT *, ({radius})::DOUBLE AS radius, radians(pitch_degrees) AS _pp, radians(yaw_degrees) AS _yy FROM orbit),
p1 AS (SELECT *, radius * (sin(_yy) * cos(_pp)) AS pos_x, radius * sin(_pp) AS pos_y, radius * (cos(_yy) * cos(_pp)) AS pos_z FROM p0),
p2 AS (SELECT *, sqrt(pos_x * pos_x + pos_y * pos_y + pos_z * pos_z) AS _len FROM p1),
p3 AS (SELECT *, -pos_x / _len AS fwd_x, -pos_y / _len AS fwd_y, -pos_z / _len AS fwd_z FROM p2),
p4 AS (SELECT *, sqrt(fwd_z * fwd_z + fwd_x * fwd_x) AS _flat FROM p3),
p5 AS (SELECT *, -fwd_z / _flat AS right_x, 0.0::DOUBLE AS right_y, fwd_x / _flat AS right_z FROM p4),
pose AS (SELECT *, right_y * fwd_z - right_z * fwd_y AS up_x, right_z * fwd_x - right_x * fwd_z AS up_y, right_x * fwd_y - right_y * fwd_x AS up_z FROM p5)"""


def projected(x: str, y: str, z: str, width: str, height: str, fov: str) -> str:
    """``projected``: a world point's place in the view of ``pose``."""
    return f"""
q0 AS (SELECT *, {x} - pos_x AS _rx, {y} - pos_y AS _ry, {z} - pos_z AS _rz FROM pose),
q1 AS (SELECT *, _rx * fwd_x + _ry * fwd_y + _rz * fwd_z AS depth FROM q0),
q2 AS (SELECT *, depth * tan(radians({fov}::DOUBLE / 2)) AS _hh FROM q1),
q3 AS (SELECT *, (_rx * right_x + _ry * right_y + _rz * right_z) / greatest(1e-9, _hh * {width}::DOUBLE / {height}::DOUBLE) AS ndc_x, (_rx * up_x + _ry * up_y + _rz * up_z) / greatest(1e-9, _hh) AS ndc_y FROM q2),
projected AS (SELECT *, (ndc_x + 1) * {width}::DOUBLE / 2 AS x, (1 - ndc_y) * {height}::DOUBLE / 2 AS y, depth > 1e-9 AS valid FROM q3)"""


def fibonacci(count: int, max_polar: int) -> str:
    """``fib``: poses of equal area in a golden-angle spiral."""
    return f"""
f0 AS (SELECT range::INTEGER AS index, range::DOUBLE / {count - 1} AS fraction, 1 - range::DOUBLE / {count - 1} * (1 - cos(radians({max_polar}::DOUBLE))) AS dir_z, CASE WHEN range = 0 THEN 0.0::DOUBLE ELSE fmod(range::DOUBLE * (pi() * (3 - sqrt(5::DOUBLE))), 2 * pi()) END AS _az FROM range({count})),
f1 AS (SELECT *, acos(greatest(-1, least(1, dir_z))) AS _po FROM f0),
f2 AS (SELECT *, sin(_po) * cos(_az) AS dir_x, sin(_po) * sin(_az) AS dir_y FROM f1),
fib AS (SELECT *, printf('fib-%02d', index) AS id, degrees(_po) AS polar_degrees, degrees(_az) AS azimuth_degrees, degrees(asin(dir_y)) AS pitch_degrees, degrees(atan2(dir_x, dir_z)) AS yaw_degrees FROM f2)"""


def fit(frames: str) -> str:
    """The least radius for frames (p_partkey, fx, fy, aspect), by the bounds of every pose and corner."""
    along = lambda axis: f"(fx * sx * {axis}_x + fy * sy * {axis}_y)"
    return f"""
WITH {fibonacci(49, 89)},
{orbit("SELECT pitch_degrees AS pitch, yaw_degrees AS yaw FROM fib", "89")},
{pose("1.0")},
fr AS ({frames}),
b AS (SELECT p_partkey, fx, fy, greatest(abs({along("right")}) / (0.9 * tan(radians(25.0::DOUBLE)) * aspect), abs({along("up")}) / (0.9 * tan(radians(25.0::DOUBLE)))) - {along("fwd")} AS r
      FROM fr, (SELECT fwd_x, fwd_y, right_x, right_y, up_x, up_y FROM pose) AS ax, (VALUES (-1, 1), (1, 1), (1, -1), (-1, -1)) AS c(sx, sy)),
m AS (SELECT p_partkey, max(r) AS r, any_value(sqrt(fx * fx + fy * fy)) AS s FROM b GROUP BY 1)
SELECT p_partkey, round(least(32 * s, greatest(1.001 * s, r)), 6) + 0.0 AS fit_radius FROM m
"""


def spirals(source: str) -> str:
    """``fib``: the spirals of rows (any columns, count, cap)."""
    return f"""
f0 AS (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(2, coalesce(count, 49))::BIGINT AS n, cos(radians(greatest(0, least(89, coalesce(cap, 89)))::DOUBLE)) AS least_cos FROM ({source}) AS src) AS x),
f1 AS (SELECT *, i::INTEGER AS index, i / (n - 1)::DOUBLE AS fraction, 1 - i / (n - 1)::DOUBLE * (1 - least_cos) AS dir_z, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE fmod(i::DOUBLE * (pi() * (3 - sqrt(5::DOUBLE))), 2 * pi()) END AS _az FROM f0),
f2 AS (SELECT *, acos(greatest(-1, least(1, dir_z))) AS _po FROM f1),
f3 AS (SELECT *, sin(_po) * cos(_az) AS dir_x, sin(_po) * sin(_az) AS dir_y FROM f2),
fib AS (SELECT *, printf('fib-%02d', index) AS id, degrees(_po) AS polar_degrees, degrees(_az) AS azimuth_degrees, degrees(asin(dir_y)) AS pitch_degrees, degrees(atan2(dir_x, dir_z)) AS yaw_degrees FROM f3)"""


def fit_views(frames: str) -> str:
    """The least radius for frames (p_partkey, fx, fy, aspect, fov, cap, margin), each seen from its own spiral."""
    along = lambda axis: f"(fx * sx * {axis}_x + fy * sy * {axis}_y)"
    return f"""
WITH {spirals(f"SELECT *, NULL::BIGINT AS count FROM ({frames}) AS fr")},
{orbit("SELECT p_partkey, fx, fy, aspect, fov, margin, pitch_degrees AS pitch, yaw_degrees AS yaw FROM fib", "89")},
{pose("1.0")},
b AS (SELECT p_partkey, fx, fy, greatest(abs({along("right")}) / (margin * tan(radians(fov / 2::DOUBLE)) * aspect), abs({along("up")}) / (margin * tan(radians(fov / 2::DOUBLE)))) - {along("fwd")} AS r
      FROM pose, (VALUES (-1, 1), (1, 1), (1, -1), (-1, -1)) AS c(sx, sy)),
m AS (SELECT p_partkey, max(r) AS r, any_value(sqrt(fx * fx + fy * fy)) AS s FROM b GROUP BY 1)
SELECT p_partkey, round(CASE WHEN r <= 0.01 THEN 1.001 * s ELSE least(32 * s, greatest(1.001 * s, r)) END, 6) + 0.0 AS fit_radius FROM m
"""
