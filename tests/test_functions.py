import math

from pyspark.sql import functions as F

from lumentrove.functions import binary, scalars
from lumentrove.functions import vectors as V
from lumentrove.operators import poses, projection


def test_finite_and_clamp(spark):
    rows = spark.createDataFrame([(1.5,), (None,), (math.nan,), (math.inf,), (200.0,)], "v double")
    got = [tuple(r) for r in rows.select(scalars.finite(F.col("v"), 7.0), scalars.clamp_angle(F.col("v"))).collect()]
    assert got == [(1.5, 1.5), (7.0, 0.0), (7.0, 0.0), (7.0, 0.0), (200.0, 89.0)]


def test_finite_text(spark):
    rows = spark.createDataFrame([(" 12 ",), ("",), ("1d",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in rows.select(scalars.finite_text(F.col("v"), 3.0)).collect()] == [12.0, 0.0, 3.0, 3.0, 3.0]


def test_zero_vector_has_no_direction(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0), (3.0, 0.0, 4.0)], "p_x double, p_y double, p_z double")
    assert [tuple(r) for r in rows.select(*V.normalize(V.cols("p"))).collect()] == [(0.0, 0.0, 0.0), (0.6, 0.0, 0.8)]


def test_constant_camera_equals_camera_columns(spark):
    rows = spark.createDataFrame([(15.0, -30.0, 1.5)], "a double, b double, c double")
    names = [f"{v}_{c}" for v in ("pos", "fwd", "right", "up") for c in "xyz"]
    one = projection.with_pose(rows, 15.0, -30.0, 1.5).select(*names).first()
    other = projection.with_pose(rows, F.col("a"), F.col("b"), F.col("c")).select(*names).first()
    assert tuple(one) == tuple(other)


def test_pose_axes_are_orthonormal(spark):
    cams = poses.fibonacci_poses(spark).select(F.col("pitch_degrees").alias("a"), F.col("yaw_degrees").alias("b"))
    posed = projection.with_pose(cams, F.col("a"), F.col("b"), F.lit(2.0))
    assert posed.select(F.max(poses.unit_axis_check(posed))).first()[0] < 1e-9


def test_empty_pool(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert projection.with_pose(empty, F.col("a"), F.col("b"), F.lit(1.0)).count() == 0


def test_jpeg_frame_lies_behind_any_number_of_segments(spark):
    frame = bytes.fromhex("ffc0001108") + (300).to_bytes(2, "big") + (400).to_bytes(2, "big") + b"\x03" + bytes(9)
    segment = bytes.fromhex("ffe20006") + b"icc!"
    rows = [(n, b"\xff\xd8" + segment * n + frame) for n in (0, 1, 63, 64, 65, 300)] + [(1000, b"\xff\xd8" + segment * 300), (1001, segment * 300), (1002, None), (1003, b"")]
    got = {r["n"]: r["f"] and tuple(r["f"]) for r in spark.createDataFrame(rows, "n int, content binary").select("n", binary.jpeg_frame(F.col("content")).alias("f")).collect()}
    assert got == {n: (300, 400, 3) if n < 1000 else None for n, _ in rows}


def test_jpeg_segments_are_walked_once(spark):
    """The walk stands once in each expression, whatever is read where it ends, and its places are plain numbers, which cost nothing once the end is found."""
    df = spark.createDataFrame([(b"\xff\xd8\xff\xd9",)], "content binary")
    for out in (df.select(binary.jpeg_frame(F.col("content")).alias("frame")), binary.with_exif_orientation(df, F.col("content"))):
        plan = out._jdf.queryExecution().analyzed().toString()
        assert plan.count("aggregate(") == 2 and "done" not in plan, plan
