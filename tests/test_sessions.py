"""Streams that run, pools without cameras, and the results of checks."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from lumentrove.functions import markup, scalars
from lumentrove.operators import cameras, compositing, poses, projection, rules
from lumentrove.streaming import sessions

VIEWPORT = "session string, half_x double, half_y double, width double, height double"


def test_refit_stream_follows_new_viewports(spark, tmp_path):
    seen = []
    for n, rows in enumerate([[("a", 1.0, 0.5, 1280.0, 720.0)], [("b", 0.5, 0.5, 600.0, 900.0), ("a", 1.0, 0.5, 700.0, 700.0)]]):
        spark.createDataFrame(rows, VIEWPORT).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(VIEWPORT).parquet(f"{tmp_path}/in")
        query = sessions.refit_stream(source, ["session"], lambda df: seen.extend(df.collect()), f"{tmp_path}/state")
        assert query.awaitTermination(120)
        assert len(seen) == (1, 3)[n]
    batch = {r["session"]: r["fit_radius"] for r in sessions.refit(spark.read.parquet(f"{tmp_path}/in").filter("width <> 1280"), ["session"]).collect()}
    assert {r["session"]: r["fit_radius"] for r in seen[1:]} == batch


def test_windowed_counters_drop_late_events(spark, tmp_path):
    at = lambda minute: datetime.datetime(2026, 1, 1, 12, 0) + datetime.timedelta(minutes=minute)
    counters = {"views": F.col("kind") == "view"}
    schema = "ts timestamp, session string, kind string"
    found = []
    for rows in ([(at(1), "a", "view"), (at(2), "a", "sort"), (at(200), "a", "view")], [(at(3), "a", "view"), (at(400), "b", "view")], [(at(600), "c", "view")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        counted = sessions.windowed_counters(source, "ts", "1 hour", "10 minutes", "session", counters)
        query = counted.writeStream.outputMode("append").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    got = {(r["window_start"], r["session"]): r["views"] for r in found}
    # The third minute came after its window was closed, so the first window has one view.
    assert got[at(0), "a"] == 1 and got[at(180), "a"] == 1 and got[at(360), "b"] == 1 and len(got) == 3


def test_pools_without_cameras_have_zeros(spark):
    row = lambda key, cams, target=None: (key, cams, 2.0, 50.0, 1.5, target, "x", 80.0, True)
    camera = ("x", "front", 1.0, 2.0, 2.4, {"fov_degrees": "33"})
    pools = spark.createDataFrame([row("full", [camera, camera, ("", "other", float("nan"), None, None, None)], [1.0, 2.0, float("inf")]), row("empty", []), row("none", None)], f"pool string, {cameras.SNAPSHOT}")
    got = {r["pool"]: r for r in cameras.pool_summary(pools, ["pool"]).collect()}
    assert (got["full"]["marker_count"], got["full"]["sample_count"], got["full"]["front_count"], got["full"]["any_active"]) == (2, 5, 1, True)
    for name in ("empty", "none"):
        assert (got[name]["marker_count"], got[name]["sample_count"], got[name]["any_active"], got[name]["sampling_enabled"]) == (0, 0, False, True)
    rows = cameras.explode_snapshots(pools, ["pool"]).orderBy("ord").collect()
    assert [r["camera_fov"] for r in rows] == [33.0, 33.0, None] and rows[0]["target_x"] == 1.0 and rows[0]["target_z"] == 0.0
    markers = cameras.dedupe_cameras(cameras.explode_snapshots(pools, ["pool"]), ["pool"]).orderBy("first_ord").collect()
    assert [(m["first_id"], m["fov_degrees"]) for m in markers] == [("x", 33.0), ("0.000000:0.000000", 50.0)]


def test_marker_colours(spark):
    rows = spark.createDataFrame([(True, "front"), (False, "front"), (False, "x")], "active boolean, kind string")
    got = [tuple(r[0]) for r in rows.select(cameras.marker_color(cameras.marker_style(F.col("active"), F.col("kind")))).collect()]
    assert got == [cameras.COLORS[c] for c in ("active", "front", "virtual")]


def test_diagnostics_of_a_session_without_a_pool(spark):
    values = (10.0, 5.0, 3.0, 4.0, "fit", False, 0.8, 0.6, 1280.0, 720.0, 50.0, 7.0, "aa", 2, 1)
    row = spark.createDataFrame([("s", *values)], "session string, pitch double, yaw double, orbit_radius double, fit_radius double, radius_mode string, overview boolean, half_x double, half_y double, width double, height double, fov_degrees double, vertices double, content_digest string, camera_updates long, sorted_frames long")
    none = spark.createDataFrame([], f"session string, {cameras.SNAPSHOT}")
    out = cameras.diagnostics(row, cameras.pool_summary(none, ["session"]), ["session"]).first()
    assert out["viewer_radius"] == 4.0 and out["camera"]["view_mode"] == "center-orbit" and out["camera_markers"]["marker_count"] == 0
    assert abs(out["camera"]["center"]["x"] - 640) < 1e-9 and abs(out["camera"]["center"]["depth"] - 4) < 1e-9 and len(out["camera"]["corners"]) == 4


def test_plane_points_that_no_ray_meets(spark):
    rows = [(0, 0.3, -0.2, 0.1), (1, 0.3, -0.2, float("nan")), (2, None, None, None)]
    df = spark.createDataFrame(rows, "n int, u double, v double, z double")
    flat = projection.with_contract(df, F.lit(16.0), F.lit(9.0), F.lit(1280.0), F.lit(720.0), 20.0, 30.0, 2.0, F.lit(50.0))
    got = {r["n"]: (r["plane_x"], r["plane_y"], r["plane_valid"]) for r in projection.unproject_planar(flat, F.col("u"), F.col("v"), F.col("z")).collect()}
    assert got[0][2] and not got[1][2] and got[1][0] != got[1][0] and got[2][2]
    seen = projection.project_planar(projection.unproject_planar(flat, F.col("u"), F.col("v"), F.col("z")), F.col("plane_x"), F.col("plane_y"), F.col("z")).filter("n = 0").first()
    assert abs(seen["ndc_x"] - 0.3) < 1e-9 and abs(seen["ndc_y"] + 0.2) < 1e-9
    # Looking along the plane: forward has no part across it.
    edge = flat.withColumns({"fwd_x": F.lit(1.0), "fwd_y": F.lit(0.0), "fwd_z": F.lit(0.0), "right_x": F.lit(0.0), "right_y": F.lit(1.0), "right_z": F.lit(0.0), "up_x": F.lit(0.0), "up_y": F.lit(1.0), "up_z": F.lit(0.0)})
    got = projection.unproject_planar(edge, F.col("u"), F.col("v"), F.lit(0.0)).filter("n = 0").first()
    assert (got["plane_x"], got["plane_y"], got["plane_valid"]) == (0.0, 0.0, False)


def test_required_checks_raise_with_all_failures(spark):
    names = [("one", True), ("two", False), ("three", False)]
    results = spark.createDataFrame([(i, n, ok) for i, (n, ok) in enumerate(names)], "ord int, rule string, passed boolean")
    with pytest.raises(Exception, match="(?s)release failed:\n- two\n- three"):
        rules.require(results, "release failed")
    assert json.loads(rules.require(results.filter("passed"))) == {"ok": True}


def test_missing_documents_fail_their_rules(spark):
    from lumentrove.plans.releases import FILES, POLICY

    texts = spark.createDataFrame([("r", "web/styles.css", "p{}")], "release string, name string, text string")
    table = rules.release_table(texts, FILES, ["release"]).withColumn("screenshot", F.lit(None).cast("binary"))
    got = {r["rule"]: r["passed"] for r in rules.evaluate(table, rules.release_rules(POLICY), ["release"]).collect()}
    assert len(got) == 24 and [n for n, ok in got.items() if ok] == ["CSS has no remote stylesheet or URL"]


def test_maps_are_equal_whatever_their_order(spark):
    row = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1"},)], "m map<string,string>")
    assert [r[0] for r in row.select(markup.same_map(F.col("m"), {"a": "1", "b": "2"})).collect()] == [True, False]
    job = spark.createDataFrame([("  deploy:\n    permissions:\n      a: 1\n      b: 2\n",)], "t string")
    assert job.select(markup.same_map(markup.permission_map(F.col("t")), {"b": "2", "a": "1"})).first()[0]


def test_unchecked_boxes_and_policies(spark):
    tags = spark.createDataFrame([('<input type="checkbox">',), ('<input type="checkbox" checked>',), ('<input type="checkbox" data-checked2>',), ('<input type="text">',)], "t string")
    assert [r[0] for r in tags.select(markup.is_unchecked_box(F.col("t"))).collect()] == [True, False, True, False]
    page = spark.createDataFrame([("<meta content='x; y' HTTP-EQUIV=\"Content-Security-Policy\">",), ("<meta http-equiv='Content-Security-Policy'>",)], "h string")
    assert [r[0] for r in page.select(markup.security_policy(F.col("h"))).collect()] == ["x; y", ""]


def test_ssim_of_equal_and_flat_images(spark):
    pixels = spark.range(20 * 20).select((F.col("id") / 20).cast("int").alias("r"), (F.col("id") % 20).alias("c"), ((F.col("id") * 37) % 251).cast("double").alias("x"))
    same = compositing.ssim(pixels.withColumn("k", F.lit(1)), ["k"], F.col("r"), F.col("c"), F.col("x"), F.col("x")).first()
    assert same["blocks"] == 16 and abs(same["ssim"] - 1) < 1e-12
    flat = compositing.ssim(pixels.withColumn("k", F.lit(1)), ["k"], F.col("r"), F.col("c"), F.lit(100.0), F.lit(50.0)).first()
    assert abs(flat["ssim"] - (2 * 100 * 50 + 6.5025) / (100**2 + 50**2 + 6.5025)) < 1e-9


def test_fibonacci_poses_of_other_sizes(spark):
    for count, polar in ((2, 10.0), (7, 45.0), (None, None), (1, -5.0)):
        rows = poses.fibonacci_poses(spark, count, polar).collect()
        assert len(rows) == {2: 2, 7: 7, None: 49, 1: 2}[count] and rows[0]["dir_z"] == 1.0
        assert abs(rows[-1]["polar_degrees"] - {10.0: 10.0, 45.0: 45.0, None: 89.0, -5.0: 0.0}[polar]) < 1e-6


def test_orbit_angles_under_a_narrow_cone(spark):
    rows = spark.createDataFrame([(80.0, 0.0), (0.0, 80.0), (10.0, 10.0)], "p double, y double")
    out = projection.with_orbit_angles(rows, F.col("p"), F.col("y"), 30.0).collect()
    assert [round(r["polar_degrees"], 6) for r in out][:2] == [30.0, 30.0] and abs(out[2]["pitch_degrees"] - 10) < 1e-9
    assert abs(out[0]["pitch_degrees"] - 30) < 1e-9 and abs(out[1]["yaw_degrees"] - 30) < 1e-9


def test_text_numbers(spark):
    rows = spark.createDataFrame([("5",), ("x",)], "t string")
    assert [r[0] for r in rows.select(scalars.finite_text(F.col("t"))).collect()] == [5.0, 0.0]


def bisected(row: dict, angles: list[tuple[float, float]]) -> float:
    """The least radius by 40 halvings, projecting every corner from every pose."""
    unit = lambda v: [c / math.sqrt(sum(x * x for x in v)) for c in v]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    tan, aspect, margin = math.tan(math.radians(max(1, row["fov"]) / 2)), max(1, row["w"]) / max(1, row["h"]), min(0.98, max(0.5, row["margin"]))
    x, y, s = max(1e-9, row["x"]), max(1e-9, row["y"]), max(1e-9, math.hypot(row["x"], row["y"]))

    def fits(radius: float) -> bool:
        for pitch, yaw in angles:
            p, q = math.radians(pitch), math.radians(yaw)
            at = [max(0.01, radius) * c for c in (math.sin(q) * math.cos(p), math.sin(p), math.cos(q) * math.cos(p))]
            fwd = unit([-c for c in at])
            right = unit(cross(fwd, [0, 1, 0]))
            up = cross(right, fwd)
            for corner in ([-x, y, 0], [x, y, 0], [x, -y, 0], [-x, -y, 0]):
                rel = [c - a for c, a in zip(corner, at, strict=True)]
                depth = dot(rel, fwd)
                high = depth * tan
                if not depth > 1e-9 or abs(dot(rel, right) / max(1e-9, high * aspect)) > margin or abs(dot(rel, up) / max(1e-9, high)) > margin:
                    return False
        return True

    low, high = 1.001 * s, 32 * s
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def test_fits_are_those_of_bisection(spark):
    """Own fields of view, angles and margins; tiny, flat and negative frames; a field without a positive tangent; repeated keys."""
    rng = random.Random(4)
    rows = [(i % 5, rng.uniform(0.05, 3), rng.uniform(0.05, 3), rng.uniform(300, 2000), rng.uniform(300, 2000), rng.uniform(10, 120), rng.uniform(0, 89), rng.uniform(0.3, 1.2)) for i in range(12)]
    rows += [(0, 0.001, 0.001, 800.0, 600.0, 50.0, 89.0, 0.9), (0, 0.004, 0.002, 800.0, 600.0, 30.0, 40.0, 0.9), (1, 2.0, 1e-7, 10.0, 900.0, 50.0, 0.0, 0.9), (2, -1.0, 0.5, 800.0, 600.0, 50.0, 60.0, 0.9), (3, 1.0, 1.0, 800.0, 600.0, 200.0, 60.0, 0.9), (4, 1.0, 1.0, 800.0, 600.0, 2.0, 89.0, 0.5)]
    names = ("k", "x", "y", "w", "h", "fov", "angle", "margin")
    frames = spark.createDataFrame(rows, "k int, x double, y double, w double, h double, fov double, angle double, margin double")
    args = {"fov": F.col("fov"), "margin": F.col("margin")}
    fit = lambda **more: poses.fit_radius(frames, list(names), *[F.col(c) for c in "xywh"], **args, **more)
    own = fit(max_angle=F.col("angle"))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = own.collect()
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(rows)
    for r in got:
        angles = [(p["pitch_degrees"], p["yaw_degrees"]) for p in poses.fibonacci_poses(spark, 49, r["angle"]).collect()]
        assert math.isclose(r["fit_radius"], bisected(r.asDict(), angles), rel_tol=1e-8), r
    few = spark.createDataFrame([(10.0, 20.0), (-40.0, 5.0), (0.0, -70.0)], "pitch_degrees double, yaw_degrees double")
    for r in fit(poses=few).collect():
        assert math.isclose(r["fit_radius"], bisected(r.asDict(), [tuple(p) for p in few.collect()]), rel_tol=1e-8), r


def test_pose_tables_of_any_size(spark, monkeypatch):
    frames = spark.createDataFrame([(1, 0.8, 0.6), (1, 0.8, 0.6), (1, 0.3, 0.6)], "k int, x double, y double")
    fit = lambda p: sorted(r["fit_radius"] for r in poses.fit_radius(frames, ["k"], F.col("x"), F.col("y"), F.lit(1280.0), F.lit(720.0), poses=p).collect())
    close = lambda a, b: len(a) == len(b) and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a, b, strict=True))
    all_poses = poses.fibonacci_poses(spark)
    whole = fit(None)
    assert len(whole) == 3 and close(fit(all_poses), whole) and close(fit(all_poses.filter("false")), whole)
    assert fit(all_poses.filter("index = 0"))[0] < whole[0]
    monkeypatch.setattr(poses, "POSE_BLOCK", 10)
    assert close(fit(all_poses), whole)


def test_two_resizes_of_one_session_are_two_rows(spark):
    rows = [("a", 1.0, 0.5, 1280.0, 720.0, 40.0, 30.0), ("a", 1.0, 0.5, 300.0, 900.0, 40.0, 30.0), ("a", 1.0, 0.5, 300.0, 900.0, None, None)]
    events = spark.createDataFrame(rows, VIEWPORT + ", fov_degrees double, max_angle_degrees double")
    got = [r["fit_radius"] for r in sessions.refit(events, ["session"]).collect()]
    assert len(set(got)) == 3
    alone = [sessions.refit(spark.createDataFrame([r], events.schema), ["session"]).first()["fit_radius"] for r in rows]
    assert got == alone and alone[2] == sessions.refit(events.drop("fov_degrees", "max_angle_degrees"), ["session"]).collect()[2]["fit_radius"]


def test_event_counters_of_a_stream_match_the_batch(spark, tmp_path):
    rows = [("a", "view"), ("a", "sort"), ("b", "view"), ("a", "view")]
    spark.createDataFrame(rows, "session string, kind string").write.parquet(f"{tmp_path}/in")
    counters = {"views": F.col("kind") == "view", "sorts": F.col("kind") == "sort"}
    found = []
    source = spark.readStream.schema("session string, kind string").parquet(f"{tmp_path}/in")
    query = sessions.event_counters(source, "session", counters).writeStream.outputMode("complete").foreachBatch(lambda df, _: found.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {tuple(r) for r in found} == {("a", 2, 1), ("b", 1, 0)} == {tuple(r) for r in sessions.event_counters(spark.read.parquet(f"{tmp_path}/in"), "session", counters).collect()}


def test_session_stream_matches_the_batch_and_forgets_old_sessions(spark, tmp_path):
    """Late, repeated and disordered events over several batches; sessions that fall silent are closed and leave the state."""
    rng = random.Random(2)
    at = lambda minute: datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=minute)
    schema = "session string, ts timestamp, seq long, kind string, value double"
    old = [(f"old{i}", at(i), i, rng.choice(["tilt", "mode"]), float(i)) for i in range(8)]
    live = [(f"live{i % 5}", at(2000 + i), 100 + i, rng.choice(["tilt", "mode", "other"]), float(i)) for i in range(60)]
    rng.shuffle(live)
    live += rng.sample(live, 20) + [("live0", None, None, "tilt", 5.0), ("live1", at(2001), 1, "tilt", -1.0)]
    end = [("live2", at(2100), 500, "mode", 7.0)]
    too_late = [("old1", at(5), 900, "tilt", 99.0)]
    settings = {"tilt": (F.col("kind") == "tilt", F.col("value")), "mode": (F.col("kind").isin("mode"), F.concat(F.lit("m"), F.col("value").cast("string")))}
    sessions.use_rocksdb(spark)
    found, states = [], []
    for rows in (old, live[:40], live[40:], end, too_late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = sessions.session_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "session", "ts", F.col("seq"), settings, "30 MINUTES", "2 hours")
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n: found.extend((n, *r) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = {}
    for r in found:
        last[r[1]] = (r[2], r[3], r[5])
    batch = {r["session"]: (r["tilt"], r["mode"]) for r in sessions.last_settings(spark.read.parquet(f"{tmp_path}/in").filter("seq is null or seq <> 900"), "session", F.col("seq"), settings).collect()}
    assert {k: v[:2] for k, v in last.items()} == batch and len(batch) == 13
    assert {k for k, v in last.items() if v[2]} >= {f"old{i}" for i in range(8)} and not last["live2"][2]
    assert states[-1] < max(states)
    closed = [r for r in found if r[5]]
    assert len(closed) == len({r[1] for r in closed})


def test_default_poses_are_taken_in_batches(spark):
    """No lambda is evaluated for each frame and pose, and the batches say what a table of the same poses says."""
    frames = spark.range(25000).select("id", (F.col("id") % 97 / 40.0).alias("x"), (F.col("id") % 89 / 50.0).alias("y"))
    fit = lambda f, p=None: poses.fit_radius(f, ["id"], F.col("x"), F.col("y"), F.lit(1280.0), F.lit(720.0), poses=p)
    out = fit(frames)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["fit_radius"] for r in out.collect()}
    some = {r["id"]: r["fit_radius"] for r in fit(frames.filter("id % 500 = 3"), poses.fibonacci_poses(spark)).collect()}
    assert len(got) == 25000 and len(some) == 50
    assert all(math.isclose(got[i], r, rel_tol=1e-9) for i, r in some.items())


def test_canonical_radius_is_taken_in_batches(spark):
    frames = spark.range(3000).select("id", (F.col("id") % 97 / 40.0).alias("x"), (F.col("id") % 89 / 50.0).alias("y"))
    fit = lambda **more: poses.canonical_radius(frames, ["id"], F.col("x"), F.col("y"), **more)
    out = fit()
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["fit_radius"] for r in out.collect()}
    table = {r["id"]: r["fit_radius"] for r in fit(poses=poses.fibonacci_poses(spark)).collect()}
    assert len(got) == 3000 and all(math.isclose(got[i], table[i], rel_tol=1e-9) for i in table)


def test_radius_of_own_views_is_taken_in_batches(spark):
    """A cap, a field of view and a margin of its own for each frame."""
    frames = spark.range(3000).select("id", (F.col("id") % 97 / 40.0).alias("x"), (F.col("id") % 89 / 50.0).alias("y"), (25.0 + F.col("id") % 30).alias("fov"), (F.col("id") % 4 * 25.0).alias("angle"))
    fit = lambda f, p=None: poses.fit_radius(f, ["id", "angle"], F.col("x"), F.col("y"), F.lit(800.0), F.lit(600.0), fov=F.col("fov"), max_angle=F.col("angle"), poses=p)
    out = fit(frames)
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r["fit_radius"] for r in out.collect()}
    assert len(got) == 3000
    for angle in (0.0, 25.0, 75.0):
        few = fit(frames.filter((F.col("angle") == angle) & (F.col("id") < 300)), poses.fibonacci_poses(spark, 49, angle)).collect()
        assert few and all(math.isclose(got[r["id"]], r["fit_radius"], rel_tol=1e-9) for r in few)
