"""Carried values, export eligibility, inherited layers, repaired colours, strokes and windowed SSIM against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrove.operators import compositing, layers, ranking, results, shapes


@pytest.mark.parametrize("parts", [1, 6])
def test_carried_values_do_not_follow_partitions(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, None, None, rng.randrange(9)]), "clash") for i in range(600)]
    want, last = {}, {}
    for key, i, v, _ in rows:
        last[key] = v if v is not None else last.get(key)
        want[i] = last[key]
    df = spark.createDataFrame(rows, "k string, i int, v int, _block string").repartition(parts)
    got = ranking.carried(df, ["k"], [F.col("i")], F.col("v"), "now").collect()
    assert len(got) == 600 and {r["i"]: r["now"] for r in got} == want
    none = spark.createDataFrame([], "k string, i int, v int")
    assert ranking.carried(none, ["k"], [F.col("i")], F.col("v"), "now").columns == ["k", "i", "v", "now"]
    assert ranking.carried(none, ["k"], [F.col("i")], F.col("v"), "now").count() == 0


def test_exports_stay_bound_to_the_completed_result(spark):
    steps = [("export", None), ("completed", "planar"), ("select", "brush"), ("export", None), ("completed", "virtual-camera"), ("tilt", None), ("reset", None), ("tilt", None), ("completed", "unknown"), ("completed", None), (None, "planar"), ("completed", "brush"), ("image-replaced", "brush")]
    df = spark.createDataFrame([("s", i, *s) for i, s in enumerate(steps)] + [(None, 0, "completed", "rectangle")], "session string, n int, kind string, algorithm string")
    out = results.eligibility(df, ["session"], [F.col("n")], F.col("kind"), F.col("algorithm"))
    got = [(r["result_algorithm"], r["image_export"], r["point_export"], r["tilt"]) for r in out.filter("session = 's'").orderBy("n").collect()]
    nothing, planar, virtual = (None, False, False, False), ("planar", True, True, False), ("virtual-camera", True, True, True)
    assert got == [nothing, planar, planar, planar, virtual, virtual, nothing, nothing, ("unknown", False, False, False), nothing, nothing, ("brush", True, False, False), nothing]
    assert out.filter("session is null").first()["image_export"]


def test_layers_come_from_the_nearest_ancestor(spark):
    rng = random.Random(4)
    parent = {i: (i - 1 if i < 300 else rng.randrange(i)) for i in range(1, 500)} | {0: None}
    own = {i: (rng.randrange(9) if i in (0, 120, 121) or i > 450 and i % 3 == 0 else None) for i in range(500)}
    parent |= {600: 601, 601: 602, 602: 600, 603: 602, 700: 999, 701: 700, 800: 800}  # a ring, what hangs on it, no such parent, its own parent
    own |= dict.fromkeys((600, 601, 602, 603, 700, 701, 800))

    def plain(i):
        seen = set()
        while i in own and i not in seen:
            if own[i] is not None:
                return own[i]
            seen.add(i)
            i = parent[i]
        return None

    rows = [(i, parent[i], own[i], 1) for i in own] + [(None, 130, None, 1), (None, None, 5, 1), (None, None, None, 1)]
    df = spark.createDataFrame(rows, "id long, parent long, own int, ask int")  # a clashing name
    got = layers.inherited(df, "id", F.col("parent"), F.col("own")).collect()
    assert len(got) == len(rows)
    assert {r["id"]: r["paint_layer"] for r in got if r["id"] is not None} == {i: plain(i) for i in own}
    assert sorted((r["paint_layer"] is None, r["paint_layer"]) for r in got if r["id"] is None) == sorted([(False, own[121]), (False, 5), (True, None)])
    assert layers.inherited(df.limit(0), "id", F.col("parent"), F.col("own")).count() == 0


def test_colours_are_the_means_of_footprints(spark):
    rng = np.random.default_rng(5)
    image = {n: rng.integers(0, 256, (h, w)) for n, (h, w) in {"a": (13, 20), "b": (7, 1)}.items()}
    pixels = spark.createDataFrame([(n, x, y, int(v[y, x])) for n, v in image.items() for y in range(v.shape[0]) for x in range(v.shape[1])], "image string, x int, y int, v int")
    rows = []
    for i in range(200):
        x0, y0 = (int(rng.integers(-4, 22)) for _ in range(2))
        rows.append((i, ["a", "b", "none", None][i % 4 if i > 40 else 0], x0, x0 + int(rng.integers(-2, 9)), y0, y0 + int(rng.integers(-2, 9)), float(i), i % 5 > 0))
    rows += [(900, "a", None, 3, 0, 3, 7.0, True), (901, "a", 0, 3, 0, None, 7.0, True), (902, "a", -(10**9), 10**9, -(10**9), 10**9, 7.0, True), (903, "a", 0, 3, 0, 3, 7.0, None)]
    splats = spark.createDataFrame(rows, "id int, image string, x0 int, x1 int, y0 int, y1 int, red double, moved boolean")
    out = layers.repaired(splats, pixels, ["image"], "id", F.col("moved"), tuple(F.col(c) for c in ("x0", "x1", "y0", "y1")), F.col("x"), F.col("y"), {"red": F.col("v")})
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns == [*splats.columns, "repaired"]
    for i, name, x0, x1, y0, y1, red, moved in rows:
        cut = image[name][max(0, y0) : max(0, y1 + 1), max(0, x0) : max(0, x1 + 1)] if moved and name in image and None not in (x0, x1, y0, y1) else np.zeros(0)
        assert got[i]["repaired"] == (cut.size > 0)
        assert abs(got[i]["red"] - (cut.mean() if cut.size else red)) < 1e-9


def test_strokes_keep_their_area(spark):
    rows = [(6.0, 2.0, "patch", 1.0, 8.0, 3.0), (2.0, 2.0, "ribbon", 1.0, 8.0, 2.2), (2.0, 2.0, "accent", 1.0, 8.0, 2.8), (2.0, 2.0, "accent", 1.0, 2.5, 2.5), (1.0, 4.0, "patch", 5.0, 3.0, 3.0), (90.0, 1.0, None, None, None, 8.0), (0.0, 1.0, "patch", 1.0, 8.0, None), (None, 1.0, "patch", 1.0, 8.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, family string, low double, high double, want double")
    sides = shapes.stroke_size(*[F.col(c) for c in ("a", "b", "family", "low", "high")], shapes.ASPECT_FLOORS)
    for r in df.select("*", *[c.alias(n) for c, n in zip(sides, ("long", "short", "aspect"), strict=True)]).collect():
        if r["want"] is None:
            assert r["aspect"] is None and r["long"] is None and r["short"] is None
        else:
            assert abs(r["aspect"] - r["want"]) < 1e-12 and abs(r["long"] / r["short"] - r["want"]) < 1e-9 and abs(r["long"] * r["short"] - r["a"] * r["b"]) < 1e-9
    ends = [shapes.stroke_width(F.lit(4.0), F.lit(s), F.lit(e), F.lit(learned), F.lit(along)).alias(f"w{i}") for i, (s, e, learned, along) in enumerate([(1.0, 1.0, 1.0, 0.5), (0.5, 1.0, 1.0, 0.5), (0.5, 1.0, 0.0, 1.0), (1.0, 0.0, 2.0, 3.0)])]
    assert [round(x, 12) for x in spark.range(1).select(*ends).first()] == [4.0, 3.0, 2.0, 0.0]


def test_underpainting_ends_at_the_selected_point(spark):
    rows = [(0.1, 0.4), (0.4, 0.4), (0.0, 0.0), (0.1, None), (None, 0.4)]
    df = spark.createDataFrame(rows, "p double, s double")
    colours = compositing.training_colour(F.lit(100.0), F.lit(50.0), F.lit(10.0), F.col("p"), F.col("s"))
    got = [tuple(round(x, 9) for x in r) for r in df.select(*colours).collect()]
    shade = round(0.2126 * 100 + 0.7152 * 50 + 0.0722 * 10, 9)
    assert got == [(shade,) * 3] + [(100.0, 50.0, 10.0)] * 4


def plain_ssim(x, y):
    at = np.arange(11) - 5
    w = np.exp(-at * at / 4.5)
    w = np.outer(w, w) / w.sum() ** 2
    found = []
    for r in range(x.shape[0] - 10):
        for c in range(x.shape[1] - 10):
            a, b = x[r : r + 11, c : c + 11], y[r : r + 11, c : c + 11]
            if not np.isnan(a).any() and not np.isnan(b).any():
                ma, mb = (w * a).sum(), (w * b).sum()
                va, vb, both = (w * a * a).sum() - ma * ma, (w * b * b).sum() - mb * mb, (w * a * b).sum() - ma * mb
                found.append((2 * ma * mb + 6.5025) * (2 * both + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225)))
    return found


@pytest.mark.parametrize("tile", [8, 256])
def test_windowed_ssim_with_holes_and_small_images(spark, tile):
    rng = np.random.default_rng(6)
    images = {name: rng.uniform(0, 255, (2, *size)) for name, size in {"a": (30, 23), "small": (10, 40), None: (11, 11)}.items()}
    images["a"][0, 3, 4] = np.nan  # no row
    images["a"][1, 25, 20] = np.nan  # a null
    rows = [(n, r, c, float(x[r, c]), None if np.isnan(y[r, c]) else float(y[r, c])) for n, (x, y) in images.items() for r in range(x.shape[0]) for c in range(x.shape[1]) if not np.isnan(x[r, c])]
    df = spark.createDataFrame([*rows, rows[0]], "image string, r int, c int, x double, y double")
    got = {r["image"]: r for r in compositing.ssim_windowed(df, ["image"], F.col("r"), F.col("c"), F.col("x"), F.col("y"), tile=tile).collect()}
    for name, (x, y) in images.items():
        want = plain_ssim(x, y)
        assert got[name]["windows"] == len(want)
        assert abs(got[name]["ssim"] - np.mean(want)) < 1e-9 if want else got[name]["ssim"] is None
    same = compositing.ssim_windowed(df, ["image"], F.col("r"), F.col("c"), F.col("x"), F.col("x"), tile=tile).filter("windows > 0").collect()
    assert all(abs(r["ssim"] - 1) < 1e-12 for r in same)
    assert compositing.ssim_windowed(df.limit(0), ["image"], F.col("r"), F.col("c"), F.col("x"), F.col("y")).count() == 0
