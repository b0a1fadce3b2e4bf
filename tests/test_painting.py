"""Shape quotas, local structure, cell growth and run progress against plain Python."""

import collections
import datetime
import heapq
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrove.operators import growth, ranking, regions, shapes
from lumentrove.streaming import progress

GRID = "image string, x long, y long, v double"


def picture(rng, width, height, name="a"):
    return {(name, x, y): float(rng.randrange(256)) for x in range(width) for y in range(height)}


def frame(spark, values):
    return spark.createDataFrame([(*k, v) for k, v in values.items()], GRID)


def test_numbers_do_not_follow_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(9), i) for i in range(500)]
    want = {}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: (n, len(mine)) for n, r in enumerate(mine)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "k string, v int, id int").repartition(parts)
        got = ranking.numbered(df, ["k"], [(F.col("v"), True), (F.col("id"), False)], "n", "all").collect()
        assert {r["id"]: (r["n"], r["all"]) for r in got} == want
    empty = spark.createDataFrame([], "k string, v int, id int")
    assert ranking.numbered(empty, ["k"], [(F.col("id"), False)], "n").count() == 0


def test_best_rows_are_an_exact_cut(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 0, 0, 5, 5, 1000, rng.randrange(10**12)]), i, "x") for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v long, id int, _step string")  # a clashing name
    room = F.when(F.col("k") == "a", 70).when(F.col("k").isNull(), 10**9).otherwise(0)
    got = ranking.best_rows(df, ["k"], F.col("v"), [F.col("id")], room)
    assert got.columns == df.columns
    want = {r[2] for r in sorted((r for r in rows if r[0] == "a"), key=lambda r: (-r[1], r[2]))[:70]} | {r[2] for r in rows if r[0] is None}
    found = [r["id"] for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_quotas_and_diffusion(spark):
    cases = [(n, *w) for n in (0, 1, 2, 7, 1000) for w in itertools.product([0.0, 1.0, 2.5, None, -1.0, float("nan")], repeat=3)]
    df = spark.createDataFrame(cases, "n long, a double, b double, c double")
    for r in df.withColumn("q", shapes.quotas(F.col("n"), [F.col(c) for c in "abc"])).collect():
        weights = [w if w is not None and w > 0 else 0.0 for w in (r["a"], r["b"], r["c"])]
        weights = weights if sum(weights) else [1.0] * 3
        assert sum(r["q"]) == r["n"]
        assert all(abs(q - r["n"] * w / sum(weights)) < 1 for q, w in zip(r["q"], weights, strict=True))
    rows = spark.range(700).select((F.col("id") % 2).alias("layer"), F.col("id").alias("at"))
    weights = {"triangle": F.lit(1), "trapezoid": F.col("layer") * 2, "rectangle": F.lit(4)}
    once, again = ({(r["layer"], r["nth"]): r["shape"] for r in shapes.mix(rows.repartition(p), ["layer"], [(F.col("at"), False)], weights).collect()} for p in (1, 9))
    assert once == again and None not in once.values()
    for layer, share in ((0, 1 / 5), (1, 1 / 7)):
        row = [once[layer, n] == "triangle" for n in range(350)]
        assert all(abs(sum(row[: n + 1]) - share * (n + 1)) <= 1 for n in range(350))  # spread over the order
        assert sum(row) == round(350 * share)
        assert layer or "trapezoid" not in {once[0, n] for n in range(350)}


def test_tapering_keeps_the_area(spark):
    df = spark.createDataFrame([(r / 10,) for r in range(11)], "r double")
    long, short, height = shapes.tapered(F.lit(8.0), F.lit(5.0), F.col("r"))
    for r in df.select("r", long.alias("l"), short.alias("s"), height.alias("h")).collect():
        assert math.isclose((r["l"] + r["s"]) / 2 * r["h"], 40) and math.isclose(r["s"], r["l"] * r["r"])
    ends = spark.range(3).select(shapes.edge_ratio(F.element_at(F.array(*[F.lit(s) for s in ("triangle", "rectangle", "trapezoid")]), (F.col("id") + 1).cast("int")), F.col("id"), F.lit(-1.0), F.lit(0.8)).alias("r")).collect()
    assert (ends[0]["r"], ends[1]["r"]) == (0.0, 0.8) and 0 < ends[2]["r"] < 0.8


@pytest.mark.parametrize("radius", [0, 2, 40])
def test_local_variance_by_windows(spark, radius):
    rng = random.Random(3)
    image = picture(rng, 13, 9)
    image[("a", 4, 4)] = None
    got = regions.local_variance(frame(spark, image), ["image"], F.col("x"), F.col("y"), F.col("v"), radius).collect()
    assert len(got) == len(image)
    for r in got:
        near = [v for (_, x, y), v in image.items() if abs(x - r["x"]) <= radius and abs(y - r["y"]) <= radius and v is not None]
        assert r["window_pixels"] == len(near)
        if near:
            assert math.isclose(r["local_mean"], np.mean(near)) and math.isclose(r["local_variance"], np.var(near), abs_tol=1e-9)
        else:
            assert r["local_mean"] is None and r["local_variance"] is None


def test_flow_is_the_same_in_any_tiles(spark):
    rng = random.Random(4)
    image = picture(rng, 23, 17) | picture(rng, 1, 1, "dot")
    for hole in ((5, 5), (6, 5), (22, 16)):
        del image[("a", *hole)]
    both = [{(r["image"], r["x"], r["y"]): tuple(r)[3:] for r in regions.colour_flow(frame(spark, image), ["image"], F.col("x"), F.col("y"), {"r": F.col("v"), "g": F.col("v") * 2 % 101}, tile=t).collect()} for t in (5, 64)]
    assert both[0] == both[1] and both[0].keys() == image.keys()
    assert both[0]["dot", 0, 0] == (None, None, 0.0)
    values = {k: (v, v * 2 % 101) for k, v in image.items()}
    slope = {}
    for (n, x, y), here in values.items():
        step = lambda dx, dy: [(b - a) / 2 for a, b in zip(values.get((n, x - dx, y - dy), here), values.get((n, x + dx, y + dy), here), strict=True)]  # noqa: B023, E731
        slope[n, x, y] = (step(1, 0), step(0, 1))
    for (n, x, y), (flow, coherence, energy) in both[0].items():
        around = [slope[n, i, j] for i in range(x - 2, x + 3) for j in range(y - 2, y + 3) if (n, i, j) in slope]
        dot = lambda a, b: sum(p * q for s in around for p, q in zip(s[a], s[b], strict=True))  # noqa: B023, E731
        least, most = np.linalg.eigvalsh([[dot(0, 0), dot(0, 1)], [dot(0, 1), dot(1, 1)]])
        assert math.isclose(energy, least + most, abs_tol=1e-6)
        if energy:
            assert math.isclose(coherence, (most - least) / energy, abs_tol=1e-6)
            way = np.array([math.cos(math.radians(flow)), math.sin(math.radians(flow))])
            assert 0 <= flow < 180 and math.isclose(way @ [[dot(0, 0), dot(0, 1)], [dot(0, 1), dot(1, 1)]] @ way, least, rel_tol=1e-6, abs_tol=1e-6)


def test_flow_of_stripes(spark):
    stripes = {("upright", x, y): float(x % 4 < 2) for x in range(20) for y in range(20)} | {("flat", x, y): float(y % 4 < 2) for x in range(20) for y in range(20)}
    got = {(r["image"], round(r["flow_degrees"]), r["coherence"]) for r in regions.colour_flow(frame(spark, stripes), ["image"], F.col("x"), F.col("y"), {"v": F.col("v")}).collect()}
    assert got == {("upright", 90, 1.0), ("flat", 0, 1.0)}


def best_first(image, width, height, count, budget):
    """Splits the cell with the largest error one at a time."""
    nx = max(1, min(width, math.floor(math.sqrt(count * width / height) + 0.5)))
    ny = max(1, min(height, math.floor(count / nx + 0.5)))

    def made(gx, gy, path, box):
        x0, x1, y0, y1 = box
        values = [int(v) for (x, y), v in image.items() if x0 <= x < x1 and y0 <= y < y1]
        if not values:
            return None
        error = (len(values) * sum(v * v for v in values) - sum(values) ** 2) // len(values)
        return (-error, path.bit_length(), gy, gx, path, box)

    heap = [made(i, j, 1, (i * width // nx, (i + 1) * width // nx, j * height // ny, (j + 1) * height // ny)) for i in range(nx) for j in range(ny)]
    heap, done, room = [c for c in heap if c], [], budget - nx * ny
    heapq.heapify(heap)
    while heap:
        cell = heapq.heappop(heap)
        _, _, gy, gx, path, (x0, x1, y0, y1) = cell
        if room <= 0 or (x1 - x0 == 1 and y1 - y0 == 1):
            done.append(cell)
            continue
        room -= 1
        wide = x1 - x0 >= y1 - y0
        cut = (x0 + x1) // 2 if wide else (y0 + y1) // 2
        for second, box in enumerate([(x0, cut, y0, y1), (cut, x1, y0, y1)] if wide else [(x0, x1, y0, cut), (x0, x1, cut, y1)]):
            child = made(gx, gy, path * 2 + second, box)
            if child:
                heapq.heappush(heap, child)
    return {(gx, gy, path, *box, -error) for error, _, gy, gx, path, box in done}


def test_growth_is_best_first(spark):
    rng = random.Random(5)
    pictures = {"noise": ({(x, y): rng.randrange(256) for x in range(19) for y in range(11)}, 19, 11, 6, 40), "flat": (dict.fromkeys(itertools.product(range(8), range(8)), 7), 8, 8, 4, 23), "small": ({(x, y): x * y for x in range(3) for y in range(2)}, 3, 2, 2, 50), "full": ({(x, y): x + y for x in range(9) for y in range(4)}, 9, 4, 8, 5)}
    pictures["holes"] = ({k: v for k, v in pictures["noise"][0].items() if k[0] > 3}, 19, 11, 6, 30)
    rows = [(name, x, y, w, h, v, n, b) for name, (image, w, h, n, b) in pictures.items() for (x, y), v in image.items()]
    rows += [("noise", None, 1, 19, 11, 5, 6, 40), ("noise", 19, 1, 19, 11, 5, 6, 40), ("noise", 1, 1, 19, 11, None, 6, 40)]
    df = spark.createDataFrame(rows, "image string, x long, y long, w long, h long, v long, n long, b long")
    got = growth.grow(df, ["image"], *[F.col(c) for c in ("x", "y", "w", "h", "v", "n", "b")]).collect()
    for name, (image, *rest) in pictures.items():
        mine = [r for r in got if r["image"] == name]
        assert {(r["grid_x"], r["grid_y"], r["path"], r["x0"], r["x1"], r["y0"], r["y1"], r["error"]) for r in mine} == best_first(image, *rest), name
        assert sum(r["pixels"] for r in mine) == len(image)
    sizes = {name: sum(r["image"] == name for r in got) for name in pictures}
    assert (sizes["noise"], sizes["flat"], sizes["small"]) == (40, 23, 6)


AT = datetime.datetime(2026, 1, 1, 12, 0)
EVENTS = "run string, ts timestamp, step int, goal int, loss double"


def reported(minute, run="a", step=0, loss=None, goal=100):
    return (run, AT + datetime.timedelta(minutes=minute), step, goal, loss)


def test_progress_of_runs(spark):
    rows = [reported(0, step=0), reported(1, step=30, loss=0.5), reported(10, step=60), reported(41, step=5, loss=0.9), reported(12, "b", None), (None, None, 1, 1, 1.0), (None, AT, 150, 100, 0.1)]
    got = {(r["run"], r["started"]): r for r in progress.run_progress(spark.createDataFrame(rows, EVENTS), "run", "ts", F.col("step"), {"loss": F.col("loss")}, F.col("goal")).collect()}
    first, second = got["a", AT], got["a", AT + datetime.timedelta(minutes=41)]
    assert (first["events"], first["steps"], first["elapsed_seconds"], first["speed"], first["progress"], first["loss"]) == (3, 60, 600, 0.1, 0.6, 0.5)
    assert (second["events"], second["speed"], second["loss"]) == (1, None, 0.9)
    exact = spark.createDataFrame([reported(0), reported(30)], EVENTS)  # exactly the gap later is the same run
    assert progress.run_progress(exact, "run", "ts", F.col("step"), {}).count() == 1
    assert got["b", AT + datetime.timedelta(minutes=12)]["steps"] is None
    assert got[None, AT]["progress"] == 1.0 and len(got) == 4


def test_progress_stream_equals_batch(spark, tmp_path):
    batches = [[reported(0, step=1, loss=0.9), reported(20, step=20), reported(9, step=8, loss=0.7)], [reported(5, step=4), reported(200, step=2, loss=0.3), reported(205, "b", 7)], [reported(3, step=99), reported(400, "c")], [reported(900, "d")]]
    found = []
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        out = progress.run_progress(source, "run", "ts", F.col("step"), {"loss": F.col("loss")}, F.col("goal"), late="20 minutes")
        query = out.writeStream.outputMode("append").foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    kept = [r for rows in batches for r in rows if r != reported(3, step=99)]  # came after its run had been reported
    batch = progress.run_progress(spark.createDataFrame(kept, EVENTS), "run", "ts", F.col("step"), {"loss": F.col("loss")}, F.col("goal"))
    last = AT + datetime.timedelta(minutes=900)  # still open
    assert sorted(found) == sorted(map(tuple, batch.filter(F.col("started") < last).collect()))


def test_cells_of_a_batch_level_by_level():
    """A batch of pixels goes down all its grid cells at once: a batch per level, in which the pixels of a cell share path and box."""
    import pyarrow as pa

    boxes = [(0, 5, 0, 3), (5, 6, 0, 1), (6, 40, 2, 4)]
    rows = [(i, x, y, *box) for i, box in enumerate(boxes) for x in range(*box[:2]) for y in range(*box[2:])]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["grid", "_x", "_y", *growth.BOX])
    levels = [cells.to_pylist() for cells in growth.cells_of(batch, ["grid"])]
    assert len(levels[0]) == len(rows) and all(r["path"] == 1 for r in levels[0])
    flat = [r for level in levels for r in level]
    sizes = collections.Counter((r["grid"], r["path"], *[r[c] for c in growth.BOX]) for r in flat)
    assert all(n == (x1 - x0) * (y1 - y0) for (_, _, x0, x1, y0, y1), n in sizes.items())  # every cell holds just the pixels of its box
    assert sum(n == 1 for n in sizes.values()) == len(rows) and len(sizes) == sum(2 * (b[1] - b[0]) * (b[3] - b[2]) - 1 for b in boxes)
