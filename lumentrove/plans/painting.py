"""Queries of paint shapes, local structure, cell growth and run progress.

Images are made of embeddings: 64 of them are the rows of one, in whole steps of brightness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compositing, growth, layers, regions, results, shapes
from ..streaming import progress
from .queries import chunks, chunks_sql, query, r6, rounded_all, table

IMAGES_SQL = f"(SELECT vec_id // 64 AS image, vec_id % 64 AS y, piece::BIGINT AS x, round(v0 * 255) AS v FROM {chunks_sql(1)} AS e)"


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = chunks(spark, sf_dir, 1)
    return e.select(F.expr("vec_id div 64").alias("image"), (F.col("vec_id") % 64).alias("y"), F.col("piece").cast("long").alias("x"), F.round(F.col("v0") * 255).alias("v"))


def diffused_sql(place: str, quota: str, whole: str) -> str:
    """How many rows before a place are taken, and whether it is."""
    return f"CASE WHEN {whole} > 0 THEN {place} * {quota} // {whole} ELSE 0 END"


@query(f"""
WITH n AS (SELECT event_id, user_id, user_id % 4 AS a, 1 + user_id % 3 AS b, 2 AS c, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS nth, count(*) OVER (PARTITION BY user_id) AS layer_rows FROM events),
f AS (SELECT *, layer_rows * a::DOUBLE / (a + b + c) AS ea, layer_rows * b::DOUBLE / (a + b + c) AS eb, layer_rows * c::DOUBLE / (a + b + c) AS ec FROM n),
l AS (SELECT *, layer_rows - floor(ea) - floor(eb) - floor(ec) AS lost, ea - floor(ea) AS ra, eb - floor(eb) AS rb, ec - floor(ec) AS rc FROM f),
q AS (SELECT *, (floor(ea) + ((rb > ra)::INT + (rc > ra)::INT < lost)::INT)::BIGINT AS qa, (floor(eb) + ((ra >= rb)::INT + (rc > rb)::INT < lost)::INT)::BIGINT AS qb FROM l),
d AS (SELECT *, {diffused_sql("nth", "qa", "layer_rows")} AS ta, {diffused_sql("(nth + 1)", "qa", "layer_rows")} AS ua, layer_rows - qa AS w FROM q),
g AS (SELECT *, {diffused_sql("(nth - ta)", "qb", "w")} AS tb, {diffused_sql("(nth - ta + 1)", "qb", "w")} AS ub FROM d),
s AS (SELECT *, CASE WHEN ua > ta THEN 'triangle' WHEN ub > tb THEN 'trapezoid' ELSE 'rectangle' END AS shape, (nth + 1) * 0.6180339887498949::DOUBLE AS way FROM g),
r AS (SELECT *, CASE shape WHEN 'triangle' THEN 0.1::DOUBLE WHEN 'rectangle' THEN 0.9::DOUBLE ELSE 0.1::DOUBLE + 0.8::DOUBLE * (way - floor(way)) END AS ratio FROM s)
SELECT event_id, user_id, nth, layer_rows, shape, round(ratio, 6) + 0.0 AS edge_ratio, round(8 * sqrt(2 / (1 + ratio)), 6) + 0.0 AS long_edge, round(8 * sqrt(2 / (1 + ratio)) * ratio, 6) + 0.0 AS short_edge, round(5 * sqrt(2 / (1 + ratio)), 6) + 0.0 AS height FROM r
""")
def shape_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are layers, in which the largest values are painted first."""
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    mixed = shapes.mix(e, ["user_id"], [(F.col("value"), True), (F.col("event_id"), False)], {"triangle": user % 4, "trapezoid": 1 + user % 3, "rectangle": F.lit(2)})
    out = mixed.withColumn("edge_ratio", shapes.edge_ratio(F.col("shape"), F.col("nth"), F.lit(0.1), F.lit(0.9)))
    edges = shapes.tapered(F.lit(8.0), F.lit(5.0), F.col("edge_ratio"))
    return out.select("event_id", "user_id", "nth", "layer_rows", "shape", r6("edge_ratio").alias("edge_ratio"), *[r6(c).alias(n) for c, n in zip(edges, ("long_edge", "short_edge", "height"), strict=True)])


@query(f"""
WITH p AS {IMAGES_SQL},
s AS (SELECT a.image, a.x, a.y, count(*) AS n, sum(b.v) AS s, sum(b.v * b.v) AS ss FROM p AS a JOIN p AS b ON a.image = b.image AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY ALL),
w AS (SELECT *, (ss - s * s / n) / n AS local_variance FROM s)
SELECT image, x, y, n AS window_pixels, s / n AS local_mean, local_variance, 0.25::DOUBLE + 0.75::DOUBLE * CASE WHEN local_variance < 2000 THEN 1 - local_variance / 2000 ELSE 0 END AS ratio FROM w
""")
def flat_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = regions.local_variance(image_rows(spark, sf_dir), ["image"], F.col("x"), F.col("y"), F.col("v"), 3)
    ratio = regions.flat_ratio(F.lit(0.25), F.lit(1.0), F.col("local_variance"), F.lit(2000.0))
    return out.select("image", "x", "y", "window_pixels", "local_mean", "local_variance", ratio.alias("ratio"))  # not rounded: sums of whole numbers are exact


@query(f"""
WITH p AS {IMAGES_SQL},
g AS (SELECT image, x, y, (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / 2 AS dx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / 2 AS dy FROM p WINDOW r AS (PARTITION BY image, y ORDER BY x), c AS (PARTITION BY image, x ORDER BY y)),
t AS (SELECT a.image, a.x, a.y, sum(b.dx * b.dx) AS xx, sum(b.dx * b.dy) AS xy, sum(b.dy * b.dy) AS yy FROM g AS a JOIN g AS b ON a.image = b.image AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL),
s AS (SELECT *, sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) AS gap, degrees(atan2(2 * xy, xx - yy)) / 2 + 90 AS flow FROM t)
SELECT image, x, y, CASE WHEN gap > 0 THEN round(CASE WHEN flow >= 180 THEN flow - 180 ELSE flow END, 6) + 0.0 END AS flow_degrees, CASE WHEN xx + yy > 0 THEN round(gap / (xx + yy), 6) + 0.0 END AS coherence, xx + yy AS energy FROM s
""")
def colour_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 16 pixels, so that images have several."""
    out = regions.colour_flow(image_rows(spark, sf_dir), ["image"], F.col("x"), F.col("y"), {"v": F.col("v")}, tile=16)
    return out.select("image", "x", "y", *rounded_all(out, "flow_degrees", "coherence"), "energy")


@query(f"""
WITH RECURSIVE p AS {IMAGES_SQL},
d AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h, 10 + image % 7 AS cells, 60 + image * 13 % 90 AS budget FROM p GROUP BY image),
n1 AS (SELECT *, greatest(1, least(w, floor(sqrt(cells * w / h::DOUBLE) + 0.5)))::BIGINT AS nx FROM d),
n2 AS (SELECT *, greatest(1, least(h, floor(cells / nx::DOUBLE + 0.5)))::BIGINT AS ny FROM n1),
r AS (SELECT image, x, y, v::BIGINT AS v, budget - nx * ny AS room, ((x + 1) * nx - 1) // w AS gx, ((y + 1) * ny - 1) // h AS gy, w, h, nx, ny FROM p JOIN n2 USING (image)),
c AS (
  SELECT image, x, y, v, room, gx, gy, 1::BIGINT AS path, gx * w // nx AS x0, (gx + 1) * w // nx AS x1, gy * h // ny AS y0, (gy + 1) * h // ny AS y1 FROM r
  UNION ALL
  SELECT image, x, y, v, room, gx, gy, path * 2 + CASE WHEN second THEN 1 ELSE 0 END, CASE WHEN wide AND second THEN cut ELSE x0 END, CASE WHEN wide AND NOT second THEN cut ELSE x1 END, CASE WHEN NOT wide AND second THEN cut ELSE y0 END, CASE WHEN NOT wide AND NOT second THEN cut ELSE y1 END
  FROM (SELECT *, CASE WHEN wide THEN x >= cut ELSE y >= cut END AS second FROM (SELECT *, x1 - x0 >= y1 - y0 AS wide, CASE WHEN x1 - x0 >= y1 - y0 THEN x0 + (x1 - x0) // 2 ELSE y0 + (y1 - y0) // 2 END AS cut FROM c WHERE x1 - x0 > 1 OR y1 - y0 > 1) AS k) AS k2
),
nodes AS (SELECT image, gx, gy, path, x0, x1, y0, y1, any_value(room) AS room, count(*) AS n, sum(v) AS s, sum(v * v) AS ss FROM c GROUP BY ALL),
e AS (SELECT * EXCLUDE (room, s, ss), room, s / n::DOUBLE AS mean, ((n * ss - s * s) // n)::BIGINT AS error FROM nodes),
k AS (SELECT image, gx, gy, path, row_number() OVER (PARTITION BY image ORDER BY error DESC, floor(log2(path)), gy, gx, path) AS place, room FROM e WHERE x1 - x0 > 1 OR y1 - y0 > 1),
split AS (SELECT image, gx, gy, path FROM k WHERE place <= room)
SELECT image, gx AS grid_x, gy AS grid_y, path, x0, x1, y0, y1, n AS pixels, round(mean, 6) + 0.0 AS mean, error FROM e
WHERE (path = 1 OR (image, gx, gy, path // 2) IN (SELECT (image, gx, gy, path) FROM split)) AND (image, gx, gy, path) NOT IN (SELECT (image, gx, gy, path) FROM split)
""")
def cell_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = image_rows(spark, sf_dir)
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    image = F.col("image")
    out = growth.grow(pixels.join(sizes, "image"), ["image"], F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.col("v"), 10 + image % 7, 60 + image * 13 % 90)
    return out.withColumn("mean", r6("mean"))


@query("""
WITH e AS (SELECT *, (props->>'$.k')::DOUBLE AS k, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 45 MINUTE, true) AS fresh FROM events),
r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM e),
g AS (SELECT user_id, run, min(ts) AS started, max(ts) AS ended, count(*) AS events, max(event_id)::DOUBLE AS steps, min(event_id)::DOUBLE AS first_step, max(500 + k) AS goal, arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS quality FROM r GROUP BY 1, 2),
t AS (SELECT *, (epoch_us(ended) - epoch_us(started)) / 1e6 AS elapsed_seconds FROM g)
SELECT user_id, started, ended, elapsed_seconds, events, steps, CASE WHEN elapsed_seconds > 0 THEN round((steps - first_step) / elapsed_seconds, 6) + 0.0 END AS speed, round(least(1.0, steps / (goal * 10)), 6) + 0.0 AS progress, quality FROM t
""")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users run trainings whose steps are event ids; a silence of more than 45 minutes ends a run."""
    goal = (500 + F.get_json_object("props", "$.k").cast("double")) * 10
    out = progress.run_progress(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_id"), {"quality": F.col("value")}, goal, "45 minutes")
    return out.withColumns({"speed": r6("speed"), "progress": r6("progress")})


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN ['reset', 'clear', 'image-replaced'][event_id % 3 + 1] ELSE event_type END AS kind, ['planar', 'rectangle', 'brush', 'virtual-camera', 'retired'][event_id % 5 + 1] AS algorithm FROM events),
b AS (SELECT event_id, user_id, kind, nullif(last_value(CASE WHEN kind = 'completed' THEN algorithm WHEN kind IN ('reset', 'clear', 'image-replaced') THEN '' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS result_algorithm FROM e)
SELECT *, coalesce(result_algorithm <> 'retired', false) AS image_export, coalesce(result_algorithm IN ('planar', 'virtual-camera'), false) AS point_export, coalesce(result_algorithm = 'virtual-camera', false) AS tilt FROM b
""")
def export_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are completed runs, errors end them, and all events ask what may be exported."""
    named = lambda names, by: F.get(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % by).cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", named(results.ENDS, 3)).otherwise(F.col("event_type"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("kind"), named((*results.IMAGE_EXPORT, "retired"), 5).alias("algorithm"))
    return results.eligibility(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.col("kind"), F.col("algorithm")).drop("ts", "algorithm")


PARENT_SQL = "CASE WHEN event_id % 1000 > 0 THEN event_id - 1 - event_id % 7 END"


@query(f"""
WITH RECURSIVE s AS (SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 AND event_id % 5 > 0 THEN event_id // 7 % 9 END AS own, {PARENT_SQL} AS parent FROM events),
f AS (
  SELECT event_id, own AS paint_layer FROM s WHERE own IS NOT NULL
  UNION ALL
  SELECT s.event_id, f.paint_layer FROM f JOIN s ON s.parent = f.event_id AND s.own IS NULL
)
SELECT event_id, own, parent, f.paint_layer FROM s LEFT JOIN f USING (event_id)
""")
def inherited_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splats with parents of smaller ids; a few have a layer of their own."""
    event = F.col("event_id")
    own, parent = F.when((event % 7 == 0) & (event % 5 > 0), F.expr("event_id div 7") % 9), F.when(event % 1000 > 0, event - 1 - event % 7)
    e = table(spark, sf_dir, "events").select("event_id", own.alias("own"), parent.alias("parent"))
    return layers.inherited(e, "event_id", F.col("parent"), F.col("own"))


@query(f"""
WITH p AS {IMAGES_SQL},
d AS (SELECT image, max(x) AS w, max(y) AS h FROM p GROUP BY image),
s AS (SELECT event_id AS splat, event_id % (SELECT max(image) + 2 FROM d) AS image, event_id * 7 % 80 - 8 AS x0, event_id * 7 % 80 - 8 + event_id % 30 - 2 AS x1, event_id * 11 % 70 - 4 AS y0, event_id * 11 % 70 - 4 + event_id % 17 AS y1, value AS red, value + 1 AS green, event_id % 3 > 0 AS moved FROM events),
c AS (SELECT splat, avg(v) AS red, avg(255 - v) AS green FROM s JOIN p ON s.image = p.image AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE moved GROUP BY splat)
SELECT splat, image, round(coalesce(c.red, s.red), 6) + 0.0 AS red, round(coalesce(c.green, s.green), 6) + 0.0 AS green, c.splat IS NOT NULL AS repaired FROM s LEFT JOIN c USING (splat)
""")
def repaired_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are splats on the images, and one more without an image; two of three have moved forward."""
    pixels, event = image_rows(spark, sf_dir), F.col("event_id")
    images = pixels.agg((F.max("image") + 2).alias("images"))  # one row
    e = table(spark, sf_dir, "events").join(F.broadcast(images))
    left, top = event * 7 % 80 - 8, event * 11 % 70 - 4
    splats = e.select(event.alias("splat"), (event % F.col("images")).alias("image"), left.alias("x0"), (left + event % 30 - 2).alias("x1"), top.alias("y0"), (top + event % 17).alias("y1"), F.col("value").alias("red"), (F.col("value") + 1).alias("green"), (event % 3 > 0).alias("moved"))
    out = layers.repaired(splats, pixels, ["image"], "splat", F.col("moved"), tuple(F.col(c) for c in ("x0", "x1", "y0", "y1")), F.col("x"), F.col("y"), {"red": F.col("v"), "green": 255 - F.col("v")})
    return out.select("splat", "image", *rounded_all(out, "red", "green"), "repaired")


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS a, 1.0::DOUBLE + l_discount * 100 AS b, CASE l_linenumber % 3 WHEN 0 THEN 'ribbon' WHEN 1 THEN 'accent' ELSE 'patch' END AS family, 1 + l_orderkey % 3 AS low, l_orderkey % 9 AS high, l_tax * 10 AS learned FROM lineitem),
m AS (SELECT *, greatest(1, high)::DOUBLE AS most, CASE family WHEN 'ribbon' THEN 2.2 WHEN 'accent' THEN 2.8 ELSE 1 END::DOUBLE AS own FROM s),
r AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN greatest(least(most, greatest(low, own)), least(most, a / b)) END AS ratio FROM m)
SELECT l_orderkey, l_linenumber, family, round(sqrt(a * b * ratio), 6) + 0.0 AS long_side, round(sqrt(a * b / ratio), 6) + 0.0 AS short_side, round(ratio, 6) + 0.0 AS aspect, round(sqrt(a * b / ratio) * (0.4::DOUBLE + 0.6::DOUBLE * greatest(0, least(1, learned)) * 0.75), 6) + 0.0 AS width FROM r
""")
def brush_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines are strokes of three families; the width is that at three quarters of the way."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    family = F.when(line % 3 == 0, "ribbon").when(line % 3 == 1, "accent").otherwise("patch")
    items = table(spark, sf_dir, "lineitem").withColumn("family", family)
    sides = shapes.stroke_size(F.col("l_quantity").cast("double"), 1.0 + F.col("l_discount") * 100, F.col("family"), (1 + order % 3).cast("double"), (order % 9).cast("double"), shapes.ASPECT_FLOORS)
    out = items.withColumns(dict(zip(("long_side", "short_side", "aspect"), sides, strict=True)))
    out = out.withColumn("width", shapes.stroke_width(F.col("short_side"), F.lit(0.4), F.lit(1.0), F.col("l_tax") * 10, F.lit(0.75)))
    return out.select("l_orderkey", "l_linenumber", "family", *rounded_all(out, "long_side", "short_side", "aspect", "width"))


@query(f"""
WITH p AS (SELECT vec_id, piece, v0 * 255 AS r, v1 * 255 AS g, v2 * 255 AS b, vec_id % 100 < 40 AS under FROM {chunks_sql(3)} AS e),
t AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS shade FROM p)
SELECT vec_id, piece, round(CASE WHEN under THEN shade ELSE r END, 6) + 0.0 AS red, round(CASE WHEN under THEN shade ELSE g END, 6) + 0.0 AS green, round(CASE WHEN under THEN shade ELSE b END, 6) + 0.0 AS blue FROM t
""")
def underpainting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colours on which a run of 100 steps, one for each embedding in turn, is trained; it begins with lightness for 40."""
    p = chunks(spark, sf_dir, 3)
    colours = compositing.training_colour(*[F.col(f"v{i}") * 255 for i in range(3)], (F.col("vec_id") % 100) / 100, F.lit(0.4))
    return p.select("vec_id", "piece", *[r6(c).alias(n) for c, n in zip(colours, ("red", "green", "blue"), strict=True)])
