"""Cross-site boilerplate lines by distinct-site spread (native DataFrame operations).

Every non-blank line of every text is hashed (128 bits) and a HyperLogLog sketch
of its sites is kept per hash; sketches are built in the map tasks and merged by
the aggregation, so a line that all pages carry is one row per task in the
shuffle.  Lines whose estimate lies clearly at or above ``min_sites`` are
boilerplate; lines within the sketch's error band of the threshold get exact
distinct counts.  A line is judged wrongly only if its sketch is off by more than
``BAND`` standard errors; below some hundred sites a sketch of ``LG_K`` bits is
nearly always exact.  All copies of a boilerplate line go.

Defined cases: null text is an empty line and stays null; blank lines (ASCII white space only) stay; a
null site counts as no site; a text of boilerplate alone becomes empty, its row
stays; repeated rows are treated alike, as sites and not rows are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

BLANKS = " \t\n\x0b\f\r"
MIN_SITES = 10
LG_K = 12
#: Half width of the exact band, in standard errors of the sketch.
BAND = 4.0


def line_key(line: Column) -> Column:
    """128 bits that name a line."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(0x6C696E65), line).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def solid(line: Column) -> Column:
    """Whether a line holds more than ASCII white space."""
    return F.btrim(line, F.lit(BLANKS)) != ""


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Names a row by id and text, so that null or repeated ids do no harm."""
    return [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__k1"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__k2")]


def boilerplate_lines(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2) of the lines that at least ``min_sites`` distinct sites carry."""
    lines = docs.select(F.col(site_col).cast("string").alias("site"), F.explode(text_lines(F.col(text_col))).alias("line")).filter(solid(F.col("line"))).select(line_key(F.col("line")).alias("key"), "site").select("key.h1", "key.h2", "site")
    half = BAND * 1.04 / 2 ** (lg_k / 2)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites")).filter(F.col("sites") >= min_sites * (1 - half))
    spread = scratch.materialise(spread, "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + half)).select("h1", "h2")
    near = spread.filter(F.col("sites") <= min_sites * (1 + half)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).filter(F.col("sites") >= min_sites).select("h1", "h2")
    return scratch.materialise(sure.union(exact), "line-boilerplate")


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and ``lines_removed``; a clashing column is replaced."""
    boiler = boilerplate_lines(docs, site_col, text_col, min_sites, lg_k)
    columns = [c for c in docs.columns if c != "lines_removed"]
    rest = F.struct(*[c for c in columns if c != text_col]).alias("row")  # whatever the names, none meets ours
    keyed = docs.select(*row_key(id_col, text_col), F.posexplode(text_lines(F.col(text_col))).alias("place", "line")).filter(solid(F.col("line"))).select("__k1", "__k2", "place", line_key(F.col("line")).alias("key"))
    found = keyed.select("__k1", "__k2", "place", "key.h1", "key.h2").join(boiler, ["h1", "h2"])
    gone = found.groupBy("__k1", "__k2").agg(F.collect_set("place").alias("__gone"))  # bounded by a text's lines
    # The lines are split before the join, so that taking them by place costs one step each.
    split = docs.select(rest, F.split(text_col, "\n").alias("__lines"), *row_key(id_col, text_col))
    # Merged rather than broadcast at any size: documents with boilerplate grow with the corpus.
    joined = split.join(gone.hint("merge"), ["__k1", "__k2"], "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda at: F.get(F.col("__lines"), at)), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns], F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("lines_removed"))


def oracle_sql(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for (doc_id, n_lines, n_removed, kept_sha256) with exact site counts."""
    return rf"""
WITH s AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, source, parts[i] AS line, i FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s) AS x),
b AS (SELECT line FROM l WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*') GROUP BY line HAVING count(DISTINCT source) >= {min_sites}),
k AS (SELECT l.*, b.line IS NOT NULL AS gone FROM l LEFT JOIN b USING (line))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
