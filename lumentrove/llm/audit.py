"""How the filters of a cleaning recipe interact, by a histogram of failure masks.

Native expressions give every text a mask with one bit for each filter that it
fails.  Four filters look at the text alone; the fifth fails a copy of a text
that a smaller id has.  Its minimum ids come from an aggregation by text, which
the map tasks combine: a text that a third of all rows share is a row per task
for each of its parts and labels, and the minimum of these tells how many of each
are copies.  No row looks its own text's minimum up.

What is left is at most 32 cells per part.  Every order of the filters is read
off the cells: a row is removed by the first filter of the order that it fails.
No order ever looks at a document again.

Texts are grouped by their SHA-256.  The Shapley value of a filter is what it
removes summed over all orders, which is 120 over the number of failed filters
for each row that fails it.

Defined cases: null text is empty, and an empty text has no words (it fails A
only, B and C not); null part is the empty name; a null id is no smaller than any
other and never a copy of another; rows that repeat an id are not copies of one
another; a document with several label rows is good (toxic) if one says so; null
labels and labels without a document say nothing; an empty table gives no rows;
very long texts are handled row by row, in the memory of one text and its words.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
COPY = 1 << FILTERS.index("E")
# The limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A, B, C and D, given the array of its words."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return [n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n, 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text), F.rlike(text, F.lit(SYMBOLS))]


def as_mask(failures: list[Column]) -> Column:
    out = F.lit(0)
    for bit, failed in enumerate(failures):
        out = out + F.when(failed, 1 << bit).otherwise(0)
    return out


def flagged(labels: DataFrame, id_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """(id, good, toxic) with one row per id."""
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(one(good_col).alias("good"), one(toxic_col).alias("toxic"))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    # Null ids find no labels; the second key deals them to all tasks of the join.
    spread = F.when(F.col("id").isNull(), F.spark_partition_id()).otherwise(0)
    slim = read.select("id", spread.alias("spread"), "part", F.unhex(F.sha2("text", 256)).alias("digest"), as_mask(text_failures(F.col("text"), F.col("words"))).alias("mask"))
    told = flagged(labels, id_col, good_col, toxic_col).withColumn("spread", F.lit(0))
    marked = slim.join(told, ["id", "spread"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    kind = ["part", "mask", "good", "toxic"]
    per_id = marked.groupBy("id", "spread", "digest", *kind).agg(F.count(F.lit(1)).alias("n"))  # dealt as the join has it
    named = F.col("id").isNotNull()
    per_text = per_id.groupBy("digest", *kind).agg(F.sum("n").alias("n"), F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"), F.min(F.when(named, F.struct("id", "n"))).alias("low"))
    # A text has few rows here: one for each part and pair of labels.
    first = F.min("low.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("low.id") == first, F.col("low.n")).otherwise(0)
    split = per_text.withColumn("copies", F.when(F.col("low").isNull(), 0).otherwise(F.col("named") - own))
    both = F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), F.col("copies").alias("n")))
    rows = split.select("part", "good", "toxic", F.explode(both).alias("cell")).select("part", "good", "toxic", "cell.*").filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def orders(found: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from ``cells``."""
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32
    steps = parts.select("part", "cells", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.instr(F.lit(FILTERS), F.col("letter")))
    earlier = as_mask([F.instr("filter_order", F.lit(letter)) <= F.col("place") for letter in FILTERS])
    bits = steps.select("part", "cells", "filter_order", (F.col("place") + 1).cast("int").alias("step"), bit.alias("bit"), earlier.alias("earlier"))

    def total(count: str, condition: Callable[[Column], Column], weight: Callable[[Column], Column] = lambda c: F.lit(1)) -> Column:
        return F.aggregate(F.filter("cells", lambda c: condition(c["mask"])), F.lit(0).cast("long"), lambda acc, c: acc + (c[count] * weight(c["mask"])).cast("long"))

    fails = lambda mask: mask.bitwiseAND(F.col("bit")) != 0
    open_ = lambda mask: mask.bitwiseAND(F.col("earlier")) == 0
    removed = lambda mask: fails(mask) & open_(mask)
    return bits.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: ~fails(m) & open_(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & ~open_(m)).alias("redundant"),
        total("n", lambda m: m == F.col("bit")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", fails, lambda m: F.lit(len(ORDERS)) / F.bit_count(m)).alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows per part."""
    return orders(scratch.materialise(cells(docs, labels, **columns), "audit-cells"))


def oracle_sql() -> str:
    """DuckDB SQL for ``interactions``, order by order."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < {LEAST_WORDS} AS a, 100 * len(list_distinct(words)) < {LEAST_DISTINCT_PERCENT} * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS_PERCENT} * length(text) AS c, regexp_matches(text, '{SYMBOLS}') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INTEGER) AS good, max((coalesce(toxic, 0) = 1)::INTEGER) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, a::INTEGER + 2 * b::INTEGER + 4 * c::INTEGER + 8 * d::INTEGER + 16 * e::INTEGER AS mask, count(*)::BIGINT AS n, coalesce(sum(good), 0)::BIGINT AS good, coalesce(sum(toxic), 0)::BIGINT AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits FROM x AS v, x AS w, x, x AS y, x AS z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31 AND len(list_distinct([v.bit, w.bit, x.bit, y.bit, z.bit])) = 5),
s AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM o) AS t),
r AS (SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (WHERE mask & bit = 0 AND mask & earlier = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & earlier > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & bit > 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost
      FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
