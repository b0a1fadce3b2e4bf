"""Mixing sources to target weights by hierarchical budgeting (native DataFrame operations).

Leaves are (domain, language, source).  A token budget flows down the tree: at
each node the children share it by weight, no child gets more than it can give
(its tokens times ``epochs``), and what a short child leaves goes to its
siblings by weight.  As no node ever receives more than its own subtree can
give, a shortage is made up among siblings before it reaches any ancestor's
siblings.

The water level of a node follows from running sums over its children in the
order of capacity per weight, in whole numbers.  Children of one ratio are all
short or all open, so they are added up first, and the running sums go in two
steps, over bins of ratios and inside a bin: no task orders all siblings.

A leaf's documents are ordered anew in every epoch by a seeded hash, and the leaf
contributes the prefix of that stream that its budget pays for, up to and with
the document in which the budget ends; so a leaf exceeds its budget by less than
one document and never starves behind a long one.  The end of the prefix is
found from token sums per (leaf, hash bucket) and a running sum inside the one
bucket where the budget ends, so no task orders a whole leaf.  What reaches the
documents is one row per leaf: whole epochs and the last hash.

Defined cases: null text has no tokens; null domain, language or source is the
empty name; weights of 0 or less, or of unknown names where ``other`` is 0, take
nothing; a leaf without budget gives nothing; documents without tokens cost
nothing and follow their hash; rows that repeat an id are chosen together; an
empty table gives no rows; a very long text is one row, of which only words are
counted; columns of the caller keep their names, the three result columns excepted.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3
#: Bins of a running sum over siblings for each doubling of capacity per weight.
BINS_PER_DOUBLING = 16
LEVELS = ("domain", "lang", "source")

@dataclass(frozen=True)
class Recipe:
    """Weights by name at each level (``other`` for names not listed), and the budget as a share of all tokens."""

    domains: Mapping[str, int] = field(default_factory=lambda: {"web": 5, "books": 3, "code": 2})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 6, "de": 2, "fr": 2, "es": 1})
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 1
    percent: int = 60
    epochs: int = 2
    seed: int = 17

    def weight(self, level: str, column: Column) -> Column:
        out = None
        for name, value in {"domain": self.domains, "lang": self.langs, "source": self.sources}[level].items():
            out = F.when(column == name, value) if out is None else out.when(column == name, value)
        return (F.lit(self.other) if out is None else out.otherwise(self.other)).cast("long")


def order_key(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (parent columns, name, weight, cap, parent_budget) with each one's ``budget``."""
    up = [*parent, "__one"]  # the children of the root have no parent column
    live = nodes.filter("weight > 0").withColumn("__one", F.lit(1)).withColumn("__ratio", F.col("cap") / F.col("weight")).withColumn("__bin", F.floor(F.log2(F.col("__ratio") + 1) * BINS_PER_DOUBLING))
    ratios = scratch.materialise(live.groupBy(*up, "__bin", "__ratio").agg(F.sum("cap").alias("caps"), F.sum("weight").alias("weights"), F.max("parent_budget").alias("total")), "mixing-ratios")
    bins = ratios.groupBy(*up, "__bin").agg(F.sum("caps").alias("bin_caps"), F.sum("weights").alias("bin_weights"))
    over = Window.partitionBy(*up).orderBy("__bin")
    before, onward = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    bins = bins.select(*up, "__bin", F.coalesce(F.sum("bin_caps").over(before), F.lit(0)).alias("caps_below"), F.coalesce(F.sum("bin_weights").over(onward), F.lit(0)).alias("weights_above"))
    inside = Window.partitionBy(*up, "__bin").orderBy("__ratio")
    caps_before = F.col("caps_below") + F.coalesce(F.sum("caps").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights_from = F.col("weights_above") + F.sum("weights").over(inside.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    steps = ratios.join(bins, [*up, "__bin"]).withColumn("caps_before", caps_before).withColumn("weights_from", weights_from)
    # In whole numbers: caps / weights is the ratio of every child of this row.
    steps = steps.filter(F.col("caps").cast("decimal(38,0)") * F.col("weights_from") > F.col("weights").cast("decimal(38,0)") * (F.col("total") - F.col("caps_before")))
    level = steps.groupBy(*up).agg(F.min("__ratio").alias("__level"), F.min("caps_before").alias("__caps"), F.max("weights_from").alias("__over")).drop("__one")
    if parent:
        told = live.join(level, parent, "left")
    else:  # the root is one row
        row = level.first()
        told = live.withColumns({c: F.lit(row[c] if row else None).cast(level.schema[c].dataType) for c in ("__level", "__caps", "__over")})
    open_ = F.col("__ratio") >= F.col("__level")
    return told.withColumn("budget", F.when(open_, F.expr("(weight * (parent_budget - __caps)) div __over")).otherwise(F.col("cap"))).drop("__one", "__ratio", "__bin", "__level", "__caps", "__over")


def leaf_budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens)."""
    down = None
    for depth, level in enumerate(LEVELS):
        at = list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*at).agg((F.sum("tokens") * recipe.epochs).alias("cap")).withColumn("weight", recipe.weight(level, F.col(level)))
        if down is None:
            tokens = leaves.agg(F.sum("tokens")).first()[0] or 0
            nodes = nodes.withColumn("parent_budget", F.lit(tokens * recipe.percent // 100).cast("long"))
        else:
            nodes = nodes.join(down, at[:-1])
        down = shared(nodes, at[:-1]).select(*at, F.col("budget").alias("parent_budget"))
    return leaves.join(down.withColumnRenamed("parent_budget", "budget"), list(LEVELS))


def cut_points(slim: DataFrame, recipe: Recipe) -> DataFrame:
    """One row per leaf: whole epochs, and the last bucket and hash of the epoch that follows them."""
    leaf = list(LEVELS)
    leaves = scratch.materialise(slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")), "mixing-leaves")
    paid = leaf_budgets(leaves, recipe).withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    paid = scratch.materialise(paid.select(*leaf, "whole", "rest"), "mixing-budgets")
    keyed = slim.join(paid, leaf).withColumn("key", order_key(recipe.seed, F.col("whole"), F.col("id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*leaf, "rest", "bucket").agg(F.sum("tokens").alias("n"))
    running = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("upto", F.sum("n").over(running)).filter("upto >= rest").groupBy(*leaf).agg(F.min("bucket").alias("last_bucket"), F.min(F.col("upto")).alias("upto"), F.min_by("n", "bucket").alias("n")).withColumn("base", F.col("upto") - F.col("n")).select(*leaf, "last_bucket", "base")
    inside = keyed.join(ends, leaf).filter("bucket = last_bucket")
    order = Window.partitionBy(*leaf).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keys = inside.withColumn("upto", F.col("base") + F.sum("tokens").over(order)).filter("upto - tokens < rest").groupBy(*leaf).agg(F.max("key").alias("last_key"))
    return paid.join(ends.drop("base"), leaf, "left").join(keys, leaf, "left").select(*leaf, "whole", "last_bucket", "last_key")


def mix(docs: DataFrame, recipe: Recipe, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs`` with ``epoch``, ``mix_domain`` and ``mix_tokens``; a row appears once for each epoch that takes it.

    ``domain`` gives each row's domain; without it all rows are of one domain.
    """
    made = ("epoch", "mix_domain", "mix_tokens")
    columns = [c for c in docs.columns if c not in made]
    words = lambda text: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    top = F.lit("") if domain is None else F.coalesce(domain.cast("string"), F.lit(""))
    parts = [top.alias("domain"), name(lang_col).alias("lang"), name(source_col).alias("source")]
    ident = F.col(id_col).cast("string").alias("id")
    slim = scratch.materialise(docs.select(ident, *parts, words(F.col(text_col)).alias("tokens")), "mixing-rows")
    cuts = scratch.materialise(cut_points(slim, recipe), "mixing-cuts")
    # The caller's columns travel in one struct, whatever their names.
    rows = docs.select(F.struct(*columns).alias("row"), ident, *parts).join(cuts, list(LEVELS)).withColumn("key", order_key(recipe.seed, F.col("whole"), F.col("id")))
    bucket = F.substring("key", 1, BUCKET_DIGITS)
    chosen = F.col("last_bucket").isNull() | (bucket < F.col("last_bucket")) | ((bucket == F.col("last_bucket")) & (F.col("key") <= F.coalesce("last_key", F.lit(""))))
    # A stream that its own end never reaches has no partial epoch beyond the last allowed one.
    times = F.col("whole") + F.when(chosen & (F.col("whole") < recipe.epochs), 1).otherwise(0)
    taken = rows.withColumn("times", times.cast("int")).filter("times > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("epoch"), F.col("domain").alias("mix_domain"), words(F.col("row").getField(text_col)).alias("mix_tokens"))


def oracle_sql(recipe: Recipe, domain: str = "''") -> str:
    """DuckDB SQL for (doc_id, epoch, domain, n_tokens); ``domain`` is an expression over ``documents``."""

    def weights(level: str, names: Mapping[str, int]) -> str:
        cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in names.items())
        return f"CASE {cases} ELSE {recipe.other} END" if cases else str(recipe.other)

    def level(depth: int, names: Mapping[str, int]) -> str:
        at, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {up}" if up else ""
        budget = f"(SELECT (sum(tokens)::BIGINT * {recipe.percent}) // 100 FROM leaves)" if depth == 0 else f"b{depth - 1}.budget"
        source = f"n{depth}" if depth == 0 else f"n{depth} JOIN b{depth - 1} USING ({up})"
        order = f"ORDER BY cap / weight, {LEVELS[depth]}"
        return f"""
n{depth} AS (SELECT {at}, sum(tokens)::BIGINT * {recipe.epochs} AS cap, ({weights(LEVELS[depth], names)})::BIGINT AS weight FROM leaves GROUP BY {at}),
r{depth} AS (SELECT {at}, cap, weight, {budget} AS up_budget, coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps_before, (sum(weight) OVER ({part} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weights_from FROM {source}),
o{depth} AS (SELECT *, cap * weights_from > weight * (up_budget - caps_before) AS open FROM r{depth}),
b{depth} AS (SELECT {at}, CASE WHEN open THEN (weight * (up_budget - min(CASE WHEN open THEN caps_before END) OVER ({part}))) // (max(CASE WHEN open THEN weights_from END) OVER ({part})) ELSE cap END AS budget FROM o{depth})"""

    return f"""
WITH d AS (SELECT doc_id, {domain} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),{level(0, recipe.domains)},{level(1, recipe.langs)},{level(2, recipe.sources)},
p AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM leaves JOIN b2 USING (domain, lang, source)),
k AS (SELECT d.*, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{recipe.seed}:' || whole || ':' || doc_id), doc_id::VARCHAR ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN p USING (domain, lang, source)),
t AS (SELECT *, whole + CASE WHEN upto - tokens < rest AND whole < {recipe.epochs} THEN 1 ELSE 0 END AS times FROM k)
SELECT doc_id, unnest(range(times))::INTEGER AS epoch, domain, tokens AS n_tokens FROM t
"""
