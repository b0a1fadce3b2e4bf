"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and reread as the next stage's documents.  All stages but the last
return the columns of ``documents``.

Defined cases: null and empty texts pass the stages by the rules of their
operators (scored by the bias, no lines, no duplicates, no tokens but the end
id); null labels are not learned from; columns of any other name are carried
along untouched; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentrove.llm import line_dedup, minhash, mixing, packing, quality, queries, scratch

#: Every document fits once; the budget leaves out what the target weights have no place for.
MIX = mixing.Recipe(percent=80, epochs=1)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, out_col="__score").filter(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; ``n_chars`` follows the text."""
    kept = line_dedup.remove_boilerplate(docs)
    length = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return kept.select(*[length.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id; of rows with that id and one text exactly one.

    Rows are told apart by id and text, so unlike texts that share an id are
    judged each on its own.  Rows with a null id, or without words, stay.
    """
    found = minhash.near_components(docs, words=5)
    key = ["id", "h1", "h2"]
    rows = scratch.materialise(found.filter(F.col("group").isNotNull()).groupBy("group", "component", *key).agg(F.count(F.lit(1)).alias("rows")), "pipeline-near")
    # Few rows of a group have its smallest id: one, unless ids repeat.
    first = rows.filter(F.col("id") == F.col("component")).withColumn("nth", F.row_number().over(Window.partitionBy("group").orderBy("h1", "h2")))
    gone = rows.filter(F.col("id") != F.col("component")).select(*key).union(first.filter("nth > 1").select(*key))
    repeated = scratch.materialise(first.filter("nth = 1 and rows > 1").select(*key), "pipeline-repeated")
    gone = scratch.materialise(gone.union(repeated), "pipeline-gone")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), *minhash.text_hashes(F.col("text")))
    kept = named.join(gone.hint("merge"), key, "left_anti").select("row")
    if not repeated.isEmpty():
        one = named.join(repeated, key).groupBy(*key).agg(F.first("row").alias("row"))
        kept = kept.union(one.select("row"))
    return kept.select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX, domain=queries.source_domain()).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", near_deduplication),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the sketches and the tokenizer have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage left in the shared folder goes as soon as its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = scratch.left(spark)
        docs = scratch.materialise(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
        scratch.sweep(spark, keep=[docs], earlier=before)
    return docs
