"""Queries of the training-data operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, exact_dedup, language, license_scan, line_dedup, minhash, mixing, packing, quality, scratch, spelling, suffix_dedup, warc, winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch.fresh_path(spark, "warc")
    index = warc.write_archives(warc.with_revisits(table(spark, sf_dir, "pages")), folder)
    return warc.read_records(index, folder, with_payload=False).drop("url")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", F.size(line_dedup.text_lines(F.col("text"))).cast("long").alias("n_lines"))
    kept = line_dedup.remove_boilerplate(docs)
    return kept.select("doc_id", "n_lines", F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Which last digits of a source's name make which domain in the test tables.
DOMAIN_DIGITS = {"web": "0123", "books": "456", "code": "789"}


def source_domain() -> Column:
    digit = F.right(F.coalesce(F.col("source").cast("string"), F.lit("")), F.lit(1))
    out = F
    for name, digits in DOMAIN_DIGITS.items():
        out = out.when(digit.isin(list(digits)), name)
    return out.otherwise("")


SOURCE_DOMAIN_SQL = "CASE " + " ".join(f"WHEN right(coalesce(source, ''), 1) IN ({', '.join(map(repr, digits))}) THEN '{name}'" for name, digits in DOMAIN_DIGITS.items()) + " ELSE '' END"


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), mixing.Recipe(), domain=source_domain())
    return chosen.select("doc_id", "epoch", F.col("mix_domain").alias("domain"), F.col("mix_tokens").alias("n_tokens"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs, carry_text=False)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


def tree_path() -> Column:
    """Path of a document: a quarter of each source lies at each of four depths, and of every 16 documents four are licence files.

    Blocks are of 32,768 ids, so with 20 pairs of source and language some hundred
    documents lie in each and its part; a source's own directory grows with the table.
    """
    block = F.format_string("b%d", F.expr("doc_id div 32768"))
    depth = F.coalesce(F.col("doc_id") % 4, F.lit(3))
    folders = [F.col("source"), *[F.when(depth >= i + 1, part) for i, part in enumerate([F.col("lang"), block, F.lit("part")])]]
    name = F.when(F.expr("doc_id div 4") % 4 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return F.concat_ws("/", *folders, name)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand for the files of a tree source/lang/block/part; see ``tree_path``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    path = tree_path()
    found = license_scan.scan_tree(docs, "doc_id", path)
    return found.select(F.col("key").alias("doc_id"), "path", "line_license", "line_score", "file_license", "file_score", "license", "license_score", "license_from")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, carry=["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % quality.FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_components(table(spark, sf_dir, "documents"), words=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs), carry=["doc_id"])
    held_out = F.coalesce(language.fold(F.col("doc_id")) == language.HELD_OUT, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_winnowing": op2_winnowing,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality": op9_quality,
    "op10_minhash": op10_minhash,
    "op11_language_id": op11_language_id,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_filter_audit": op13_filter_audit,
}
ORACLE_SQL = {
    "op1_warc": OP1_SQL,
    "op4_line_dedup": line_dedup.oracle_sql(),
    "op5_mixing": mixing.oracle_sql(mixing.Recipe(), SOURCE_DOMAIN_SQL),
    "op6_exact_dedup": OP6_SQL,
    "op12_spelling_variants": spelling.oracle_sql(),
    "op13_filter_audit": audit.oracle_sql(),
}
