"""Exact de-duplication by progressive refinement (native DataFrame operations).

One scan makes a slim row per document: id, length of the normalised text, hash
of its prefix, and SHA-256 of the whole.  Rows are then grouped by length, by
(length, prefix hash) where a length is shared, and by the full digest where
that pair is shared.  Only these keys travel, never a text, and counts are
combined in the map tasks, so a text that a third of all rows share is one row
per task in the shuffle.  Labels go back to the slim rows by a join on the
digest, salted so that a large group is spread over ``SALTS`` tasks.

The digest of every row is part of the result, so the refinement saves grouping
and not hashing there.  ``duplicate_groups`` returns the groups alone and hashes
full content only in rows that the first two steps leave.

Defined cases: a null text counts as empty; empty texts are equal to each
other; a null id is never the smallest of a group (a group of null ids only
keeps every row); repeated rows with one id all stay if that id is the smallest;
an empty table gives no rows; a very long text is normalised and hashed in one
row's memory.  Columns of the input are kept, whatever their names; result columns
replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Tasks over which the rows of one group are spread when they take their labels.
SALTS = 32


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def step_keys(text: str, prefix_chars: int) -> list[Column]:
    """Length and prefix hash of a normalised text."""
    return [F.length(text).alias("__len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("__prefix")]


def shared_keys(keyed: DataFrame) -> DataFrame:
    """(__len, __prefix) of at least two rows, looked for only within lengths of at least two rows."""
    profile = keyed.groupBy("__len", "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    lengths = profile.groupBy("__len").agg(F.sum("__n").alias("__rows")).filter("__rows > 1").select("__len")
    return profile.join(lengths, "__len", "left_semi").filter("__n > 1").select("__len", "__prefix")


def equal_rows(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of at least two rows, from (__id, digest)."""
    return digests.groupBy("digest").agg(F.min("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256) -> DataFrame:
    """Groups of at least two equal normalised texts: (digest, keep_id, group_size).

    Full content is read and hashed in surviving rows only.
    """
    keyed = docs.select(F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text")).select("__id", "__text", *step_keys("__text", prefix_chars))
    wanted = scratch.materialise(shared_keys(keyed), "exact-keys")
    return equal_rows(keyed.join(wanted, ["__len", "__prefix"], "left_semi").select("__id", F.sha2("__text", 256).alias("digest")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, carry_text: bool = True) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    ``carry_text=False`` leaves the text out of the result; the tables are then
    read once and no text is shuffled.
    """
    made = ("keep_id", "group_size", "kept", "text_sha256")
    rest = [c for c in docs.columns if c not in made and (carry_text or c != text_col)]
    # The caller's columns travel in one struct, whatever their names.
    held = docs.select(F.struct(*rest).alias("row"), F.col(id_col).alias("__id"), normalised(F.col(text_col)).alias("__text"))
    slim = scratch.materialise(held.select("row", "__id", *step_keys("__text", prefix_chars), F.sha2("__text", 256).alias("digest"), (F.rand(11) * SALTS).cast("int").alias("__salt")), "exact-rows")
    keyed = slim.select("__id", "digest", "__len", "__prefix")
    groups = equal_rows(keyed.join(shared_keys(keyed), ["__len", "__prefix"], "left_semi"))
    spread = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    labelled = slim.join(spread, ["digest", "__salt"], "left")
    keep = F.coalesce("keep_id", "__id")
    return labelled.select("row.*", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("__id")).alias("kept"), F.col("digest").alias("text_sha256"))
