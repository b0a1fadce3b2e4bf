"""Best-fit packing of token sequences by planning over the histogram of lengths.

Tokenising is one scan that gives a slim row per piece (no text, no ids).  A
histogram of at most ``capacity`` lengths goes to the driver, where best-fit
decreasing runs over counts: items of one length enter open sequences of the
tightest sufficient room, many at once, so the work depends on the number of
lengths and not on that of documents.  The plan is a table of rank intervals per
length.  Documents then take their slots by joining on (length, rank).

Ranks within a length are made without a window over the whole length: pieces
are dealt to shares of about ``SHARE_ROWS`` rows, counts per (share, length)
give each share its first rank, and the row number inside the share gives the
rest, so a length that a third of all pieces have is ranked by many tasks.

Token ids are those of the ``tokenizers`` file.  ``tiktoken`` gives the same ids from
the same vocabulary several times faster, but its pattern refuses texts with
very long runs of white space; these are encoded by ``tokenizers`` itself.

Defined cases: null or empty texts are the end id alone; equal rows are packed
each on its own; ties in a length are broken by (id, piece) only through the
share's order, which is fixed by the hash of the row; an empty table gives no
rows; a very long text is encoded whole by one task, in memory of some tens of
bytes per character, and cut into pieces; only id and text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

CAPACITY = 2048
END_ID = 0
SHARE_ROWS = 200_000
SPECIAL = "<|endoftext|>"
EXACT = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoder(vocabulary: str, exact: str = EXACT) -> Callable[[str], bytes]:
    """text -> little-endian 32-bit ids, equal to those of the tokenizer file ``exact`` without added special tokens."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})
    slow: list[Tokenizer] = []

    def encode(text: str) -> bytes:
        try:
            ids = bpe.encode(text, allowed_special="all")
        except ValueError:  # its pattern's search ran out of stack
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path(exact)))
            ids = slow[0].encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    return encode


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row per piece: (doc_id, piece, start, length, ids_crc32).  The first piece takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            rows: list[int] = []
            piece, start, length, crc = [], [], [], []
            for i in range(batch.num_rows):
                data = encode(batch.column(1)[i].as_py() or "") + end
                n, at, k = len(data) // 4, 0, 0
                size = n % capacity or capacity
                while at < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(data[4 * at : 4 * (at + size)]))
                    at, size, k = at + size, capacity, k + 1
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, first_sequence, offset): ranks of a length go, in order, to consecutive sequences.

    Open sequences with the same room are kept as runs of consecutive numbers.
    The number of rows is bounded by ``capacity`` and the runs it can open, not
    by the number of items.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs (first sequence, how many)
    plan, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = min((r for r, runs in rooms.items() if r >= length and runs), default=None)
            if room is None:
                each = capacity // length  # new sequences, filled with as many as fit
                full, some = divmod(left, each)
                for slot in range(each):
                    if full:
                        plan.append((length, rank, rank + full, sequences, slot * length))
                        rank += full
                if full and capacity - each * length:
                    rooms[capacity - each * length].append((sequences, full))
                sequences += full
                for slot in range(some):
                    plan.append((length, rank, rank + 1, sequences, slot * length))
                    rank += 1
                if some:
                    if capacity - some * length:
                        rooms[capacity - some * length].append((sequences, 1))
                    sequences += 1
                left = 0
            else:
                first, many = rooms[room].pop()
                took = min(left, many)
                plan.append((length, rank, rank + took, first, capacity - room))
                if took < many:
                    rooms[room].append((first + took, many - took))
                if room > length:
                    rooms[room - length].append((first, took))
                rank, left = rank + took, left - took
    return plan


def ranked(pieces: DataFrame, share_rows: int = SHARE_ROWS) -> DataFrame:
    """``pieces`` with a gapless ``rank`` (from 0) within each length; no task holds a whole length."""
    shares = max(1, -(-pieces.count() // share_rows)) * 8
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shares)).cast("int"))
    counts = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("nth", F.row_number().over(inside)).join(firsts, ["length", "share"]).select(*pieces.columns, (F.col("base") + F.col("nth") - 1).alias("rank"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Every piece with its sequence and its offset there; offsets of a sequence are gapless from 0."""
    spark = docs.sparkSession
    pieces = scratch.materialise(tokenised(docs, id_col, text_col, capacity, vocabulary), "packing-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), "length long, lo long, hi long, first long, offset long")
    rows = ranked(pieces)
    # The plan's size is bounded by the capacity alone, so it may be broadcast at any input size.
    slots = rows.join(F.broadcast(plan), (rows["length"] == plan["length"]) & (rows["rank"] >= plan["lo"]) & (rows["rank"] < plan["hi"]))
    return slots.select(rows["doc_id"], "piece", "start", rows["length"], "ids_crc32", (plan["first"] + rows["rank"] - plan["lo"]).alias("sequence_id"), "offset")
