"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled text holds all of that
text's substrings.  Another text is parsed against it into phrases, each the
longest match that starts where the last one ended (Ziv and Merhav's cross
parsing); the fewer phrases, the better the language explains the text.  As a
longer learned text has longer matches, a phrase counts as log2 of that text's
length, which makes the sum an estimate of the cross entropy in bits.  The
language of fewest bits wins, and the score is its share of 2**-bits among all.

Learning is bounded: of each language some ``rows`` labelled documents, drawn by a
hash of the id, give at most ``row_bytes`` each, cut at ``language_bytes`` (all three
documented parameters).  A language's rows are counted first, so that about
``OVERSAMPLING`` times the wanted ones are read and sorted at any size.  These few kilobytes per language are all that passes the
driver; tasks build the automata from them in a fraction of a second, once per
worker, and complete them with the restart after a failed match, so that a byte
costs one table look-up per language.  Predicting is one scan without a shuffle
over whole texts.  A batch's texts are read side by side, in pieces of
``PIECE`` bytes at fixed places of each text, where a phrase ends too; memory so
follows the batch and not one text's length.

Texts are compared in lower case, every run of other characters than letters and
marks as one space.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is
every text when nothing was learned; null languages, null ids and held-out rows
are not learned from; equal bits: the first language in code-point order; repeated
rows are predicted alike, and equal learned texts count once; an empty table gives no rows.  Columns of the caller are carried in
one struct, so that no name clashes; result columns replace those of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels

FOLDS, HELD_OUT = 4, 2
ROWS = 128
ROW_BYTES = 512
LANGUAGE_BYTES = 32 << 10
OVERSAMPLING = 8
PIECE = 2048
UNKNOWN = "und"
#: Parts two learned texts, so that no match runs over the border.
BORDER = "\n"


def letters(text: Column) -> Column:
    """Lower case, with one space for each run of other characters than letters and marks."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))


def fold(ident: Column, folds: int = FOLDS) -> Column:
    return F.crc32(ident.cast("string")) % folds


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, rows: int = ROWS, row_bytes: int = ROW_BYTES, language_bytes: int = LANGUAGE_BYTES) -> dict[str, bytes]:
    """Per language the learned text, of at most ``language_bytes``."""
    known = docs.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter(F.col("lang").isNotNull() & (fold(F.col("id"), folds) != held_out)).withColumn("rank", F.xxhash64("id", "lang"))
    # Of a language's rows, some OVERSAMPLING times as many as are wanted, whatever the size of the table.
    # The counts are a row per language, as the model is, and are met where the texts are read.
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("many")).collect()
    if not counts:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, OVERSAMPLING * rows / r["many"]))]), F.col("lang"))
    drawn = known.filter(F.pmod("rank", F.lit(1 << 40)) < share * float(1 << 40))
    named = drawn.select("lang", F.encode(F.substring(letters(F.substring("text", 1, 2 * row_bytes)), 1, row_bytes), "utf-8").alias("learned"), "rank").filter(F.octet_length("learned") > 0)
    distinct = named.groupBy("lang", "learned").agg(F.min("rank").alias("rank"))
    few = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "learned"))).filter(F.col("nth") <= rows)
    found = few.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("nth", "learned"))).alias("parts")).collect()
    return {r["lang"]: BORDER.encode().join(bytes(p["learned"]) for p in r["parts"])[:language_bytes] for r in found}


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of ``text``; state 0 is the start."""
    ahead: list[dict[int, int]] = [{}]
    longest, link, last = [0], [-1], 0
    for symbol in text:
        new = len(ahead)
        ahead.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in ahead[at]:
            ahead[at][symbol] = new
            at = link[at]
        if at >= 0:
            goal = ahead[at][symbol]
            if longest[goal] != longest[at] + 1:  # only the shorter strings of the goal end here too
                part = len(ahead)
                ahead.append(dict(ahead[goal]))
                longest.append(longest[at] + 1)
                link.append(link[goal])
                while at >= 0 and ahead[at].get(symbol) == goal:
                    ahead[at][symbol] = part
                    at = link[at]
                link[goal] = part
                goal = part
            link[new] = goal
        last = new
    return ahead


class CrossParser:
    """The automata of all languages as one table: (state, symbol) -> next state and the phrases that end on the way."""

    def __init__(self, learned: dict[str, bytes]) -> None:
        self.names = sorted(learned)
        seen = np.unique(np.frombuffer(b"".join(learned.values()), np.uint8))
        seen = seen[seen != ord(BORDER)]
        self.symbols = np.zeros(256, np.int32)  # 0: a byte that no language has
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 1
        self.bits = np.log2([1.0 + len(learned[name]) for name in self.names])
        parts, self.starts, first = [], [], 0
        for name in self.names:
            ahead = suffix_automaton(learned[name])
            table = np.full((len(ahead), self.width), -1, np.int64)
            for state, moves in enumerate(ahead):
                for byte, goal in moves.items():
                    if byte != ord(BORDER):
                        table[state, self.symbols[byte]] = (first + goal) * self.width * 4
            # No way on: the phrase ends, and the symbol starts the next one or, if the language lacks it, is one.
            restart = np.where(table[0] >= 0, table[0], first * self.width * 4 + 1)
            table = np.where(table >= 0, table, restart[None, :] + 1)
            table[0] = restart
            parts.append(table.ravel())
            self.starts.append(first * self.width)
            first += len(ahead)
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def phrases(self, data: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> np.ndarray:
        """Number of phrases per language (rows) and text (columns)."""
        size = np.diff(offsets)
        many = -(-size // piece)
        owner = np.repeat(np.arange(len(size)), many)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        start = offsets[:-1][owner] + nth * piece
        length = np.minimum(piece, offsets[1:][owner] - start)
        order = np.argsort(-length, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        code = self.symbols[data]
        root = np.array(self.starts, np.int64)[:, None]
        state = np.repeat(root, len(start), axis=1)
        count = np.zeros((len(self.names), len(start)), np.int64)
        live = len(start) - np.searchsorted(length[::-1], np.arange(piece), "right")
        for j in range(piece):
            k = live[j]
            if not k:
                break
            step = self.table[state[:, :k] + code[start[:k] + j]]
            count[:, :k] += step & 3
            state[:, :k] = step >> 2
        count += state != root
        out = np.zeros((len(self.names), len(size)), np.int64)
        for row, own in zip(out, count, strict=True):
            row += np.bincount(owner, own, len(size)).astype(np.int64)
        return out

    def best(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per text: the index of the likeliest language and its score."""
        bits = self.phrases(data, offsets) * self.bits[:, None]
        least = bits.min(axis=0)
        return bits.argmin(axis=0), np.round(1 / np.exp2(np.clip(least - bits, -60, 0)).sum(axis=0), 6)


_parsers: dict[tuple, CrossParser] = {}


def parser(learned: dict[str, bytes]) -> CrossParser:
    """The automata of ``learned``, built once in each worker."""
    key = tuple(sorted(learned.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(learned)
    return _parsers[key]


def identify(docs: DataFrame, learned: dict[str, bytes], text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with lang_pred and score."""
    made = ("lang_pred", "score")
    rest = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = docs.select(F.struct(*rest).alias("row"), letters(F.col(text_col).cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = parser(learned)
        names = pa.array([*own.names, UNKNOWN])
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(1))
            for lo, hi in kernels.row_chunks(offsets):
                at = offsets[lo : hi + 1]
                if own.names:
                    lang, score = own.best(data[at[0] : at[-1]], at - at[0])
                else:
                    lang, score = np.zeros(hi - lo, np.int64), np.zeros(hi - lo)
                empty = np.diff(at) == 0
                lang, score = np.where(empty, len(own.names), lang), np.where(empty, 0.0, score)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), names.take(pa.array(lang)), pa.array(score)], names=["row", *made])

    schema = rows.select("row").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema).select("row.*", *made)
