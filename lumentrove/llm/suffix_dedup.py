"""Removal of long repeated substrings by a run-length suffix index.

A byte goes if a string of ``length`` bytes (400 by default) that covers it
also starts anywhere else in the corpus.  The result is exact.

1. *Anchors.*  Every window of ``length`` bytes picks its least hashed k-gram.
   Equal windows pick the same one at the same place, so windows need comparing
   only if their anchors agree.  A row (run) holds the consecutive windows of a
   document that share an anchor, and a digest of the bytes they cover, its
   context.
2. *Counting.*  Runs are counted by (anchor, context) and by anchor, combined in
   the map tasks.  Anchors met once are done.
3. *Index.*  One copy of each other distinct context is cut from the texts, with
   the number of its copies, and dealt by anchor.  A task packs whole anchor groups
   into blocks of bounded size and builds, per block, the suffix order, the
   Burrows-Wheeler transform as runs, and samples (suffix, common prefix with its
   neighbour) at the runs' two ends.  Copies of a context only lengthen runs, so
   they enter as its count.  Between samples the length of the longest match
   elsewhere falls by one per byte, so matching statistics stream from the samples
   alone, whose number is that of the runs: few in a repetitive corpus.  What is
   marked in a context is marked in all its copies, by a join on its digest.
4. *Wide anchors*, whose group would outgrow the memory of a block (a passage
   that very many documents share in different surroundings), take another exact
   way: the 128-bit hashes of their windows are counted, combined in the map
   tasks, and hashes met twice are joined back to their places.  Rows are slim
   and sorted with spilling, so one window in any number of contexts fits a task.
5. Marked spans are joined to the texts and cut out.

A longer k-gram makes unlike windows agree on an anchor less often and thus
fewer contexts to index, a shorter one fewer runs; both are exact.

Defined cases: null text is empty; texts shorter than ``length`` keep all;
repeated rows repeat each other, so all their windows go; null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch
from .kernels import U64

LENGTH = 400
GRAM = 128
PLACE_BITS = 31
BLOCK_BYTES = 2 << 20
WIDE_CONTEXTS = 4096
RUNS = "k1 long, k2 long, anchor long, s long, n int, c1 long, c2 long"


# --- anchors ---------------------------------------------------------------


def runs_of(text: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, start, windows, anchor hash); starts are places in ``text``.

    ``bounds`` are the documents' offsets in ``text``; windows never cross them.
    """
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none, none, none, none.view(U64)
    hashes = kernels.gram_hashes(text, gram)
    low = U64((1 << PLACE_BITS) - 1)
    least = kernels.window_minima((hashes & ~low) | np.arange(len(hashes), dtype=U64), length - gram + 1)
    place = (least & low).astype(np.int64)
    valid = np.zeros(len(place) + 1, np.int32)
    sizes = np.diff(bounds)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return none, none, none, none.view(U64)
    valid[bounds[:-1][long]] += 1
    np.subtract.at(valid, bounds[:-1][long] + sizes[long] - length + 1, 1)
    ok = np.cumsum(valid[:-1]) > 0
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (place[1:] != place[:-1])
    first[bounds[:-1][long]] = True
    starts = np.flatnonzero(first)
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    ends = np.flatnonzero(last)
    doc = np.searchsorted(bounds, starts, "right") - 1
    return doc, starts, ends - starts + 1, hashes[place[starts]]


def slices(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first row, byte bounds of rows, bytes skipped of the first row): chunks of rows, and overlapping pieces of long ones."""
    for lo, hi in kernels.row_chunks(offsets):
        own = offsets[lo : hi + 1]
        if hi - lo == 1 and own[1] - own[0] > 2 * kernels.CHUNK_BYTES:
            for skip in range(0, int(own[1] - own[0]) - length + 1, kernels.CHUNK_BYTES):
                yield lo, np.array([own[0] + skip, min(own[1], own[0] + skip + kernels.CHUNK_BYTES + length - 1)]), skip
        else:
            yield lo, own, 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, text): the two keys name a row by its id and its text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text).alias("k2"), F.col(id_col).alias("id"), text.alias("text"))


def anchor_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(2))
            k1, k2 = (batch.column(c).to_numpy() for c in (0, 1))
            for row, own, skip in slices(offsets, length):
                text = data[own[0] : own[-1]]
                doc, start, many, anchor = runs_of(text, own - own[0], length, gram)
                if not len(doc):
                    continue
                view = memoryview(np.ascontiguousarray(text))
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), (start + many + length - 1).tolist(), strict=True)]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"k1": k1[row + doc], "k2": k2[row + doc], "anchor": anchor.view(np.int64), "s": start - (own - own[0])[doc] + skip, "n": many.astype(np.int32), "c1": digests[:, 0].copy(), "c2": digests[:, 1].copy()})

    return rows.select("k1", "k2", "text").mapInArrow(run, RUNS)


# --- the index of one block ------------------------------------------------


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes of strings that end in symbol 0 each; ends compare by place.

    Prefix doubling; only suffixes that are not yet told apart are sorted again.
    """
    n, step = len(symbols), 7
    ended = symbols == 0
    key = np.zeros(n, np.int64)
    alive = np.ones(n, bool)
    closed = np.zeros(n, bool)
    wide = np.concatenate([symbols, np.zeros(step, symbols.dtype)])
    stop = np.concatenate([ended, np.ones(step, bool)])
    for j in range(step):
        key = (key << 9) | np.where(alive, wide[j : n + j], 0)
        closed |= alive & stop[j : n + j]
        alive &= ~stop[j : n + j]
    order = np.argsort(key)
    slots = np.flatnonzero(closed[order])
    own = np.flatnonzero(closed)
    order[slots] = own[np.lexsort((own, key[own]))]
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | closed[order][1:]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.append(new[1:], True)
    at = np.flatnonzero(~alone)  # slots of the order that are still open
    while len(at):
        own = order[at]
        key = rank[own] * n + rank[own + step]
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[own] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        alone = new & np.append(new[1:], True)
        at = at[~alone]
        step *= 2
    return order


def run_samples(symbols: np.ndarray, order: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes at run starts, those at run ends before them, and their common prefix lengths.

    The transform's runs are taken from the symbol before each suffix; the first
    suffix of a string has none and is a run of its own.  ``ends``: for each
    place the end of its string.
    """
    before = np.where(order > 0, symbols[order - 1], 0).astype(np.int32)
    border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    here, there = order[border], order[border - 1]
    most = np.minimum(ends[here] - here, ends[there] - there)
    raw = np.concatenate([np.maximum(symbols - 1, 0).astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.zeros(len(symbols), U64)
    for j in range(8):
        words |= raw[j : len(symbols) + j].astype(U64) << U64(8 * j)
    common = np.zeros(len(here), np.int64)
    active = np.flatnonzero(most > 0)
    while len(active):
        at = common[active]
        x, y = words[here[active] + at], words[there[active] + at]
        differ = x ^ y
        same = differ == 0
        lowest = differ & (~differ + U64(1))
        equal = np.where(same, 8, np.log2(np.where(same, U64(1), lowest).astype(np.float64)).astype(np.int64) // 8)
        common[active] = np.minimum(at + equal, most[active])
        active = active[same & (common[active] < most[active])]
    return here, there, common


def match_lengths(contexts: list[bytes], copies: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of the joined contexts (an end mark after each) the longest match that starts elsewhere; and the contexts' starts.

    ``copies`` says how often each context occurs.  The suffixes of copies are
    neighbours in the order and lengthen the runs in which one copy lies; what two
    neighbours have in common there is the whole rest of the context.
    """
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(starts[-1])
    symbols = np.zeros(n, np.int16)
    inner = np.ones(n, bool)
    inner[starts[1:] - 1] = False
    symbols[inner] = np.frombuffer(b"".join(contexts), np.uint8).astype(np.int16) + 1
    ends = np.repeat(starts[1:] - 1, sizes + 1)
    order = suffix_order(symbols)
    here, there, common = run_samples(symbols, order, ends)
    best = np.zeros(n, np.int64)
    places = np.arange(n)
    for at in (here, there):
        reach = np.full(n, -1, np.int64)
        reach[at] = at + common
        last = np.maximum.accumulate(np.where(reach >= 0, places, -1))
        value = np.where(last >= 0, reach[np.maximum(last, 0)] - places, 0)
        best = np.maximum(best, value)
    if copies is not None:
        repeated = np.repeat(np.asarray(copies) > 1, sizes + 1)
        best[repeated] = (ends - places)[repeated]
    return best, starts


def spans_at_least(values: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges [first, last] of consecutive values of at least ``least``."""
    ok = np.concatenate([[False], values >= least, [False]])
    turn = np.flatnonzero(ok[1:] != ok[:-1])
    return list(zip(turn[::2].tolist(), (turn[1::2] - 1).tolist(), strict=True))


CONTEXT = ("anchor", "c1", "c2", "k1", "k2", "s", "m")
MARKS = ", ".join(f"{c} long" for c in (*CONTEXT, "a", "b"))


def _mark_batch(found: list[tuple[int, ...]]) -> pa.RecordBatch:
    names = [*CONTEXT, "a", "b"]
    cols = zip(*found, strict=True) if found else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def index_marks(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans (a, b) within contexts whose anchor groups fit in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0

        def marks(rows: list[tuple]) -> pa.RecordBatch:
            best, starts = match_lengths([r[-1] for r in rows], [r[6] for r in rows])
            return _mark_batch([(*r[:7], x, y + length) for r, at in zip(rows, starts.tolist(), strict=False) for x, y in spans_at_least(best[at : at + r[7]], length)])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*CONTEXT, "n", "context")), strict=True):
                if size >= BLOCK_BYTES and row[0] != block[-1][0]:
                    if block:
                        yield marks(block)
                        block, size = [], 0
                block.append(row)
                size += len(row[-1])
        if block:
            yield marks(block)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, MARKS)


# --- wide anchors ----------------------------------------------------------


SWAP = np.roll(np.arange(256, dtype=np.uint8), 101) ^ np.uint8(0x5B)
WINDOWS = "h1 long, h2 long, w int, " + ", ".join(f"{c} long" for c in CONTEXT)


def wide_marks(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans (a, b) within contexts of wide anchors, by counting the hashes of their windows."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(len(CONTEXT) + 1))
            many = batch.column(len(CONTEXT)).to_numpy()
            for lo, hi in kernels.row_chunks(offsets, kernels.CHUNK_BYTES // 8):
                own = offsets[lo : hi + 1] - offsets[lo]
                text = data[offsets[lo] : offsets[hi]]
                count = many[lo:hi]
                w = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                at = np.repeat(own[:-1], count) + w
                hashes = [kernels.spans_hash(kernels.prefix_sums(x), at, at + length).view(np.int64) for x in (text, SWAP[text])]
                row = pa.array(np.repeat(np.arange(lo, hi), count))
                yield pa.RecordBatch.from_arrays([*map(pa.array, hashes), pa.array(w.astype(np.int32)), *[batch.column(c).take(row) for c in range(len(CONTEXT))]], names=["h1", "h2", "w", *CONTEXT])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for *context, places in zip(*(batch.column(c).to_pylist() for c in (*CONTEXT, "places")), strict=True):
                w = np.sort(np.array(places))
                cut = np.flatnonzero(np.diff(w) > 1)
                found += [(*context, x, y + length) for x, y in zip(w[np.append(0, cut + 1)].tolist(), w[np.append(cut, len(w) - 1)].tolist(), strict=True)]
            yield _mark_batch(found)

    made = scratch.materialise(contexts.select(*CONTEXT, "n", "context").mapInArrow(windows, WINDOWS), "suffix-windows")
    twice = made.groupBy("h1", "h2").agg(F.sum("m").alias("copies")).filter("copies > 1").select("h1", "h2")
    hits = made.join(twice, ["h1", "h2"], "left_semi")
    return hits.groupBy(*CONTEXT).agg(F.collect_list("w").alias("places")).mapInArrow(spans, MARKS)  # bounded by a context's length


# --- the operator ----------------------------------------------------------


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, wide_contexts: int = WIDE_CONTEXTS) -> DataFrame:
    """(k1, k2, a, b): byte spans that repeat, overlapping ones not yet merged, for ``keyed`` rows."""
    runs = scratch.materialise(anchor_runs(rows, length, gram), "suffix-runs")
    # The longest run of an equal context is the same for all its copies, as are its windows.
    distinct = runs.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("m"), F.first("k1").alias("k1"), F.first("k2").alias("k2"), F.first("s").alias("s"), F.first("n").alias("n"))
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("nd"), F.max("m").alias("most")).filter("nd > 1 or most > 1")
    # Written, so that no second attempt of a task picks another copy than the first did.
    shared = scratch.materialise(distinct.join(per_anchor, "anchor").select(*distinct.columns, "nd"), "suffix-shared")
    wanted = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "c1", "c2", "s", "n", "m", "nd")).alias("wanted"))  # bounded by the text's length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = dict.fromkeys((*CONTEXT, "nd"), pa.int64()) | {"n": pa.int32(), "context": pa.binary()}
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(3))
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                asked = batch.column(2)[i].as_py()
                k1, k2 = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                made = {c: [x[c] for x in asked] for c in ("anchor", "c1", "c2", "s", "n", "m", "nd")}
                made |= {"k1": [k1] * len(asked), "k2": [k2] * len(asked), "context": [text[x["s"] : x["s"] + x["n"] + length - 1] for x in asked]}
                yield pa.RecordBatch.from_arrays([pa.array(made[c], kind) for c, kind in kinds.items()], names=list(kinds))

    once = rows.select("k1", "k2", "text")
    contexts = scratch.materialise(wanted.join(once, ["k1", "k2"]).select("k1", "k2", "wanted", "text").mapInArrow(cut, ", ".join(f"{c} long" for c in (*CONTEXT, "nd")) + ", n int, context binary").dropDuplicates(["anchor", "k1", "k2", "s"]), "suffix-contexts")
    marked = index_marks(contexts.filter(F.col("nd") <= wide_contexts), length)
    wide = contexts.filter(F.col("nd") > wide_contexts)
    if not wide.isEmpty():
        marked = marked.union(wide_marks(wide, length))
    marks = scratch.materialise(marked, "suffix-marks")
    alone = marks.filter("m = 1").select("k1", "k2", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    copied = runs.join(marks.filter("m > 1").select("anchor", "c1", "c2", "a", "b"), ["anchor", "c1", "c2"]).select("k1", "k2", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    return alone.union(copied)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, wide_contexts: int = WIDE_CONTEXTS) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): what stays of each text as bytes, and the merged spans that went."""
    rows = keyed(docs, id_col, text_col)
    spans = scratch.materialise(repeated_spans(rows, length, gram, wide_contexts), "suffix-spans")
    per_doc = spans.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(1))
            size, gone, merged, kept = [], [], [], []
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                own: list[list[int]] = []
                for x in batch.column(2)[i].as_py() or []:
                    if own and x["a"] <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], x["b"])
                    else:
                        own.append([x["a"], x["b"]])
                edges = [0, *(e for x in own for e in x), len(text)]
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                merged.append([{"a": a, "b": b} for a, b in own])
                size.append(len(text))
                gone.append(len(text) - len(kept[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(merged, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "spans", "kept"])

    joined = rows.join(per_doc, ["k1", "k2"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, spans array<struct<a: long, b: long>>, kept binary")


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The spans that go, by a dictionary of all windows; for small inputs."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = 1
        out.append([(a, b + 1) for a, b in spans_at_least(mask, 1)])
    return out

