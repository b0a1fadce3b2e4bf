"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken, 2003).

All k-grams of code points are hashed by a rolling polynomial; every window of
w consecutive hashes keeps its minimum, the rightmost of equal ones, with its
place.  Any shared stretch of w + k - 1 code points makes two fingerprints share
a value, and the kept places say where.  Minima compare the upper 33 bits of a
hash.

Defined cases: null text is empty and has an empty fingerprint; a text shorter
than k is a single gram, one with fewer than w grams a single window; two empty
fingerprints are alike (1.0); equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, scratch, sizing
from .kernels import U64

GRAM = 24
WINDOW = 16
PLACE_BITS = 31
GROUP_CHARS = 1 << 20


def winnow(texts: list[str], k: int = GRAM, w: int = WINDOW, most: int = 2 * GROUP_CHARS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of each text, in the order of places; texts over ``most`` code points are taken in pieces."""
    if any(len(t) > most for t in texts):
        return [winnow_long(t, k, w, most) if len(t) > most else winnow([t], k, w, most)[0] for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    grams = kernels.gram_hashes(points, k)
    low = U64((1 << PLACE_BITS) - 1)
    n_grams = sizes - k + 1
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U64), np.zeros(0, np.int64))] * len(texts)
    if len(grams) >= w:
        # The place counts down in the low bits, so that the rightmost of equal hashes is least.
        least = kernels.window_minima((grams & ~low) | (low - np.arange(len(grams), dtype=U64)), w)
        place = (low - (least & low)).astype(np.int64)
    for i in range(len(texts)):
        if n_grams[i] >= w:
            own = place[bounds[i] : bounds[i] + n_grams[i] - w + 1]
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            found[i] = (grams[own], own - bounds[i])
        elif n_grams[i] > 0:
            own = grams[bounds[i] : bounds[i] + n_grams[i]]
            at = n_grams[i] - 1 - int(np.argmin((own >> U64(PLACE_BITS))[::-1]))
            found[i] = (own[at : at + 1], np.array([at]))
        elif sizes[i]:
            found[i] = (kernels.gram_hashes(points[bounds[i] : bounds[i + 1]], int(sizes[i])), np.array([0]))
    return found


def winnow_long(text: str, k: int, w: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``winnow`` of one text in pieces whose windows follow one another without a gap."""
    step = max(1, most - k - w + 2)  # windows of a piece
    hashes, places = [], []
    for at in range(0, len(text) - k - w + 2, step):
        h, p = winnow([text[at : at + step + k + w - 2]], k, w, most)[0]
        p = p + at
        again = int(bool(places) and places[-1][-1] == p[0])  # the window before has the same minimum
        hashes.append(h[again:])
        places.append(p[again:])
        if not len(places[-1]):
            hashes.pop()
            places.pop()
    return np.concatenate(hashes), np.concatenate(places)


def digest(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    hashes, places = fingerprint
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + places.astype("<i8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    near = np.searchsorted(b, a)
    near[near == len(b)] = 0
    both = int((b[near] == a).sum())
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """(id, hashes array<long>, places array<long>) per row: a scan without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = kernels.raw_text(batch.column(1))
            for lo, hi in kernels.row_chunks(offsets, GROUP_CHARS):
                made = winnow([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()], k, w)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([h.view(np.int64) for h, _ in made], pa.list_(pa.int64())), pa.array([p for _, p in made], pa.list_(pa.int64()))], names=["id", "hashes", "places"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, hashes array<long>, places array<long>")


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as much of the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


REPORT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _report(texts: list[str], following: list[str], in_order: bool) -> dict[str, list]:
    """The report columns of texts, each with the text that follows it; ``in_order``: following is texts, moved by one."""
    made = winnow([*texts, *following[-1:]] if in_order else texts)
    sets = [np.unique(h) for h, _ in made]
    nexts = sets[1:] if in_order else [np.unique(h) for h, _ in winnow(following)]
    new = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    changed = winnow(new)
    return {
        "n_chars": [len(t) for t in texts],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": [digest(x) for x in made[: len(texts)]],
        "edited_fingerprint": [digest(x) for x in changed],
        "near_edited": [likeness(s, np.unique(h)) for s, (h, _) in zip(sets, changed, strict=False)],
        "near_next": [likeness(s, x) for s, x in zip(sets, nexts, strict=False)],
    }


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = sizing.MOST_BYTES) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Next is the following row by descending id (nulls last, equal ids by text);
    the first row follows the last.  Rows are range-partitioned by id once, into as
    many tasks as their bytes call for, and stream through in order.  Only the last row of a partition lacks its
    successor; those rows, one per partition, are completed in a second step
    from the partitions' first rows.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    many = sizing.tasks(spark, slim.agg(F.sum(F.octet_length("text"))).first()[0], task_bytes)
    ordered = slim.repartitionByRange(many, F.col("id").desc_nulls_last()).sortWithinPartitions(F.col("id").desc_nulls_last(), "text")
    columns = [c.split()[0] for c in REPORT.split(", ")]
    kinds = {"n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64()}
    schema = pa.schema([("id", pa.int64()), *((c, kinds.get(c, pa.string())) for c in columns), ("part", pa.int32()), ("head", pa.bool_()), ("tail", pa.bool_()), ("text", pa.string())])

    def batch_of(ids: list, texts: list[str], following: list[str], part: int, first: bool) -> pa.RecordBatch:
        cols = _report(texts, following, True)
        n = len(ids)
        cols |= {"id": ids, "part": [part] * n, "head": [first, *[False] * (n - 1)], "tail": [False] * n, "text": [texts[0] if first else None, *[None] * (n - 1)]}
        return pa.RecordBatch.from_pydict({f.name: pa.array(cols[f.name], f.type) for f in schema})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), True
        ids: list = []
        texts: list[str] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= GROUP_CHARS and len(texts) > 1:
                    yield batch_of(ids[:-1], texts[:-1], texts[1:], part, first)
                    ids, texts, size, first = ids[-1:], texts[-1:], len(texts[-1]), False
        if len(texts) > 1:
            yield batch_of(ids[:-1], texts[:-1], texts[1:], part, first)
            first = False
        if texts:
            row = dict.fromkeys(schema.names, None) | {"id": ids[-1], "part": part, "head": first, "tail": True, "text": texts[-1]}
            yield pa.RecordBatch.from_pydict({f.name: pa.array([row[f.name]], f.type) for f in schema})

    made = scratch.materialise(ordered.mapInArrow(run, f"id long, {REPORT}, part int, head boolean, tail boolean, text string"), "winnow-report")
    # One slim row per partition: its number, and that of the next partition with rows.
    order = Window.orderBy("part")
    following = F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    successor = made.filter("head").select("part", following.alias("next_part"))
    heads = made.filter("head").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    tails = made.filter("tail").select("id", "part", "text").join(successor, "part").join(heads, "next_part").select("id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = _report(batch.column(1).to_pylist(), batch.column(2).to_pylist(), False)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[c], kinds.get(c, pa.string())) for c in columns)], names=["id", *columns])

    return made.filter("not tail").select("id", *columns).union(tails.mapInArrow(close, f"id long, {REPORT}"))
