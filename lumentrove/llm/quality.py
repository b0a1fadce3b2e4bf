"""Document quality by supervised subword embeddings.

Hashed word, word-pair and byte n-gram features (n-grams of the UTF-8 form, so that
a letter beyond ASCII is two or more of their places) have learned vectors; a
document is the mean of its features' vectors and a softmax layer turns it into
class probabilities (the linear text classifier of Joulin et al., 2016).  It is
trained with plain numpy stochastic gradient descent on a bounded sample of
labelled rows (``max_rows``, chosen by a hash of the id, a documented
parameter) in one task, for a fixed number of steps (``steps``) at every size of
the sample; only the model, whose size is fixed by ``BUCKETS`` and
``DIM``, reaches the driver.

As the score is linear in the features before the softmax, scoring needs one
number per bucket: the difference of the class logits of its vector.  Scoring
is a scan without a shuffle over whole texts.

Defined cases: null or empty text has no features and gets the bias-only
score; labels that are null are ignored; without any label, or with one class
only, the bias is the smoothed class share; repeated rows score alike; an empty
table gives no rows; a very long text is taken in pieces; columns of the caller
keep their names, the score's excepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .kernels import U64

BUCKETS = 1 << 18
DIM = 16
GRAMS = (3, 4)
#: Steps of the descent, whatever the number of samples: 5 passes over the largest sample.
STEPS = 20_000
RATE = 0.5
CLIP = 5.0
MAX_ROWS = 4000
THRESHOLD = 0.3
FOLDS = 5
#: Bytes of rows whose features are made at once: they take some 80 times as much.
CHUNK_BYTES = 1 << 18


def features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: the buckets and the documents' bounds in them."""
    base = offsets[0]
    text, at = data[base : offsets[-1]], offsets - base
    solid = ~kernels.SPACES[text]
    border = np.zeros(len(text) + 1, bool)
    border[at] = True
    before, after = np.ones(len(text) + 1, bool), np.ones(len(text) + 1, bool)
    before[1:], after[:-1] = ~solid, ~solid
    starts = np.flatnonzero(solid & (before[:-1] | border[:-1]))
    ends = np.flatnonzero(solid & (after[1:] | border[1:])) + 1
    prefix = kernels.prefix_sums(text)
    words = kernels.spans_hash(prefix, starts, ends)
    bounds = np.searchsorted(starts, at)
    bucket = lambda x: (x & U64(BUCKETS - 1)).astype(np.int32)
    found = [(bucket(words), bounds)]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    if len(words) > 1:
        inner = doc[1:] == doc[:-1]
        pairs = kernels.mix(words[:-1] * U64(3) + words[1:] + U64(11))
        pairs[words[:-1] == words[1:]] = U64(1)  # a word that follows itself is one feature for all words
        found.append((bucket(pairs[inner]), np.searchsorted(doc[1:][inner], np.arange(len(at)))))
    _, down = kernels.powers(len(text))
    for k in GRAMS:
        n = len(text) - k + 1
        if n > 0:
            hashes = kernels.mix((prefix[k:] - prefix[:n]) * down[:n] + U64(k * 0x51ED270B7A3F))
            ok = np.ones(n, bool)
            for j in range(1, k):
                ok &= ~border[j : n + j]
            place = np.flatnonzero(ok)
            found.append((bucket(hashes[place]), np.searchsorted(place, at)))
    return found


def pieces(data: np.ndarray, offsets: np.ndarray, most: int = kernels.CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """(sign, offsets) of parts whose signed features add up to those of the rows.

    All rows are one part, but for a single very long text: its parts begin at
    words and overlap the part before by a word and by the longest gram, and
    what the overlap holds by itself is taken off again.
    """
    if len(offsets) != 2 or offsets[1] - offsets[0] <= 2 * most:
        yield 1, offsets
        return
    base, end = int(offsets[0]), int(offsets[1])
    starts = kernels.word_starts(data[base:end]) + base
    cut = base
    while cut < end:
        last = int(np.searchsorted(starts, cut + most))
        following = int(starts[last]) if last < len(starts) else end
        first = cut
        if cut > base:
            before = int(np.searchsorted(starts, cut - max(GRAMS), "right")) - 1
            first = int(starts[min(before, int(np.searchsorted(starts, cut)) - 1)]) if before >= 0 else base
            yield -1, np.array([first, cut])
        yield 1, np.array([first, following])
        cut = following


def bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per document: its distinct buckets and their shares."""
    parts = [(sign, features(data, part)) for sign, part in pieces(data, offsets)]
    for i in range(len(offsets) - 1):
        counts = [(sign, *np.unique(np.concatenate([b[at[i] : at[i + 1]] for b, at in kinds]), return_counts=True)) for sign, kinds in parts]
        own, count = counts[0][1:]
        if len(counts) > 1:
            total = np.zeros(BUCKETS, np.int64)
            for sign, bucket, n in counts:
                total[bucket] += sign * n
            own = np.flatnonzero(total).astype(np.int32)
            count = total[own]
        yield own, (count / max(1, count.sum())).astype(np.float32)


def all_bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ``bags`` of any number of rows, made chunk by chunk."""
    for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES):
        yield from bags(data, offsets[lo : hi + 1])


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM, steps: int = STEPS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight per bucket, bias): the logit of class 1 against class 0 for a mean of features."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out = np.zeros((2, dim), np.float32)
    bias = np.array([np.log(1 - share), np.log(share)], np.float64)
    if len(set(labels.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(bias[1] - bias[0])
    done = 0
    while done < steps:
        for i in rng.permutation(len(samples))[: steps - done]:
            own, part = samples[i]
            lr = rate * (1 - done / steps)
            done += 1
            if not len(own):
                continue
            rows = vectors[own]
            hidden = part @ rows
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            back = np.clip(p.astype(np.float32) @ out, -CLIP, CLIP) * lr
            out -= np.clip(p[:, None] * hidden[None, :], -CLIP, CLIP).astype(np.float32) * np.float32(lr)
            bias -= 0.1 * lr * p
            # Scaled by the largest share, so that frequent and rare features of a long text both learn.
            vectors[own] = rows - (part / part.max())[:, None] * back[None, :]
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = FOLDS, max_rows: int = MAX_ROWS, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Trains on at most ``max_rows`` labelled rows of the folds that are not held out."""
    learn = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % folds != 0)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    # Ids alone are ranked; at most max_rows of them, so the join side is bounded at any input size.
    chosen = learn.orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(chosen), "__id").select(F.col("__id").cast("long"), "__label", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = []
        for batch in batches:
            keyed += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), all_bags(*kernels.raw_text(batch.column(2))), strict=True)
        keyed.sort(key=lambda x: (x[0], x[1], len(x[2][0])))  # the order in which rows arrive must not matter
        weights, bias = train([x[2] for x in keyed], np.array([x[1] for x in keyed], int), steps=steps)
        yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    # The join runs where the texts are; only the bounded sample meets in one task.
    model = rows.repartition(1).mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model["weights"], np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", out_col: str = "score", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all by default) with the probability of class 1."""
    weights, bias = model
    rest = [c for c in (docs.columns if carry is None else carry) if c != out_col]
    inside = text_col in rest and docs.schema[text_col].dataType.typeName() == "string"  # then the text need not travel twice
    source = docs.select(F.struct(*rest).alias("row"), *([] if inside else [F.col(text_col).cast("string").alias("text")]))  # whatever the names, none meets ours

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(0).field(text_col) if inside else batch.column(1))
            found = []
            for lo, hi in kernels.row_chunks(offsets, CHUNK_BYTES):
                total, count = np.zeros(hi - lo), np.zeros(hi - lo)
                for sign, part in pieces(data, offsets[lo : hi + 1]):
                    for buckets, at in features(data, part):
                        sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
                        total += sign * np.round(sums[at[1:]] - sums[at[:-1]], 6)
                        count += sign * np.diff(at)
                found.append(np.round(1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -60, 60))), 6))
            values = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["row", "score"])

    schema = source.select("row").schema.add("score", "double")
    return source.mapInArrow(run, schema).select("row.*", F.col("score").alias(out_col))
