"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set holds the hashes of its distinct word shingles.  The sketch
follows Dahlgaard, Knudsen and Thorup (2017): in round i every element is
hashed to a bin and a value, earlier rounds win, and from round t on round
t + j sends every element to bin j, so that all t bins are filled and matches
between two sketches concentrate around the Jaccard similarity.

Stages: (1) one scan makes a profile row per document; (2) equal sets collapse
into classes; (3) bands of the class sketches make buckets, in which members
are tied to two hubs only, the smallest and the largest id, so a bucket of any
size makes candidates in proportion to it; (4) the full sets of candidates are
compared, members of a hub being split over several tasks; (5) links give
components.  Pairs inside one component need no test, as they cannot change it.

(6) Components that still share a bucket are a family: texts that are alike, but
mostly below the threshold, so that every pair of them has to be looked at.  A
family's documents are compared inside tasks, in blocks bounded by bytes and
rows: first by finer sketches (``FINE_BINS`` bins, by the concentration bound),
then on full sets, skipping pairs that are connected by then.  A block returns
links, fewer than it has documents, and never its pairs.  A family of one block
travels once, and one of b blocks b times.

Classes are numbered when they are written, and links and components are between
these numbers, so rows that share an id are linked by their own texts.

Defined cases: null text is an empty set and linked with nothing; a text with
fewer words than a shingle is one shingle; rows with a null id are their own
component and link nothing; repeated rows fall into one class, and unlike texts
of one id into several; an empty table gives no rows; a very long text is taken in
pieces, its set of shingles whole; only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, kernels, scratch
from .kernels import U64

BINS = 128
BANDS = 32
#: 4.5 deviations of the match count of two sketches at the threshold.
SLACK = 4.5
HUB_SHARE = 1000
#: Most bytes of sets that a task hands on at once, beyond a single set.
COPY_BYTES = 16 << 20
FINE_BINS = 1024
BLOCK_BYTES = 32 << 20
BLOCK_ROWS = 4096


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and the documents' bounds."""
    base = offsets[0]
    text = kernels.LOWER[data[base : offsets[-1]]]
    n_docs = len(offsets) - 1
    solid = ~kernels.SPACES[text]
    border = np.zeros(len(text) + 1, bool)
    border[offsets - base] = True
    before = np.ones(len(text) + 1, bool)
    before[1:] = ~solid
    starts = np.flatnonzero(solid & (before[:-1] | border[:-1]))
    after = np.ones(len(text) + 1, bool)
    after[:-1] = ~solid
    ends = np.flatnonzero(solid & (after[1:] | border[1:])) + 1
    hashes = kernels.spans_hash(kernels.prefix_sums(text), starts, ends)
    bounds = np.searchsorted(starts, offsets - base)
    n_words = np.diff(bounds)
    n_grams = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    cuts = np.concatenate([[0], np.cumsum(n_grams)])
    first = np.repeat(bounds[:-1] - cuts[:-1], n_grams) + np.arange(cuts[-1])
    width = np.minimum(np.repeat(n_words, n_grams), words)
    padded = np.concatenate([hashes, np.zeros(words, U64)])
    grams = width.astype(U64) * U64(0xA24BAED4963EE407)
    for j in range(words):
        grams = grams + np.where(j < width, kernels.mix(padded[first + j] + U64((j + 1) * 0x9FB21C651E98DF25 & (1 << 64) - 1)), U64(0))
    grams = kernels.mix(grams)
    out, at = np.empty_like(grams), np.zeros(n_docs + 1, np.int64)
    for i in range(n_docs):
        own = np.sort(grams[cuts[i] : cuts[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        out[at[i] : at[i] + len(own)] = own
        at[i + 1] = at[i] + len(own)
    return out[: at[-1]], at


def row_sets(data: np.ndarray, offsets: np.ndarray, words: int, most: int = kernels.CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets``; one very long text is taken in overlapping pieces of about ``most`` bytes, so that its hashes never stand side by side."""
    if len(offsets) != 2 or offsets[1] - offsets[0] <= 2 * most:
        return shingle_sets(data, offsets, words)
    text = data[offsets[0] : offsets[1]]
    starts = kernels.word_starts(text)
    if len(starts) <= words:
        return shingle_sets(data, offsets, words)
    ends, step, found, at = np.append(starts, len(text)), max(1, int(most * len(starts) / len(text))), [], 0
    while at <= len(starts) - words:
        last = min(at + step + words - 1, len(starts))
        found.append(shingle_sets(text, np.array([ends[at], ends[last]]), words)[0])
        at += step
    own = np.unique(np.concatenate(found))
    return own, np.array([0, len(own)])


def sketches(sets: np.ndarray, at: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, a row per document; rows of empty sets are undefined."""
    n_docs = len(at) - 1
    empty = np.iinfo(U64).max
    table = np.full(n_docs * bins, empty, U64)
    doc = np.repeat(np.arange(n_docs), np.diff(at))
    todo = np.flatnonzero(np.diff(at))
    own, items = doc, sets
    top = max(1, (2 * bins - 1).bit_length())
    for r in range(2 * bins):
        if not len(todo):
            break
        x = kernels.mix(items + U64((r + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1))
        place = (x % U64(bins)).astype(np.int64) if r < bins else np.full(len(x), r - bins)
        np.minimum.at(table, own * bins + place, (U64(r) << U64(64 - top)) | (x >> U64(top)))
        open_now = (table.reshape(n_docs, bins)[todo] == empty).any(axis=1)
        if not open_now.all():
            todo = todo[open_now]
            still = np.zeros(n_docs, bool)
            still[todo] = True
            mask = still[own]
            own, items = own[mask], items[mask]
    return table.reshape(n_docs, bins)


def set_digests(sets: np.ndarray, at: np.ndarray) -> pa.Array:
    """Digest of each set; null for an empty one."""
    return pa.array([xxhash.xxh3_128_digest(sets[a:b]) if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())


def text_hashes(text: Column) -> list[Column]:
    """Two hashes of a text, h1 and h2, which with the id name a row."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(0x726F77), own).alias("h2")]


PROFILE = "id long, h1 long, h2 long, n_shingles long, set_hash binary, bands array<long>"


def profile(docs: DataFrame, id_col: str, text_col: str, words: int, bins: int, bands: int) -> DataFrame:
    """A row per document: two hashes of its text, set size, digest of the set and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(3))
            for lo, hi in kernels.row_chunks(offsets):
                sets, at = row_sets(data, offsets[lo : hi + 1], words)
                table = sketches(sets, at, bins)
                keys = np.zeros((hi - lo, bands), U64)
                for j in range(bins // bands):
                    keys = kernels.mix(keys + table[:, j :: bins // bands][:, :bands] + U64(j + 1))
                keys = kernels.mix(keys + np.arange(1, bands + 1, dtype=U64) * U64(0xBB67AE8584CAA73B)).view(np.int64)
                size = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(lo, hi - lo) for c in range(3)],
                        pa.array(size),
                        set_digests(sets, at),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel())),
                    ],
                    names=["id", "h1", "h2", "n_shingles", "set_hash", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), *text_hashes(F.col(text_col)), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PROFILE)


def meetings(pairs: DataFrame, hub_share: int) -> DataFrame:
    """(id, hub, share, member): where the sets of ``pairs`` (a, b) meet.

    b plays the hub: its set is there once for each share of about ``hub_share``
    partners, each a's set once for every hub it has.
    """
    shares = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / hub_share).cast("int").alias("shares"))
    members = pairs.join(shares, "b").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("member"))
    return members.unionByName(shares.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("member")))


def wanted_sets(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, hub_share: int, copy_bytes: int = COPY_BYTES) -> DataFrame:
    """The full sets that verifying ``pairs`` of class numbers needs: (hub, share, member, id, shingles), written to the shared folder.

    A text is read and joined once, whatever the number of its pairs, and the
    copies of a hub's set leave its task in batches of at most ``copy_bytes``.
    """
    uses = meetings(pairs, hub_share).groupBy("id").agg(F.collect_list(F.struct("hub", "share", "member")).alias("uses"))  # a place for each band and share, no set
    named = uses.join(classes.select(F.col("node").alias("id"), "rep", "set_hash"), "id")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(3))
            for lo, hi in kernels.row_chunks(offsets):
                own, at = row_sets(data, offsets[lo : hi + 1], words)
                # Another text of the same id is not meant.
                meant = pc.equal(set_digests(own, at), batch.column(2).slice(lo, hi - lo)).fill_null(False).to_numpy(zero_copy_only=False)
                lists = batch.column(1).slice(lo, hi - lo)
                flat, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(hi - lo), many)
                use = np.flatnonzero(meant[row])
                step = np.cumsum(np.diff(at)[row[use]] * 8) // copy_bytes
                each = pa.array([own[at[i] : at[i + 1]].tobytes() if meant[i] else b"" for i in range(hi - lo)], pa.binary())
                ids = batch.column(0).slice(lo, hi - lo)
                for part in np.split(use, np.flatnonzero(np.diff(step)) + 1) if len(use) else []:
                    chosen, owner = flat.take(pa.array(part)), pa.array(row[part])
                    yield pa.RecordBatch.from_arrays([*[chosen.field(c) for c in ("hub", "share", "member")], ids.take(owner), each.take(owner)], names=["hub", "share", "member", "id", "shingles"])

    # Merged rather than broadcast at any size: the candidates grow with the corpus.
    rows = named.hint("merge").join(texts.hint("merge"), "rep").select("id", "uses", "set_hash", "text")
    return scratch.materialise(rows.mapInArrow(sets, "hub long, share int, member int, id long, shingles binary"), "minhash-sets")


def overlap(own: np.ndarray, other: np.ndarray) -> int:
    near = np.searchsorted(other, own)
    near[near == len(other)] = 0
    return int((other[near] == own).sum())


def verified(sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose ``sets`` meet and have den * |A and B| >= num * |A or B|."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub_set = None, np.zeros(0, U64)
        for batch in batches:
            a, b = [], []
            hubs, shares, member, ids = (batch.column(c).to_numpy() for c in range(4))
            for i in range(batch.num_rows):
                own = np.frombuffer(batch.column(4)[i].as_buffer(), U64)
                if not member[i]:
                    key, hub_set = (hubs[i], shares[i]), own.copy()
                elif key == (hubs[i], shares[i]) and len(own) and len(hub_set):
                    if min(len(own), len(hub_set)) * den < num * max(len(own), len(hub_set)):
                        continue
                    both = overlap(own, hub_set)
                    if den * both >= num * (len(own) + len(hub_set) - both):
                        a.append(ids[i])
                        b.append(hubs[i])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sets.repartition("hub", "share").sortWithinPartitions("hub", "share", "member").mapInArrow(compare, "a long, b long")


def fine_sketches(full: DataFrame, bins: int = FINE_BINS) -> DataFrame:
    """(id, marks, shingles) from (id, shingles): eight bits of each bin of a finer sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(1))
            for lo, hi in kernels.row_chunks(offsets):
                own = offsets[lo : hi + 1]
                table = sketches(np.frombuffer(data[own[0] : own[-1]].tobytes(), U64), (own - own[0]) // 8, bins)
                marks = pa.array([x.tobytes() for x in (table & U64(0xFF)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), marks, batch.column(1).slice(lo, hi - lo)], names=["id", "marks", "shingles"])

    return full.select("id", "shingles").mapInArrow(run, "id long, marks binary, shingles binary")


def mixed_buckets(members: DataFrame, named: DataFrame) -> DataFrame:
    """(key, id, label) of the buckets of ``members`` (key, id) that hold more than one component of ``named``."""
    placed = members.join(named, members["id"] == named["node"], "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key")
    return placed.join(mixed, "key", "left_semi")


def families(members: DataFrame) -> DataFrame:
    """(id, label, family): components that share a bucket of ``members`` (key, id, label), directly or through others, are one family."""
    least = members.groupBy("key").agg(F.min("label").alias("x"))
    touching = members.select("key", "label").distinct().join(least, "key").select(F.col("label").alias("a"), F.col("x").alias("b")).distinct()
    named = components.connected_components(touching)
    return members.select("id", "label").distinct().join(named, F.col("label") == named["node"]).select("id", "label", F.col("component").alias("family"))


def family_links(rows: DataFrame, bins: int, num: int, den: int, block_bytes: int, block_rows: int) -> DataFrame:
    """Links (a, b) between components of one family, from ``rows`` (family, id, label, marks, shingles).

    A family is cut into blocks, and each pair of blocks is a group.  A group
    takes documents in turn and compares each with the earlier ones of other
    components, the likeliest first, until it is connected to them.
    """
    level = num / den
    least = bins * level - SLACK * (bins * level * (1 - level)) ** 0.5
    bytes_ = F.sum(F.octet_length("shingles") + F.lit(bins))
    sizes = rows.groupBy("family").agg(F.ceil(F.greatest(bytes_ / block_bytes, F.count(F.lit(1)) / block_rows)).cast("int").alias("blocks"))
    placed = rows.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "label", "marks", "shingles")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, label, block = (group.column(c).to_numpy().copy() for c in ("id", "label", "block"))
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(ids), bins)
        sets = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        apart = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        found: list[tuple[int, int]] = []
        for x in range(1, len(ids)):
            open_ = (label[:x] != label[x]) & (np.minimum(size[:x], size[x]) * den >= num * np.maximum(size[:x], size[x]))
            if apart:
                open_ &= block[:x] != block[x]
            rest = np.flatnonzero(open_)
            if not len(rest):
                continue
            agree = (marks[rest] == marks[x]).sum(axis=1)
            near = agree >= least
            for y in rest[near][np.argsort(-agree[near], kind="stable")].tolist():
                if label[y] == label[x]:
                    continue
                both = overlap(sets[y], sets[x])
                if den * both >= num * (size[x] + size[y] - both):
                    found.append((int(ids[x]), int(ids[y])))
                    label[label == label[y]] = label[x]
        return pa.table({"a": pa.array([p[0] for p in found], pa.int64()), "b": pa.array([p[1] for p in found], pa.int64())})

    return spread.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def hub_ties(buckets: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket (key, id, label) with the bucket's smallest and largest id, where these have other labels."""
    own = F.struct("id", "label")
    hubs = buckets.groupBy("key").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter("low <> high")
    ties = buckets.join(hubs, "key").select("id", "label", F.explode(F.array("low", "high")).alias("hub")).filter("label <> hub.label")
    return ties.select(F.greatest("id", "hub.id").alias("a"), F.least("id", "hub.id").alias("b")).distinct()


def completed(links: DataFrame, members: DataFrame, sets: DataFrame, num: int, den: int, block_bytes: int, block_rows: int) -> DataFrame:
    """(node, component) after linking what the documents of mixed buckets, ``members`` (key, id, label), have in common."""
    placed = scratch.materialise(families(members), "minhash-families")
    full = sets.join(placed.select("id").hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("shingles").alias("shingles"))
    rows = scratch.materialise(fine_sketches(full).join(placed, "id").select("family", "id", "label", "marks", "shingles"), "minhash-members")
    more = family_links(rows, FINE_BINS, num, den, block_bytes, block_rows)
    return scratch.materialise(components.connected_components(links.union(more)), "minhash-components")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, bins: int = BINS, bands: int = BANDS, hub_share: int = HUB_SHARE, block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, h1, h2, n_shingles, component, group) per row; links have Jaccard similarity of num/den or more.

    ``component`` is the smallest id of the row's component; ``group`` tells components
    apart even where ids repeat, and is null for rows that link nothing.  h1
    and h2 are the ``text_hashes`` of the row's text.
    """
    made = scratch.materialise(profile(docs, id_col, text_col, words, bins, bands), "minhash-profile")
    live = made.filter("set_hash is not null and id is not null")
    numbered = live.groupBy("set_hash").agg(F.min("id").alias("rep"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.materialise(numbered, "minhash-classes")  # numbers are given once, in this table
    banded = classes.select(F.col("node").alias("id"), F.explode("bands").alias("key"))
    crowds = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = scratch.materialise(banded.join(crowds, "key"), "minhash-buckets")
    sets = wanted_sets(hub_ties(shared.withColumn("label", F.col("id"))), classes, docs, id_col, text_col, words, hub_share)
    links = scratch.materialise(verified(sets, num, den), "minhash-links")
    named = scratch.materialise(components.connected_components(links), "minhash-components")
    members = scratch.materialise(mixed_buckets(shared.filter("n > 2").select("key", "id"), named), "minhash-mixed")
    if not members.isEmpty():
        named = completed(links, members, sets, num, den, block_bytes, block_rows)
    linked = scratch.materialise(named.join(classes.select("node", "set_hash", "rep"), "node"), "minhash-linked")
    lowest = linked.groupBy("component").agg(F.min("rep").alias("lowest"))
    labels = classes.select("set_hash", "node", "rep").join(linked.join(lowest, "component").select("set_hash", "component", "lowest"), "set_hash", "left").select("set_hash", F.coalesce("component", "node").alias("group"), F.coalesce("lowest", "rep").alias("component"))
    placed = made.select("id", "h1", "h2", "n_shingles", "set_hash").join(labels, "set_hash", "left")
    known = lambda c: F.when(F.col("id").isNotNull(), F.col(c))
    return placed.select("id", "h1", "h2", "n_shingles", F.coalesce(known("component"), "id").alias("component"), known("group").alias("group"))
