"""Operators against plain Python: budgets, likeness, scores, components of wide clusters, odd rows of every operator."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, word_sets

from lumentrove.llm import exact_dedup, kernels, line_dedup, minhash, mixing, packing, quality, queries, scratch, warc, winnow

SF = "/root/testdata/sf0.001"


# --- mixing ----------------------------------------------------------------


def poured(children: dict, budget: int) -> dict:
    """Budget of each child {name: (weight, cap)}: those that are full at equal weight take their cap, and the rest is shared anew."""
    open_, out, left = {k: v for k, v in children.items() if v[0] > 0}, {}, budget
    while True:
        weights = sum(w for w, _ in open_.values())
        full = [k for k, (w, cap) in open_.items() if cap * weights <= w * left]
        if not full:
            return out | {k: w * left // weights for k, (w, _) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[1]
        left = budget - sum(out.values())
        if not open_:
            return out


def plain_budgets(leaves: dict, recipe: mixing.Recipe) -> dict:
    names = {"domain": recipe.domains, "lang": recipe.langs, "source": recipe.sources}

    def down(path: tuple, budget: int) -> dict:
        if len(path) == 3:
            return {path: budget}
        level = mixing.LEVELS[len(path)]
        caps = defaultdict(int)
        for leaf, tokens in leaves.items():
            if leaf[: len(path)] == path:
                caps[leaf[len(path)]] += tokens * recipe.epochs
        shares = poured({k: (names[level].get(k, recipe.other), cap) for k, cap in caps.items()}, budget)
        return {leaf: b for k, share in shares.items() for leaf, b in down((*path, k), share).items()}

    return down((), sum(leaves.values()) * recipe.percent // 100)


@pytest.mark.parametrize(("seed", "percent", "epochs", "other"), [(1, 60, 2, 1), (2, 100, 1, 1), (3, 10, 3, 0), (4, 95, 1, 2)])
def test_budgets_are_those_of_plain_water_filling(spark, seed, percent, epochs, other):
    rng = random.Random(seed)
    leaves = {(rng.choice("pqr"), rng.choice(["en", "de", "xx"]), f"s{i}"): rng.choice([0, 1, 7, 7, 100, 5000, rng.randrange(1, 10**6)]) for i in range(120)}
    recipe = mixing.Recipe(domains={"p": 5, "q": 3, "r": 1}, langs={"en": 6, "de": 2}, sources={f"s{i}": i % 5 for i in range(0, 120, 3)}, other=other, percent=percent, epochs=epochs)
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r["domain"], r["lang"], r["source"]): r["budget"] for r in mixing.leaf_budgets(df, recipe).collect()}
    want = plain_budgets(leaves, recipe)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_a_long_document_does_not_starve_its_leaf(spark):
    rows = [(i, "word " * (5000 if i % 7 == 0 else 10), "en", "s1") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.mix(docs, mixing.Recipe(percent=50, epochs=1)).agg(F.sum("mix_tokens"), F.max("mix_tokens")).first()
    half = sum(5000 if i % 7 == 0 else 10 for i in range(200)) // 2
    assert half <= taken[0] < half + 5000


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, None, 5), (2, "a b", "en", "s", 5), (2, "a b", "en", "s", 5), (None, "c", "en", "s", 5), (3, "", "en", "t", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")
    got = mixing.mix(docs, mixing.Recipe(percent=100, epochs=1)).collect()
    assert sorted((r["doc_id"] or 0, r["mix_tokens"]) for r in got) == [(0, 1), (2, 2), (2, 2)] and {r["epoch"] for r in got} == {0}


# --- fingerprints and scores -----------------------------------------------


def plain_values(text: str, k: int, w: int) -> set[int]:
    """Hashes that winnowing keeps, window by window."""
    if not text:
        return set()
    k = min(k, len(text))
    hashes = [int(kernels.gram_hashes(np.frombuffer(text[i : i + k].encode("utf-32-le"), "<u4"), k)[0]) for i in range(len(text) - k + 1)]
    w = min(w, len(hashes))
    return {hashes[max(range(i, i + w), key=lambda j: (-(hashes[j] >> winnow.PLACE_BITS), j))] for i in range(len(hashes) - w + 1)}


def plain_likeness(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def test_likeness_is_recomputed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 700")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = {r["id"]: r for r in winnow.edit_report(docs, task_bytes=4000).collect()}
    ids = sorted(texts, reverse=True)
    assert len(ids) > 10
    for n, i in enumerate(ids[:40]):
        text, other = texts[i], texts[ids[(n + 1) % len(ids)]]
        own, edited, following = (plain_values(t, winnow.GRAM, winnow.WINDOW) for t in (text, winnow.edited(text, other), other))
        assert math.isclose(got[i]["near_edited"], plain_likeness(own, edited)) and math.isclose(got[i]["near_next"], plain_likeness(own, following))


def test_fingerprints_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "x" * 50), (3, "x" * 50), (4, "é😀" * 40000)]
    got = winnow.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["id"]].append((r["n_chars"], r["fingerprint"], r["near_next"]))
    assert len(got) == 6 and by[2][0] == by[2][1] == (0, by[1][0][1], 1.0) and by[None][0][1] == by[3][0][1] and by[4][0][0] == 80000


def plain_score(text: bytes, weights: np.ndarray, bias: float) -> float:
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text) if w]
    one = lambda w: int(kernels.spans_hash(kernels.prefix_sums(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    names = [one(w) for w in words]
    found = list(names)
    for a, b in zip(names, names[1:], strict=False):
        found.append(1 if a == b else int(kernels.mix(np.array([(a * 3 + b + 11) % 2**64], np.uint64))[0]))
    for k in quality.GRAMS:
        for i in range(len(text) - k + 1):
            part = np.frombuffer(text[i : i + k], np.uint8)
            raw = sum((int(c) + 1) * pow(kernels.BASE, j, 2**64) for j, c in enumerate(part)) + k * 0x51ED270B7A3F
            found.append(int(kernels.mix(np.array([raw % 2**64], np.uint64))[0]))
    total = sum(float(weights[x % quality.BUCKETS]) for x in found) / max(1, len(found)) + bias
    return 1 / (1 + math.exp(-total))


def test_scores_are_recomputed_feature_by_feature(spark):
    rng = np.random.default_rng(3)
    model = (rng.normal(0, 3, quality.BUCKETS).astype(np.float32), 0.25)
    rows = [(1, "the the cat  sat\non é mat"), (2, None), (3, "ab"), (4, "word " * 30000), (5, "\t \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i, text in rows:
        if i != 4:
            assert math.isclose(got[i], plain_score((text or "").encode(), *model), abs_tol=3e-6), i
    assert 0 <= got[4] <= 1


def test_predictions_follow_the_threshold_and_beat_the_share(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op9_quality(spark, sf).collect()]
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    bad = [p for p, y in held if y == 0]
    good = [p for p, y in held if y == 1]
    assert np.mean(good) > 0.9 and np.mean(bad) < np.mean(good)


# --- near-duplicates -------------------------------------------------------


def variants(seed: int, many: int, most: int) -> list[tuple[int, str]]:
    """Variants of one text that share buckets with one another, but are mostly no near-duplicates."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(80)]
    rows = []
    for i in range(many):
        text = list(base)
        for j in rng.sample(range(80), rng.randrange(1, most)):
            text[j] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("hub_share", "block_bytes", "block_rows"), [(7, 60_000, 4096), (1000, 32 << 20, 70), (1000, 32 << 20, 4096)])
def test_clusters_of_unlike_variants(spark, hub_share, block_bytes, block_rows):
    rows = variants(5, 250, 9)
    want = brute_components(word_sets(dict(rows), 4))
    got = {r["id"]: r["component"] for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=4, hub_share=hub_share, block_bytes=block_bytes, block_rows=block_rows).collect()}
    assert got == want and 20 < len(set(want.values())) < 240


def test_a_chain_of_near_duplicates_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(70)]
    want = brute_components(word_sets(dict(rows), 5))
    got = {r["id"]: r["component"] for r in minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()}
    assert got == want and sum(c == 0 for c in got.values()) > 50


# --- very long texts -------------------------------------------------------


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return "".join(rng.choice(["ab", "c", "déf", "ghij", "k"]) + rng.choice([" ", "  ", "\n", "\t "]) for _ in range(3000))


@pytest.mark.parametrize("most", [64, 301, 5000])
def test_pieces_of_a_long_text_have_its_shingles_and_features(long_text, most):
    for text in (long_text, "x" * 2000, " " * 2000, "a " * 700):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        for words in (1, 5):
            whole, cut = minhash.shingle_sets(data, offsets, words), minhash.row_sets(data, offsets, words, most)
            assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
        want = np.bincount(np.concatenate([b for b, _ in quality.features(data, offsets)]), minlength=quality.BUCKETS)
        got = np.zeros(quality.BUCKETS, np.int64)
        for sign, part in quality.pieces(data, offsets, most):
            for buckets, _ in quality.features(data, part):
                got += sign * np.bincount(buckets, minlength=quality.BUCKETS)
        assert (got == want).all()


@pytest.mark.parametrize("most", [40, 301, 5000])
def test_pieces_of_a_long_text_have_its_fingerprint(long_text, most):
    for text in (long_text, "x" * 2000, "ab" * 1000):
        (want, at), (got, there) = winnow.winnow([text])[0], winnow.winnow([text, "short"], most=most)[0]
        assert (at == there).all() and (want == got).all()


# --- values of odd rows ----------------------------------------------------


def test_exact_groups_of_odd_rows(spark):
    rows = [(None, "a"), (4, "a"), (4, "a"), (2, "x\t\n y"), (3, "x y"), (5, None), (6, ""), (7, "z" * 1_000_000)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, kept string")
    for carry in (True, False):
        got = sorted(((r["doc_id"] or 0), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs, carry_text=carry).collect())
        assert got == [(0, 4, 3, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 3, True), (4, 4, 3, True), (5, 5, 2, True), (6, 5, 2, False), (7, 7, 1, True)]
    groups = {r["digest"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_groups(docs).collect()}
    assert groups == {hashlib.sha256(t.encode()).hexdigest(): v for t, v in (("a", (4, 3)), ("x y", (2, 2)), ("", (5, 2)))}


def test_lines_of_odd_rows(spark):
    menu = "home\n\t \nabout"
    rows = [(i, f"s{i}", f"{menu}\nown {i}\nhome") for i in range(10)] + [(99, None, "home\nx"), (98, "s1", None), (None, "s2", "home"), (97, "s3", ""), (97, "s3", "home\n" * 5000)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, source string, text string, lines_removed int")
    got = [(r["doc_id"], r["text"], r["lines_removed"]) for r in line_dedup.remove_boilerplate(docs).collect()]
    assert len(got) == len(rows)
    assert all(x in got for x in [(3, "\t \nown 3", 3), (99, "x", 1), (98, None, 0), (None, "", 1), (97, "", 0), (97, "", 5000)])


def test_archives_of_odd_rows(spark):
    big = "y" * 3_000_000
    rows = [(5, "http://a b", "x" * 100, 1), (3, None, "x" * 100, 1), (3, None, "x" * 100, 1), (None, "u", "x" * 100, 1), (7, "u", "x" * 99, 1), (8, "u", "x" * 99, 1), (9, "u", None, 1), (10, "u", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = scratch.fresh_path(spark, "warc-test")
    index = warc.write_archives(warc.with_revisits(pages), folder, roll_bytes=300)
    assert index.select("archive").distinct().count() > 1
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"] and len(r["payload"])) for r in warc.read_records(index, folder, gap_bytes=0, range_bytes=200).collect()]
    want = [(5, "revisit", 3, 100, None), (3, "response", None, 100, 100), (3, "response", None, 100, 100), (None, "revisit", 3, 100, None), (7, "response", None, 99, 99), (8, "response", None, 99, 99), (9, "response", None, 0, b""), (10, "response", None, 3_000_000, 3_000_000)]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted([(*w[:4], w[4] or w[4]) for w in want], key=key)


def test_packing_of_odd_rows_uses_as_few_sequences_as_best_fit(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d"), (4, "word " * 30000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["doc_id"]] += r["length"]
    assert sizes[1] == sizes[2] == 1 and sizes[3] == 8 and sizes[4] > 30000
    filled = defaultdict(int)
    for r in got:
        filled[r["sequence_id"]] += r["length"]
    assert len(filled) == -(-sum(sizes.values()) // packing.CAPACITY)


def test_the_query_packs_as_few_sequences_as_best_fit_over_documents(spark):
    got = queries.op3_packing(spark, SF).collect()
    rooms = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((packing.CAPACITY if fit is None else fit) - length)
    assert len({r["sequence_id"] for r in got}) == len(rooms)


def test_shared_folders_are_asked_for_on_a_cluster(spark, tmp_path):
    one, two = (scratch.materialise(spark.range(3), "t") for _ in range(2))
    before = scratch.left(spark)
    three = scratch.materialise(spark.range(4), "t")
    scratch.sweep(spark, earlier=before)
    assert (one.count(), two.count()) == (3, 3) and three.scratch_path not in scratch.left(spark)
    scratch.release(one)
    assert one.scratch_path not in scratch.left(spark)


# --- repeated ids, clashing names, texts that a tokenizer refuses ------------


def test_unlike_texts_of_one_id_are_kept(spark, tmp_path):
    """(1, A), (2, near-copy of A), (2, unlike text): the unlike text is no copy of anything."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a = " ".join(f"word{i}" for i in range(100))
    near, other = a.replace("word99", "end"), " ".join(f"other{i}" for i in range(100))
    rows = [(1, a), (2, near), (2, other), (3, other + " more"), (3, other + " more"), (4, ""), (4, None), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "id": F.lit(2), "h1": F.lit(3)})
    found = {(r["id"], r["h1"]): (r["component"], r["group"]) for r in minhash.near_components(docs, words=5).collect()}
    names = {r["text"]: r["h1"] for r in docs.select("text", minhash.text_hashes(F.col("text"))[0].alias("h1")).collect()}
    assert found[2, names[near]] == found[1, names[a]] and found[2, names[near]][0] == 1
    assert found[2, names[other]] == found[3, names[other + " more"]] and found[2, names[other]][0] == 2
    assert found[2, names[other]][1] != found[2, names[near]][1] and found[None, names[a]] == (None, None)
    kept = pipeline.near_deduplication(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in kept.collect())) == sorted([(1, a), (2, other), (4, ""), (4, ""), (0, a)])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_ids_against_all_pairs(spark, seed):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(seed)
    stems = [[f"s{j}w{i}" for i in range(40)] for j in range(12)]
    rows = []
    for _ in range(150):
        words = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        rows.append((rng.randrange(25), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted(set(rows))
    component = brute_components(word_sets({n: t for n, (_, t) in enumerate(texts)}, 5))
    groups = defaultdict(set)
    for n, c in component.items():
        groups[c].add(texts[n])
    low = {row: min(i for i, _ in g) for g in groups.values() for row in g}
    got = minhash.near_components(docs, words=5).collect()
    hashes = {r["text"]: r["h1"] for r in docs.select("text", minhash.text_hashes(F.col("text"))[0].alias("h1")).collect()}
    assert sorted((r["id"], r["h1"], r["component"]) for r in got) == sorted((i, hashes[t], low[i, t]) for i, t in rows)
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_deduplication(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) == len(groups)
    assert all(sum(row in g for row in kept) == 1 for g in groups.values()) and all(low[row] == row[0] for row in kept)


def test_a_hub_of_many_partners_is_handed_on_in_bounded_batches(spark):
    """One long text with 50,000 partners: its set leaves the task in small batches, and all its uses are there."""
    text = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(0, text), (7, "another")], "doc_id long, text string")
    classes = minhash.profile(docs, "doc_id", "text", 5, 128, 32).select("set_hash", F.col("id").alias("rep"), F.when(F.col("id") == 0, -1).otherwise(-2).cast("long").alias("node"))
    pairs = spark.range(50_000).select(F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"))
    sets = minhash.wanted_sets(pairs, classes, docs, "doc_id", "text", 5, 100, copy_bytes=1 << 20)
    assert sets.agg(F.count("*"), F.count_distinct("share"), F.min(F.octet_length("shingles"))).first()[:] == (500, 500, 8 * 19_996)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \n\t\r", " ", "a \n"])
def test_long_runs_of_white_space_are_packed(spark, unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "start" + unit * (2_000_000 // len(unit)) + "<|endoftext|> end"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids + [0]
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = sorted((r for r in packing.pack(docs).collect() if r["doc_id"] == 1), key=lambda r: r["piece"])
    ids = np.array(want, "<u4")
    assert [r["start"] for r in got] == [0, *np.cumsum([r["length"] for r in got])[:-1].tolist()] and sum(r["length"] for r in got) == len(ids)
    assert [r["ids_crc32"] for r in got] == [__import__("zlib").crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got]


CLASHES = ["__k1", "__k2", "__domain", "__lang", "__source", "__id", "__text", "__scored", "__gone", "__lines", "row", "id", "domain", "key", "digest", "times", "whole", "line", "site"]


def test_columns_of_any_name_are_carried(spark):
    rows = [(1, "a b c\nshared line", "en", "s1"), (2, None, None, None), (3, "a b c\nshared line", "de", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(c) for c in CLASHES})
    model = (np.zeros(quality.BUCKETS, np.float32), 0.0)
    for made, new in ((line_dedup.remove_boilerplate(docs, min_sites=2), ["lines_removed"]), (mixing.mix(docs, mixing.Recipe(percent=100, epochs=1)), ["epoch", "mix_domain", "mix_tokens"]), (exact_dedup.exact_dedup(docs), ["keep_id", "group_size", "kept", "text_sha256"]), (quality.score(docs, model), ["score"])):
        assert made.columns == docs.columns + new
        assert all(r[c] == c for r in made.collect() for c in CLASHES)
    assert {r["doc_id"]: r["text"] for r in line_dedup.remove_boilerplate(docs, min_sites=2).collect()} == {1: "", 2: None, 3: ""}
