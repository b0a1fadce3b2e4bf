"""The training-data operators against SQL or brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import oracle
import pyarrow.parquet as pq
import pytest

from lumentrove.llm import components, kernels, minhash, packing, queries, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), [x or "" for x in t["text"].to_pylist()], strict=True))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert not oracle.differences(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name])


def word_sets(texts, words):
    out = {}
    for i, text in texts.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = {tuple(own[j : j + words]) for j in range(max(1, len(own) - words + 1))}
        out[i] = grams if own else set()
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


def test_minhash_matches_all_pairs(spark, texts):
    sets = word_sets(texts, 4)
    want = brute_components(sets)
    got = queries.op10_minhash(spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in texts}


def test_minhash_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (None, "one two"), (5, " \t ")]
    got = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert sorted((r["id"] or 0, r["n_shingles"], r["component"] or 0) for r in got) == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5)]


def brute_repeats(texts, width):
    places = defaultdict(list)
    data = {i: t.encode() for i, t in texts.items()}
    for i, d in data.items():
        for j in range(len(d) - width + 1):
            places[d[j : j + width]].append((i, j))
    gone = {i: bytearray(len(d)) for i, d in data.items()}
    for found in places.values():
        if len(found) > 1:
            for i, j in found:
                gone[i][j : j + width] = b"\1" * width
    return {i: (len(d), sum(gone[i]), len(re.findall(b"\1+", bytes(gone[i]))), hashlib.sha256(bytes(b for b, g in zip(d, gone[i], strict=True) if not g)).hexdigest()) for i, d in data.items()}


def test_suffix_dedup_matches_brute_force(spark, texts):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_suffix_dedup(spark, SF).collect()}
    assert got == brute_repeats(texts, 400)


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = queries.op3_packing(spark, SF).collect()
    ids = {i: tok.encode(t, add_special_tokens=False).ids + [0] for i, t in texts.items()}
    parts = defaultdict(list)
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own)) == r["ids_crc32"]
        parts[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter({i: len(x) for i, x in ids.items()}) == sum((Counter({r["doc_id"]: r["length"]}) for r in rows), Counter())
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_plan_places_every_rank_once():
    plan = packing.best_fit_plan({5: 7, 3: 4, 2: 9, 1: 3}, 10)
    for length, n in {5: 7, 3: 4, 2: 9, 1: 3}.items():
        assert sorted(k for row in plan if row[0] == length for k in range(row[1], row[2])) == list(range(n))


def test_winnowing(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_winnowing(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    for n, i in enumerate(ids):
        text, other = texts[i], texts[ids[(n + 1) % len(ids)]]
        tail = len(text) // 3
        edited = text[: len(text) - tail] + other[:tail]
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(rows[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_quality_beats_chance_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r["score"], labels[r["doc_id"]]) for r in queries.op9_quality(spark, sf).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / max(1, len(good) * len(bad))
    assert auc > 0.8


def test_quality_empty_text_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_pipeline_runs(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({(r["doc_id"], r["piece"], r["start"]) for r in rows}) == len(rows)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_null_and_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, an extra column: no query may crash or lose a row."""
    long_text = "word " * 60000
    rows = [(1, None, None, None, None, 1), (2, "", "en", "s1", 0, 1), (3, "a b c", "en", "s1", 5, 1), (3, "a b c", "en", "s1", 5, 1), (4, long_text, None, "s2", 9, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0), (4, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://a", "x" * 200), (3, "http://b", "x" * 200), (4, "http://c", "")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op4_line_dedup", "op6_exact_dedup", "op9_quality", "op10_minhash", "op8_suffix_dedup"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == len(rows), name
    assert queries.op1_warc(spark, str(tmp_path)).count() == 4
    assert queries.op3_packing(spark, str(tmp_path)).count() >= len(rows)


def test_quality_features_take_bounded_memory():
    """Features are made for a quarter of a megabyte of text at once, however many rows a batch has."""
    import tracemalloc

    import pyarrow as pa

    texts = [" ".join(f"word{(i * 31 + j * j) % 4001}" for j in range(250)) for i in range(2000)]
    data, offsets = kernels.raw_text(pa.array(texts))
    assert len(data) > 3_500_000
    kernels.powers(1)
    tracemalloc.start()
    try:
        for _ in quality.all_bags(data, offsets):
            pass
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 64 << 20, most
    whole = list(quality.bags(data, offsets[:301]))
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(whole, quality.all_bags(data, offsets[:301]), strict=True))
