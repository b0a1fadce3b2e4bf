"""Methods and pipeline stages against plain Python versions of them."""

import math
import pathlib
import re
from collections import Counter, defaultdict

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumentrove.llm import kernels, license_scan, mixing, packing, queries, quality, suffix_dedup, winnow

SF = "/root/testdata/sf0.001"


# --- winnowing -------------------------------------------------------------


def brute_winnow(text, k, w):
    """Places that winnowing keeps, from one hash per gram."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if not len(text):
        return []
    k = min(k, len(text))
    top = [int(h) >> winnow.PLACE_BITS for h in kernels.gram_hashes(points, k)]
    w = min(w, len(top))
    return sorted({max(range(i, i + w), key=lambda j: (-top[j], j)) for i in range(len(top) - w + 1)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé😀 ", max_size=120), min_size=1, max_size=4))
def test_winnowing_keeps_the_rightmost_minimum_of_every_window(texts):
    for (_, places), text in zip(winnow.winnow(texts, 6, 5), texts, strict=True):
        assert places.tolist() == brute_winnow(text, 6, 5)


@settings(max_examples=40, deadline=None)
@given(st.text("abcd", max_size=60), st.text("abcd", min_size=10, max_size=40), st.text("abcd", max_size=60))
def test_a_shared_stretch_of_a_window_shares_a_value(left, shared, right):
    (a, _), (b, _) = winnow.winnow([left + shared, shared + right], 6, 5)
    assert set(a.tolist()) & set(b.tolist())


def test_fingerprint_likeness_follows_the_texts(spark):
    rows = {r["doc_id"]: r for r in queries.op2_winnowing(spark, SF).collect()}
    long = [r for r in rows.values() if r["n_chars"] > 2000]
    assert np.mean([r["near_edited"] for r in long]) > 0.3
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


# --- licences --------------------------------------------------------------


def brute_best(unit, vectors, idf, unknown):
    own = {w: n * idf.get(w, unknown) for w, n in Counter(re.findall(rb"[a-z0-9\x80-\xff]+", unit.lower())).items()}
    norm = math.sqrt(sum(v * v for v in own.values()))
    scores = [(sum(v * own.get(w, 0.0) for w, v in vector.items()) / norm if norm else 0.0, name) for name, vector in vectors]
    top = max((s for s, _ in scores), default=0.0)
    return (min(n for s, n in scores if s > top - 1e-9) if top > 0 else None), top


def test_license_scan_matches_plain_cosines(spark, tmp_path):
    texts = {i: "\n".join(["common words in every file", f"file number {i}", *[license_scan.TEMPLATES[name][0]] * (i % 3 == 0), "more text"]) for i, name in enumerate(license_scan.TEMPLATES)}
    texts |= {100 + i: f"common words in every file and {i} other things" for i in range(30)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["key"]: r for r in license_scan.scan(docs, "doc_id").collect()}
    words = {i: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower()) for i, t in texts.items()}
    known = {w for ts in license_scan.TEMPLATES.values() for t in ts for w in re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())}
    df = {w: sum(w in set(x) for x in words.values()) for w in known}
    n = len(texts)
    idf = {w: math.log((n + 1) / (c + 1)) + 1 for w, c in df.items()}
    vectors = []
    for name, notices in license_scan.TEMPLATES.items():
        for t in notices:
            v = {w: c * idf[w] for w, c in Counter(re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            if norm:
                vectors.append((name, {w: x / norm for w, x in v.items()}))
    for i, text in texts.items():
        lines = [brute_best(line.encode(), vectors, idf, math.log(n + 1) + 1) for line in text.split("\n")]
        score = max(s for _, s in lines)
        want = next(name for name, s in lines if s == score) if score >= license_scan.LINE_COSINE else None
        assert got[i]["line_license"] == want, i
        assert math.isclose(got[i]["line_score"], score if want else 0.0, abs_tol=2e-6)
    assert sum(r["line_license"] is not None for r in got.values()) == 4


NOTICE = "Released under the MIT License."


@pytest.mark.parametrize(("total", "with_notice"), [(1, 1), (3, 1), (3, 3), (200, 50), (200, 200)])
def test_an_exact_notice_is_found_at_any_frequency(spark, total, with_notice):
    docs = spark.createDataFrame([(i, f"file {i}\n" + (NOTICE if i < with_notice else "licensed to nobody") + "\nplain text under way") for i in range(total)], "doc_id long, text string")
    got = {r["key"]: (r["line_license"], r["line_score"]) for r in license_scan.scan(docs, "doc_id").collect()}
    assert all(got[i] == ("MIT", 1.0) for i in range(with_notice))
    assert all(got[i][0] is None for i in range(with_notice, total))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license bsd gnu zebra apple in and".split()), min_size=1, max_size=12), st.floats(0.1, 0.9))
def test_no_line_that_reaches_the_threshold_is_left_out(line, share):
    words = license_scan.vocabulary(license_scan.TEMPLATES)
    matcher = license_scan.Matcher(license_scan.TEMPLATES, 100, {w: int(100 * share) if w in (b"mit", b"the", b"released") else 3 for w in words})
    most, least = matcher.bounds(words)
    at = np.array([matcher.number.get(w.encode(), -1) for w in line])
    score = matcher.best(" ".join(line).encode())[1]
    assert license_scan.bounded(most[at], least[at], np.zeros(len(at), int), 1, score)[0] or score == 0


def test_a_named_licence_goes_before_reserved_rights(spark):
    texts = ["Copyright. All rights reserved.\nReleased under the MIT License.", "All rights reserved.\nno notice here", "Licensed under CC BY 4.0.\nAll rights reserved."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["key"]: r["line_license"] for r in license_scan.scan(docs, "doc_id").collect()} == {0: "MIT", 1: "Proprietary", 2: "CC-BY-4.0"}


GPL3_LINES = ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."]
BSD_LINES = ["Redistribution and use in source and binary forms, with or without", "modification, are permitted provided that the following conditions", "are met:"]
BSD3_LINES = ["3. Neither the name of Frob Inc. nor the names of its contributors may be", "   used to endorse or promote products derived from this software without", "   specific prior written permission."]
APACHE_LINES = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "   http://www.apache.org/licenses/LICENSE-2.0"]


def test_wrapped_headers_and_licence_texts_are_found(spark):
    hashed = lambda lines: "\n".join(f"# {x}" for x in lines)
    code = "import os\nvalue = os.getcwd()\n\n\ndef main():\n    return value\n"
    owner = ["Copyright (C) 2021 Frob Inc.", ""]
    mit = license_scan.TEXTS["MIT"][0]
    units = {
        "GPL-3.0": [hashed([*owner, *GPL3_LINES]) + "\n" + code, "/* frob.c\n\n   " + "\n   ".join(GPL3_LINES) + "  */\nint x;\n", "\n".join(f"REM {x}" for x in GPL3_LINES) + "\n" + code],
        "GPL-2.0": [hashed([x.replace("version 3", "version 2") for x in GPL3_LINES]) + "\n" + code],
        "BSD-2-Clause": ["/*\n" + "\n".join(f" * {x}" for x in BSD_LINES) + "\n */\nint x;\n"],
        "BSD-3-Clause": [hashed([*owner, *BSD_LINES, "", *BSD3_LINES]) + "\n" + code],
        "Apache-2.0": [hashed([*owner, *APACHE_LINES]) + "\n\n" + code],
        "MIT": ["Copyright (c) 2020 Frob\n\n" + mit, hashed(mit.split("\n")) + "\n" + code],
    }
    rows, want = [], {}
    for name, texts in units.items():
        for text in texts:
            want[len(rows)] = name
            rows.append((len(rows), text))
    first = len(rows)
    rows += [(first + i, text) for i, (_, (text,)) in enumerate(sorted(license_scan.TEXTS.items()))]
    rows += [(1000 + i, f"file {i} holds plain text\nand no notice for the {i}th of any such files\nin this or that program") for i in range(400)]
    got = {r["key"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    assert {i: got[i]["line_license"] for i in want} == want
    assert {i: got[i]["file_license"] for i in want if want[i] == "MIT"} == {i: "MIT" for i in want if want[i] == "MIT"}
    assert [got[first + i]["file_license"] for i in range(len(license_scan.TEXTS))] == sorted(license_scan.TEXTS)
    assert all(got[1000 + i]["line_license"] is None and got[1000 + i]["file_license"] is None for i in range(400))


COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def common_licences():
    folder = pathlib.Path("/usr/share/common-licenses")
    found = {name: (folder / name).read_text(errors="replace") for name in COMMON if (folder / name).exists()}
    if not found:
        pytest.skip("no licence files on this machine")
    return found


@pytest.mark.parametrize("without", [[], ["Artistic-1.0", "GFDL-1.2", "GFDL-1.3", "MPL-1.1"]])
def test_no_licence_file_has_a_false_name(spark, without):
    """Each is what it is; without its template it is nothing, not its nearest neighbour."""
    texts = {k: v for k, v in license_scan.TEXTS.items() if k not in without}
    plain = [(1000 + i, f"d/file{i}.txt", f"plain text number {i} of this or that program") for i in range(300)]
    files = common_licences()
    rows = [(i, f"{name}/LICENSE", text) for i, (name, text) in enumerate(sorted(files.items()))] + plain
    docs = spark.createDataFrame(rows, "k long, p string, text string")
    found = license_scan.scan(docs, "k", path_col="p", templates=license_scan.TEMPLATES, passages=license_scan.PASSAGES, texts=texts)
    got = {r["path"].split("/")[0]: (r["file_license"], r["license"]) for r in license_scan.inherit(found).filter("key < 1000").collect()}
    for name in files:
        want = COMMON[name]
        if want in without:
            assert got[name][0] is None, name
        else:
            assert got[name] == (want, want), name


def test_blocks_and_whole_texts_match_plain_cosines(spark):
    """The whole-text name and score of every row, by plain dictionaries, margins and lengths."""
    files = common_licences()
    texts = dict(enumerate([*files.values(), *[t[: len(t) // 3] for t in files.values()], *[t + " filler words" * 400 for t in files.values()], "nothing", ""]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["key"]: r for r in license_scan.scan(docs, "doc_id").collect()}
    split = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())
    templates = [(name, split(t)) for part in (license_scan.TEMPLATES, license_scan.PASSAGES, license_scan.TEXTS) for name, ts in part.items() for t in ts]
    words = {i: Counter(split(t)) for i, t in texts.items()}
    known = {w for _, t in templates for w in t} | set(license_scan.MARKS)
    idf = {w: 0.0 if w in license_scan.MARKS else math.log((len(texts) + 1) / (sum(w in x for x in words.values()) + 1)) + 1 for w in known}
    strange = math.log(len(texts) + 1) + 1
    length = lambda c: math.sqrt(sum((n * idf.get(w, strange)) ** 2 for w, n in c.items()))
    vectors = [(name, len(t), Counter(t)) for name, t in templates]
    for i, own in words.items():
        scores = sorted(((sum(n * c.get(w, 0) * idf.get(w, strange) ** 2 for w, n in own.items()) / (length(own) * length(c)) if own else 0.0, name, size) for name, size, c in vectors), key=lambda x: -x[0])
        top, name, size = scores[0]
        second = max(s for s, other, _ in scores if other != name)
        many = sum(own.values())
        named = top >= license_scan.FILE_COSINE and 2 * size <= 3 * many and 2 * many <= 3 * size and (top >= 0.95 or top - second >= 0.05)
        assert abs(got[i]["file_score"] - top) < 2e-6 and got[i]["file_license"] == (name if named else None), i
    assert sum(r["file_license"] is not None for r in got.values()) >= len(files)


def test_licence_inheritance_takes_the_nearest_ancestor(spark):
    rows = [
        ("a/LICENSE", "MIT", 0.9, None, 0.1),
        ("a/b/x.txt", None, 0.0, None, 0.0),
        ("a/b/LICENSE", "GPL-3.0", 0.8, "GPL-3.0", 0.8),
        ("a/b/c/y.txt", None, 0.0, None, 0.0),
        ("a/d/z.txt", "BSD-2-Clause", 0.9, None, 0.2),
        ("q/r.txt", None, 0.0, None, 0.0),
        (None, None, 0.0, None, 0.0),
    ]
    files = spark.createDataFrame(rows, "path string, line_license string, line_score double, file_license string, file_score double")
    got = {r["path"]: (r["license"], r["license_from"]) for r in license_scan.inherit(files).collect()}
    assert got == {"a/LICENSE": ("MIT", "header"), "a/b/x.txt": ("GPL-3.0", "inherited"), "a/b/LICENSE": ("GPL-3.0", "header"), "a/b/c/y.txt": ("GPL-3.0", "inherited"), "a/d/z.txt": ("BSD-2-Clause", "header"), "q/r.txt": (None, "none"), None: (None, "none")}


def test_inheritance_carries_a_real_share_of_the_rows(spark):
    rows = queries.op7_license_scan(spark, "/root/testdata/sf0.01").collect()
    folders = Counter(r["path"].rpartition("/")[0] for r in rows)
    assert len({x.count("/") for x in folders}) == 4
    best = {}
    for r in rows:
        folder, _, name = r["path"].rpartition("/")
        if r["file_license"] or (name == "LICENSE" and r["line_license"]):
            score = max(r["file_score"], r["line_score"])
            best[folder] = min(best.get(folder, (0, "", "")), (-score, r["path"], r["file_license"] or r["line_license"]))
    inherited = 0
    for r in rows:
        folder = r["path"].rpartition("/")[0]
        while folder and folder not in best:
            folder = folder.rpartition("/")[0]
        if not (r["line_license"] or r["file_license"]):
            near = {(-max(x["file_score"], x["line_score"]), x["file_license"] or x["line_license"]) for x in rows if x["path"].rpartition("/")[0] == folder and (x["file_license"] or x["path"].endswith("LICENSE") and x["line_license"])}
            want = {name for score, name in near if score == min(near)[0]} or {None}
            assert r["license"] in want, r["path"]
            inherited += r["license_from"] == "inherited"
    assert inherited > len(rows) / 20


# --- repeated substrings ---------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda x: bytes(b & 1 for b in x)), min_size=1, max_size=4))
def test_match_lengths_are_the_longest_matches_elsewhere(contexts):
    best, starts = suffix_dedup.match_lengths(contexts)
    tails = [(i, j, c[j:]) for i, c in enumerate(contexts) for j in range(len(c))]
    for i, j, tail in tails:
        most = 0
        for x, y, other in tails:
            if (x, y) != (i, j):
                n = next((k for k, (p, q) in enumerate(zip(tail, other, strict=False)) if p != q), min(len(tail), len(other)))
                most = max(most, n)
        assert best[starts[i] + j] == most


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=40).map(lambda x: bytes(b & 1 for b in x)), st.integers(1, 3), min_size=1, max_size=4))
def test_counted_copies_give_the_lengths_of_written_ones(copies):
    best, starts = suffix_dedup.match_lengths(list(copies), list(copies.values()))
    all_best, all_starts = suffix_dedup.match_lengths([c for c, many in copies.items() for _ in range(many)])
    first = 0
    for i, (context, many) in enumerate(copies.items()):
        for at in all_starts[first : first + many]:
            assert best[starts[i] : starts[i] + len(context)].tolist() == all_best[at : at + len(context)].tolist()
        first += many


def test_wide_anchors_give_the_same_spans(spark):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh"), 90))
    rows = [(i, "".join(rng.choice(list("xyz"), 40)) + passage + "".join(rng.choice(list("uvw"), 40))) for i in range(40)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = [(t or "").encode() for _, t in rows]
    want = {i: s for (i, _), s in zip(rows, suffix_dedup.brute_force(texts, 50), strict=True)}
    for most in (2, 4096):
        found = suffix_dedup.remove_repeats(docs, length=50, gram=8, wide_contexts=most).collect()
        assert {r["id"]: [tuple(s) for s in r["spans"]] for r in found} == want


# --- packing and pipeline --------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_the_plan_is_that_of_best_fit_over_items(histogram):
    plan = packing.best_fit_plan(histogram, 30)
    placed = defaultdict(list)
    for length, lo, hi, first, offset in plan:
        for r in range(lo, hi):
            placed[first + r - lo].append((offset, length))
    for own in placed.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 30
    rooms = []
    for length in sorted((n for n, many in histogram.items() for _ in range(many)), reverse=True):
        fit = min((r for r in rooms if r >= length), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((30 if fit is None else fit) - length)
    assert len(placed) == len(rooms)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage of the pipeline was given and returned."""
    pipeline = pytest.importorskip("corpus_pipeline")
    top = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{top}/{i}")
        made = spark.read.parquet(f"{top}/{i}")
        out[name] = (docs, made)
        docs = made
    return pipeline, out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns_of_documents(staged):
    pipeline, out = staged
    for name, _ in pipeline.STAGES[:-1]:
        assert out[name][0].columns == out[name][1].columns


def test_classifier_stage(spark, staged):
    docs, made = staged[1]["quality classifier"]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(made) == ids(quality.score(docs, model).filter(F.col("score") >= quality.THRESHOLD))
    assert 0 < made.count() < docs.count()


def test_line_stage(staged):
    docs, made = staged[1]["line dedup"]
    before = {r["doc_id"]: r for r in docs.collect()}
    sites = defaultdict(set)
    for r in before.values():
        for line in (r["text"] or "").split("\n"):
            sites[line].add(r["source"])
    gone = {line for line, own in sites.items() if line.strip(" ") and len(own - {None}) >= 10}
    for r in made.collect():
        text = before[r["doc_id"]]["text"]
        kept = text if text is None else "\n".join(line for line in text.split("\n") if line not in gone)
        assert r["text"] == kept
    assert ids(docs) == ids(made)


def test_near_duplicate_stage(staged):
    from test_llm import brute_components, word_sets

    docs, made = staged[1]["MinHash near-dedup"]
    want = brute_components(word_sets({r["doc_id"]: r["text"] or "" for r in docs.collect()}, 5))
    assert ids(made) == sorted(i for i, c in want.items() if i == c)


def test_mixing_stage(staged):
    pipeline, out = staged
    docs, made = out["mixing sources to target weights"]
    con = oracle.duckdb.connect()
    con.register("documents", docs.toPandas())
    assert ids(made) == sorted(r[0] for r in con.execute(mixing.oracle_sql(pipeline.MIX, queries.SOURCE_DOMAIN_SQL)).fetchall())


def test_packing_stage(staged):
    docs, made = staged[1]["best-fit packing"]
    encode = packing.encoder("byte_bpe_50k.tiktoken")
    sizes = {r["doc_id"]: len(encode(r["text"] or "")) // 4 + 1 for r in docs.collect()}
    found = Counter()
    for r in made.collect():
        found[r["doc_id"]] += r["length"]
    assert found == sizes


def test_pipeline_handles_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty, repeated and very long texts, an extra column of a clashing name."""
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, epoch int"
    rows = [(1, None, None, None, None, 7), (2, "", "en", "s1", 0, 7), (3, "a b c", "en", "s1", 5, 7), (3, "a b c", "en", "s1", 5, 7), (4, "word " * 60000, None, "s2", 9, None), (None, "no id", "de", "s3", 5, 1)]
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 0), (2, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    for name, data in (("odd", rows), ("empty", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    found = pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in found} <= {1, 2, 3, 4, None}


@pytest.mark.parametrize("name", ["op2_winnowing", "op5_mixing", "op7_license_scan"])
def test_odd_rows(spark, tmp_path, name):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s1", 0, "x"), (3, "a b c", "en", "s1", 5, "x"), (3, "a b c", "en", "s1", 5, "x"), (4, "word " * 60000, None, "s2", 9, None), (None, "no id", "de", "s3", 5, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, path string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(found) == len(rows) or name == "op5_mixing"
