"""Removal of repeated passages against an oracle that shares no code with the operator, and on planted passages."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lumentrove.llm import queries

SF = "/root/testdata/sf0.01"
WIDTH = 400


def doubled(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Per text the mask of bytes that go; windows are named by pairs of names of half windows, so no hash is involved."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    names = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    left = np.repeat(starts[1:], sizes) - np.arange(len(names))  # bytes to the end of the text
    length = 1
    while length < width:
        step = min(length, width - length)
        other = np.concatenate([names[step:], np.zeros(min(step, len(names)), np.int64)])[: len(names)]
        pair = names * (other.max() + 1) + other
        pair[left < length + step] = -1 - np.arange((left < length + step).sum())
        names = np.unique(pair, return_inverse=True)[1]
        length += step
    whole = np.flatnonzero(left >= width)
    _, at, many = np.unique(names[whole], return_inverse=True, return_counts=True)
    twice = whole[many[at] > 1]
    edge = np.zeros(len(names) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    return [gone[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def digest_of(text: bytes, gone: np.ndarray) -> tuple:
    runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


def found(spark, sf_dir: str) -> dict:
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op8_suffix_dedup(spark, sf_dir).collect()}


def table() -> dict[int, bytes]:
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(t["doc_id"].to_pylist(), [(x or "").encode() for x in t["text"].to_pylist()], strict=True))


def test_the_oracle_agrees_with_a_dictionary_of_windows():
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 100, 30).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() + passage * m for n, m in ((0, 0), (3, 1), (40, 0), (25, 2), (9, 1))]
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - 7):
            seen.setdefault(t[j : j + 8], []).append((i, j))
    want = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for i, j in places if len(places) > 1 else []:
            want[i][j : j + 8] = True
    assert all((a == b).all() for a, b in zip(doubled(texts, 8), want, strict=True))


def test_all_documents_agree_with_the_oracle(spark):
    texts = table()
    masks = doubled(list(texts.values()), WIDTH)
    want = {i: digest_of(t, m) for (i, t), m in zip(texts.items(), masks, strict=True)}
    assert found(spark, SF) == want and sum(m.any() for m in masks) > 50


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    """300 clean texts of random words, and passages of several lengths planted once in each of several others."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10))))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, prose(int(rng.integers(60, 200)))) for i in range(300)]
    places = {}
    for words in (50, 60, 75, 100, 250):
        for copies in (2, 5, 50):
            passage = prose(words)
            for _ in range(copies):
                before = prose(int(rng.integers(1, 90)))
                places[len(rows)] = (len(before) + 1, len(passage), copies)
                rows.append((len(rows), f"{before} {passage} {prose(int(rng.integers(1, 90)))}"))
    path = tmp_path_factory.mktemp("planted")
    return path, rows, places


def test_planted_passages_go_whole_and_clean_texts_stay(spark, planted):
    path, rows, places = planted
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = found(spark, str(path))
    for i, text in rows:
        at, size, _ = places.get(i, (0, 0, 0))
        if size >= WIDTH:
            # Chance may add a byte or two where the texts around two copies go on alike.
            assert got[i][2] == 1 and size <= got[i][1] <= size + 8, (i, size, got[i])
        else:
            assert got[i][1] == 0 and got[i][3] == hashlib.sha256(text.encode()).hexdigest()
    assert sum(s >= WIDTH for _, s, _ in places.values()) >= 150
