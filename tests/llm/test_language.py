"""Language identification against plain parsing, and its defined cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentrove.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain_phrases(text: bytes, learned: bytes, piece: int) -> int:
    """Longest matches one after the other, by searching the learned text."""
    n = 0
    for first in range(0, len(text), piece):
        part, at = text[first : first + piece], 0
        while at < len(part):
            size = 1
            while at + size < len(part) and b"\n" not in part[at : at + size + 1] and part[at : at + size + 1] in learned:
                size += 1
            n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("seed", range(6))
def test_phrases_are_those_of_plain_searching(seed):
    rng = random.Random(seed)
    word = lambda letters: bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
    learned = {"a": word(b"ab "), "b": word(b"abc") + b"\n" + word(b"bcd "), "c": b"z"}
    texts = [word(b"abcde "), b"", word(b"ab") * 5, word(b"xyz"), b"z" * 90]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    own = language.CrossParser(learned)
    for piece in (7, 64, 2048):
        assert own.phrases(data, offsets, piece).tolist() == [[plain_phrases(t, learned[name], piece) for t in texts] for name in own.names]


def test_automaton_has_all_substrings_and_no_other():
    text = b"abcbcabcbbca"
    ahead = language.suffix_automaton(text)

    def strings(state: int, prefix: bytes) -> set[bytes]:
        return {prefix}.union(*[strings(goal, prefix + bytes([c])) for c, goal in ahead[state].items()])

    assert strings(0, b"") == {text[i:j] for i in range(len(text) + 1) for j in range(i, len(text) + 1)}
    assert len(ahead) <= 2 * len(text)


def test_whole_query_is_recomputed(spark):
    """Every prediction and score of the query from its learned texts, by plain searching (short texts), and held-out accuracy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.fit(docs)
    assert sorted(learned) == ["de", "en", "es", "fr"] and all(10_000 < len(t) <= language.LANGUAGE_BYTES for t in learned.values())
    got = {r["doc_id"]: r for r in queries.op11_language_id(spark, SF).collect()}
    rows = docs.select("doc_id", "lang", "n_chars", language.letters(F.col("text")).alias("t")).collect()
    assert len(got) == len(rows)
    short = [r for r in rows if r["n_chars"] < 300][:40]
    assert len(short) == 40
    for r in short:
        data = r["t"].encode()
        bits = {name: plain_phrases(data, text, language.PIECE) * math.log2(1 + len(text)) for name, text in learned.items()}
        best = min(bits, key=lambda name: (bits[name], name))
        assert got[r["doc_id"]]["lang_pred"] == best
        assert abs(got[r["doc_id"]]["score"] - 1 / sum(2 ** max(-60, bits[best] - b) for b in bits.values())) < 1e-6
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(held) > 200 and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.99 * len(held)


def test_learning_leaves_out_held_out_rows_and_null_languages(spark):
    rows = [(i, f"text{'abcdefghij'[i % 10]} more words", None if i % 5 == 0 else "xx") for i in range(60)] + [(None, "nameless", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", language.fold(F.col("doc_id")).alias("f")).collect()}
    learned = language.fit(docs, rows=1000, row_bytes=100)
    want = sorted(f"text{'abcdefghij'[i % 10]} more words".encode() for i in range(60) if folds[i] != 2 and i % 5)
    assert list(learned) == ["xx"] and sorted(set(learned["xx"].split(b"\n"))) == sorted(set(want))
    assert len(language.fit(docs, rows=3)["xx"].split(b"\n")) == 3 and len(language.fit(docs, language_bytes=10)["xx"]) == 10


def test_odd_rows_and_clashing_columns(spark):
    learned = {"one": "the cat sat on the mat and the dog".encode(), "two": "der hund und die katze der mann".encode()}
    rows = [(1, None, "x"), (1, "", "x"), (2, "12 !? \n", "x"), (None, "der Hund", "x"), (3, "THE CAT", "x"), (3, "THE CAT", "x"), (4, "the cat sat " * 200_000, "x"), (5, "кот", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumns({"row": F.lit(1), "lang_pred": F.lit("old"), "_1": F.lit(2)})
    out = language.identify(docs, learned)
    assert out.columns == ["doc_id", "text", "row", "_1", "lang_pred", "score"]
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["score"]) for r in out.drop("text").collect()), key=str)
    assert [g[:2] for g in got] == [(0, "two"), (1, "und"), (1, "und"), (2, "und"), (3, "one"), (3, "one"), (4, "one"), (5, "two")]
    assert all(0 <= s <= 1 for *_, s in got) and all(s == 0 for _, lang, s in got if lang == "und") and got[7][2] < 0.9
    assert {r["lang_pred"] for r in language.identify(docs, {}).collect()} == {"und"}
    none = docs.filter("false").withColumn("lang", F.lit("en"))
    assert language.fit(none) == {} and language.identify(none, learned).count() == 0
