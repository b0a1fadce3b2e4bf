"""Spelling variants against all pairs by plain Python, and their SQL."""

import random
import re
import zlib
from collections import Counter

import oracle
import pytest
from pyspark.sql import functions as F

from lumentrove.llm import queries, spelling

SF = "/root/testdata/sf0.01"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def plain_words(rows: list[tuple]) -> Counter:
    found: Counter = Counter()
    for ident, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return Counter({w: n for w, n in found.items() if len(w) >= 6 and n >= 5})


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words: Counter) -> dict:
    out = {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v.encode("utf-32-be")), default=None)
        out[w] = [best if best and words[best] >= 5 * n else None, n, len(near)]
    for w, row in out.items():
        end = w
        while out[end][0]:
            end = out[end][0]
        row.append(end)
    return out


def as_rows(df) -> dict:
    return {r["word"]: [r["form"], r["n"], r["n_near"], r["root"]] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_are_those_of_all_pairs(spark, seed):
    """Words of few letters, so that anagrams, exchanges, losses and repeated letters abound."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÉé") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    weight = [rng.choice([1, 2, 12, 70]) for _ in stems]
    rows = []
    for i in range(120):
        picks = rng.choices(stems, weight, k=60)
        for _ in range(15):
            j, w = rng.randrange(60), rng.choice(stems)
            at = rng.randrange(len(w))
            picks[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w.upper()])
        rows.append((i if i % 9 else None, " ".join(picks)))
    rows.append((500, "chainaa " * 6 + "chainab " * 35 + "chainbb " * 180))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = spelling.variants(docs)
    want = plain_variants(plain_words(rows))
    assert as_rows(got) == want and got.columns == list(COLUMNS)
    assert sum(1 for r in want.values() if r[0]) > 5 and any(r[0] and want[r[0]][0] for r in want.values()) and max(r[2] for r in want.values()) > 2
    assert all(r["form_n"] == (want[r["form"]][1] if r["form"] else None) for r in got.collect())


def test_chains_are_followed_to_their_end(spark):
    words = ["abcdef", "abcdeg", "abcdhg", "abczhg", "abyzhg", "xbyzhg"]
    forms = spark.createDataFrame(list(zip(words[:-1], words[1:], strict=True)), "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, words[-1]) for w in words[:-1]}
    assert spelling.roots(forms.filter("false")).count() == 0


def test_keys_do_not_depend_on_order_nor_overflow(spark):
    long = "ÿ" * 3000
    words = spark.createDataFrame([("listen", 5), ("silent", 5), (long, 7), (long[:-1], 50), (long[1:] + "þ", 5)], "word string, n long")
    keys = {r["word"]: r["key"] for r in spelling.places(words).select("word", "key").distinct().collect()}
    assert keys["listen"] == keys["silent"] == sum(ord(c) ** 5 for c in "listen")
    got = {r["word"]: (r["n_near"], r["best"] and -r["best"]["less"]) for r in spelling.near_words(words).collect()}
    assert got == {"listen": (0, None), "silent": (0, None), long: (2, 50), long[:-1]: (2, 7), long[1:] + "þ": (2, 50)}


def test_a_word_that_all_texts_have_and_many_anagrams(spark):
    """5040 anagrams are one key: no pair of them is near, and none is made."""
    from itertools import permutations

    text = " ".join("".join(p) for p in permutations("abcdefg"))
    docs = spark.range(5).select(F.col("id").alias("doc_id"), F.lit(text + " common" * 2000).alias("text"))
    got = as_rows(spelling.variants(docs, typo_every=1 << 40))
    assert len(got) == 5041 and got["common"] == [None, 10_000, 0, "common"] and all(r[2] == 0 for r in got.values())
    met = spelling.places(spark.createDataFrame([(w, 5) for w in text.split()], "word string, n long"))
    assert met.select("key").distinct().count() == 1 and spelling.shared_keys(met).count() == 7


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "étranger " * 9 + "Étranger " * 9, "y"), (2, "abcdef1abcdef_abcdef-abcdefÿ abcdef×x", "z"), (2, "abcdef abcdef abcde", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").withColumns({"key": F.lit(1), "n": F.lit(2), "id": F.lit(3)})
    assert as_rows(spelling.variants(docs)) == plain_variants(plain_words([r[:2] for r in rows]))
    assert spelling.variants(docs.filter("false")).count() == 0


def test_query_matches_sql(spark):
    assert not oracle.differences(queries.op12_spelling_variants(spark, SF), oracle.connect(SF), queries.ORACLE_SQL["op12_spelling_variants"])
