"""The filter audit against plain Python, order by order and document by document, and its SQL."""

import random
from collections import Counter
from itertools import permutations

import oracle
from pyspark.sql import functions as F

from lumentrove.llm import audit, queries

SF = "/root/testdata/sf0.01"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failures(row: tuple, rows: list[tuple]) -> str:
    ident, text, _ = row
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    copy = ident is not None and any(i is not None and i < ident and (t or "") == text for i, t, _ in rows)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text), copy)
    return "".join(name for name, failed in zip("ABCDE", tests, strict=True) if failed)


def plain_audit(rows: list[tuple], labels: list[tuple]) -> dict:
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = [failures(r, rows) for r in rows]
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed, strict=True) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                out[part, "".join(order), step] = [len(left), len(removed), sum(letter in f for _, f in mine) - len(removed), sum(f == letter for _, f in mine), sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed)]
                shapley[part, letter] += len(removed)
    for (part, order, step), row in out.items():
        row.append(shapley[part, order[step - 1]])
    return out


def as_rows(df) -> dict:
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in df.collect()}


def odd_rows() -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(5)
    rows = []
    for i in range(150):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "x#y", "delta"]) if rng.random() < 0.2 else f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 199, 200, 260]))]
        text = rng.choice([" ", "\t", "\x0b \n"]).join(words)
        rows.append((i, rng.choice([text, text, rows[rng.randrange(len(rows))][1] if rows else text, "repeat " * 200, "word A " * 100, "", None]), rng.choice(["en", "de", None, ""])))
    rows += [(7, "twice", "en"), (7, "twice", "en"), (7, "twice", "de"), (9, "twice", "en"), (None, "twice", "en"), (None, "twice", None), (None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 170, 2)] + [(8, 1, None), (8, 0, 1), (None, 1, 1)]
    return rows, labels


def test_audit_is_that_of_plain_filtering(spark):
    rows, labels = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("x"), "mask": F.lit("y"), "id": F.lit(1)})
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(1), "lang": F.lit("z")})
    got, want = as_rows(audit.interactions(docs, told)), plain_audit(rows, labels)
    assert got == want and {k[0] for k in got} == {"", "en", "de"} and len(got) == 3 * 600
    assert all(sum(v[i] for v in got.values()) > 0 for i in range(len(COUNTS)))


def test_limits_are_exact(spark):
    at = {"capitals": "A" * 3 + "b" * 97, "more capitals": "A" * 4 + "b" * 96, "half": " ".join(f"w{i % 100}" for i in range(200)), "less": " ".join(f"w{i % 99}" for i in range(200)), "no-break space": "a b " * 199, "smile": "😀" * 97 + "ABC"}
    docs = spark.createDataFrame([(i, t, name) for i, (name, t) in enumerate(at.items())], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["part"]: r["mask"] for r in audit.cells(docs, none).collect()}
    assert got == {"capitals": 1, "more capitals": 1 + 4, "half": 0, "less": 2, "no-break space": 1 + 2, "smile": 1}


def test_empty_table_and_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 400_000, "en"), (2, "word " * 400_000, "en")], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs.filter("false"), none).count() == 0
    assert {r["mask"]: r["n"] for r in audit.cells(docs, none).collect()} == {2: 1, 2 + 16: 1}


def test_query_matches_sql(spark):
    assert not oracle.differences(queries.op13_filter_audit(spark, SF), oracle.connect(SF), queries.ORACLE_SQL["op13_filter_audit"])
