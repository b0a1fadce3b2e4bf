"""Spelling variants of words by anagram hashing.

A word's key is the sum of a power of each of its letters, a number that does
not depend on their order (Reynaert's anagram hashing).  Words that differ by one
letter have keys that differ by one letter's value, or by the exchange of one
value for another.  Both are met by the keys that a word has after taking out one
letter: taking out a letter of the longer word gives the key of the shorter one,
and an exchange gives two words one key.  So a word makes a row for each of its
places, and never one for each letter of the alphabet.

(1) Texts are scanned once and words counted, combined in the map tasks.  (2)
Keys alone are counted; rows whose key no other word has go.  (3) Of the rest the
letter order is verified: words of one key whose remaining letters are equal and
lack the same place form a group, which has at most one word for each letter of
the alphabet, however many anagrams share the key; and the remaining letters are
looked up among the words themselves.  Each row so learns how many words are near
and which of them is most frequent, and no list of pairs is made.  (4) A word's
rows are added up, and forms are followed to their roots by doubling.

Words are anagram groups of any size; no bucket is capped, and a word that a third
of all texts have is one row.

Defined cases: null text has no words, and an empty one none; a null id counts as
the empty string in the typing-error rule; repeated rows count again; equally
frequent near words: the first in code-point order; an empty table gives no rows;
a very long run of letters is a word like any other (its key is taken modulo
2**61).  Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

# What a word is, and which of them count.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
TYPO_EVERY = 199
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
POWER = 5
MODULUS = 1 << 61


def lowered(text: Column) -> Column:
    return F.translate(text, CAPITALS, CAPITALS.lower())


def cut(word: Column, place: Column) -> Column:
    """``word`` without the letter at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n) of the words of all texts; one run in ``typo_every``, by its hash, has lost a letter."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered(F.col(text_col).cast("string")), F.lit(RUN), F.lit(0))).alias("run"))
    # A shorter run has too few letters with or without its loss.
    hashed = runs.filter(F.length("run") >= least_letters).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    lost = cut(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    words = hashed.select(F.when(F.col("h") % typo_every == 0, lost).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def letter_value(letter: Column) -> Column:
    return F.pow(F.ascii(letter).cast("double"), F.lit(float(POWER))).cast("long")  # below 2**53, so exact


def places(words: DataFrame) -> DataFrame:
    """(word, n, key, place, rest_key): a row per place of each word, with the word's key and its key without that letter."""
    values = F.transform(F.split("word", ""), letter_value)
    keyed = words.withColumn("values", values).withColumn("key", F.aggregate("values", F.lit(0).cast("long"), lambda acc, v: (acc + v) % MODULUS))
    return keyed.select("word", "n", "key", F.posexplode("values").alias("place", "value")).select("word", "n", "key", "place", F.pmod(F.col("key") - F.col("value"), F.lit(MODULUS)).alias("rest_key"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(rest_key) that meet another word: as its own key, or as its key after taking out a letter."""
    taken = rows.groupBy("rest_key").agg(F.min("word").alias("x"), F.max("word").alias("y"))
    whole = rows.filter("place = 0").select(F.col("key").alias("rest_key")).distinct()
    return taken.filter("x <> y").select("rest_key").union(taken.select("rest_key").join(whole, "rest_key", "left_semi")).distinct()


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, best): the number of near words and the most frequent one as struct (less, word), less being -n."""
    rows = places(words)
    met = rows.join(shared_keys(rows), "rest_key", "left_semi").withColumn("rest", cut(F.col("word"), F.col("place")))
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    # Exchange: equal key, equal letters around the same place.  At most one word per letter of the alphabet.
    groups = met.groupBy("rest_key", "rest", "place").agg(F.sort_array(F.collect_list(own)).alias("members")).filter(F.size("members") > 1)
    exchanged = groups.select(F.explode("members").alias("own"), "members").select(F.col("own.word").alias("word"), (F.size("members") - 1).cast("long").alias("near"), F.when(F.col("members")[0]["word"] == F.col("own.word"), F.col("members")[1]).otherwise(F.col("members")[0]).alias("best"))
    # Removal and addition: what is left is a word itself.  Taking out either of two equal neighbours leaves the same.
    known = words.select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    shorter = met.select("word", "n", F.col("rest").alias("short")).distinct().join(known, "short")
    both = F.array(F.struct(F.col("word"), F.struct((-F.col("short_n")).alias("less"), F.col("short").alias("word")).alias("best")), F.struct(F.col("short").alias("word"), own.alias("best")))
    changed = shorter.select(F.explode(both).alias("pair")).select("pair.word", F.lit(1).cast("long").alias("near"), "pair.best")
    found = exchanged.unionByName(changed).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms.

    Along a chain counts grow at least ``TIMES``-fold, so it is no longer than their
    logarithm and has no cycle; each round doubles the way gone.
    """
    now = scratch.materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = scratch.materialise(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        scratch.release(now)
        now = new.select("word", "root")
        now.scratch_path = new.scratch_path
        if new.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word with the near word that is at least ``times`` as frequent, if there is one."""
    words = scratch.materialise(word_counts(docs, id_col, text_col, least_letters, least_count, typo_every), "spelling-words")
    near = near_words(words)
    clear = -F.col("best.less") >= times * F.col("n")
    told = scratch.materialise(near.select("word", "n", "n_near", F.when(clear, F.col("best.word")).alias("form"), F.when(clear, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle_sql() -> str:
    """DuckDB SQL for ``variants``; the hash is computed bit by bit, and pairs are found by their common letters, without keys."""
    lower = f"translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}')"
    step = "CASE WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END"
    return rf"""
WITH RECURSIVE o AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({lower}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS times FROM o WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
y AS (SELECT *, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 + (ord(c) >> 6))::BIGINT, (128 + (ord(c) & 63))::BIGINT] END)) AS octets FROM u),
h AS (SELECT run, times, xor(list_reduce(octets, lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda acc, i: {step}, xor(crc, b)), 4294967295::BIGINT), 4294967295) AS h FROM y),
w AS (SELECT CASE WHEN h % {TYPO_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM h),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}),
p AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v) AS x),
e AS (SELECT a.word, b.word AS other, b.n AS other_n FROM p AS a JOIN p AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT p.word, v.word, v.n FROM p JOIN v ON p.rest = v.word
      UNION SELECT v.word, p.word, p.n FROM p JOIN v ON p.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM e GROUP BY 1),
f AS (SELECT v.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {TIMES} * n THEN best END AS form, CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS goal, 0 AS far FROM f UNION ALL SELECT c.word, f.form, far + 1 FROM c JOIN f ON c.goal = f.word WHERE f.form IS NOT NULL),
r AS (SELECT word, arg_max(goal, far) AS root FROM c GROUP BY 1)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN r USING (word)
"""
