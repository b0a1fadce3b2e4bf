"""Licence detection by sparse TF-IDF cosine to templates, and inheritance along directories.

A unit (a line, a block of lines, or the whole text) and a template are vectors of word counts
times inverse document frequency; the frequencies are counted over all
documents.  Every word weighs something, however common, so an exact notice has
cosine 1 in any table.  A line or block is compared with the templates if a bound
on its cosine reaches the threshold; the bound takes each word's largest share in
any template and a repeated word as distinct ones, so no unit that reaches the
threshold is left out.  Both passes are scans of whole texts; what is gathered is
one count per template word.

Where no line or block reaches the threshold there is no licence and its score is 0.

Blocks are the runs of lines in which a header may stand (see ``block_lines``);
comment marks are no words, so they weigh nothing.  Notices, headers and licence
texts are compared with lines and blocks, licence texts also with whole texts.

A file's own licence is that of its best line (``FALLBACK`` only if no other line or
block names a licence); or of the block whose template has
most words, if these are more than the line's template has.  A text that is a licence
as a whole (near to it by cosine and length, and clearly nearer than to any other)
has that one, whatever its lines say.  Directories take the licence of the licence file in them (best
score, then least path); a file without a licence of its own inherits from the
nearest ancestor directory that has one.  The join runs over distinct
directories and their ancestors, then over files by directory, so files of one
large directory add rows to the probe side only.

Defined cases: null and empty texts have no licence; a null path is at the root;
ties between templates go to the least name; repeated rows get equal results; an
empty table gives no rows; a very long text is held whole in one task, with some
tens of bytes per word; only key, path and text are read, so other columns cannot
clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch
from .license_passages import PASSAGES, TEXTS

# Notices by which works name their licence, after the public licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.", "This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3.", "This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
#: Says least, so it is a file's licence only where no line or block names another.
FALLBACK = "Proprietary"
LINE_COSINE = 0.75
BLOCK_COSINE = 0.75
FILE_COSINE = 0.6
#: Below the first, a whole text must be nearer to its licence than to any other by the second; and it has at most so many times the template's words, or fewer.
FILE_CLEAR, FILE_MARGIN, FILE_LENGTHS = 0.95, 0.05, 1.5
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|notice)(\.[a-z]+)?$"
MARKS = [b"dnl", b"rem"]  # comment marks made of letters
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
SCAN = "key long, path string, line_license string, line_score double, file_license string, file_score double"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def vocabulary(templates: dict[str, list[str]], marks: bool = False) -> list[bytes]:
    return sorted({w for texts in templates.values() for t in texts for w in words_of(t.encode())} | {w for w in MARKS if marks})


def merged(*parts: dict[str, list[str]]) -> dict[str, list[str]]:
    return {name: [t for p in parts for t in p.get(name, [])] for name in sorted(set().union(*parts))}


def word_hashes(words: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return kernels.spans_hash(kernels.prefix_sums(joined), np.concatenate([[0], ends[:-1]]), ends)


def chunk_words(data: np.ndarray, offsets: np.ndarray, known: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in the chunk) of all words, their numbers in the vocabulary (-1 if they are not in it), and their hashes."""
    base = offsets[0]
    text = kernels.LOWER[data[base : offsets[-1]]]
    solid = LETTERS[text]
    border = np.zeros(len(text) + 1, bool)
    border[offsets - base] = True
    before, after = np.ones(len(text) + 1, bool), np.ones(len(text) + 1, bool)
    before[1:], after[:-1] = ~solid, ~solid
    starts = np.flatnonzero(solid & (before[:-1] | border[:-1]))
    ends = np.flatnonzero(solid & (after[1:] | border[1:])) + 1
    hashes = kernels.spans_hash(kernels.prefix_sums(text), starts, ends)
    near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return starts, np.where(known[near] == hashes, order[near], -1), hashes


def line_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places (in the chunk) at which lines start; each row starts one, an empty last line is none."""
    own = offsets - offsets[0]
    starts = np.unique(np.concatenate([own[:-1], np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + 1]))
    return starts[starts < own[-1]]


def block_lines(text: np.ndarray, starts: np.ndarray, row_of: np.ndarray, n_words: np.ndarray, copyright: np.ndarray) -> np.ndarray:
    """(first line, line after the last) of every block of two or more lines.

    A block is a run of lines of a row without copyright lines that ends at the
    end of a comment (``*/`` or ``-->``).  It ends (1) at lines without words,
    (2) also where lines with a mark in front follow lines without one or the
    other way round, or (3) at empty lines and such changes only, so that a
    comment with empty comment lines is one block.
    """
    n = len(starts)
    solid = np.flatnonzero(~kernels.SPACES[text])
    if not len(solid):
        return np.zeros((0, 2), np.int64)
    at = np.searchsorted(solid, starts)
    first = solid[np.minimum(at, len(solid) - 1)]
    empty = (at == len(solid)) | (first >= np.append(starts[1:], len(text)))
    marked = ~LETTERS[kernels.LOWER[text[first]]]
    closes = np.zeros(n, bool)
    tail = np.flatnonzero((text[:-1] == ord("*")) & (text[1:] == ord("/")))
    arrow = np.flatnonzero((text[:-2] == ord("-")) & (text[1:-1] == ord("-")) & (text[2:] == ord(">")))
    closes[np.searchsorted(starts, np.concatenate([tail, arrow]), "right") - 1] = True
    edge = np.ones(n, bool)
    edge[1:] = (row_of[1:] != row_of[:-1]) | closes[:-1]
    turn = edge.copy()
    turn[1:] |= marked[1:] != marked[:-1]
    found = []
    for inside, cut in (((n_words > 0) & ~copyright, edge), ((n_words > 0) & ~copyright, turn), (~empty & ~copyright, turn)):
        begins = inside & (cut | ~np.append(False, inside[:-1]))
        which = np.cumsum(begins) - 1
        a = np.flatnonzero(begins)
        size = np.bincount(which[inside], minlength=len(a))
        found.append(np.stack([a, a + size], 1)[size > 1])
    return np.unique(np.concatenate(found), axis=0)


def document_frequencies(docs: DataFrame, text_col: str, words: list[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many contain each word of the vocabulary."""
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    known = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(len(words), np.int64), 0
        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(0))
            rows += batch.num_rows
            for lo, hi in kernels.row_chunks(offsets):
                place, word, _ = chunk_words(data, offsets[lo : hi + 1], known, order)
                place, word = place[word >= 0], word[word >= 0]
                row = np.searchsorted(offsets[lo : hi + 1] - offsets[lo], place, "right") - 1
                counts += np.bincount(np.unique(word + row * len(words)) % len(words), minlength=len(words))
        yield pa.RecordBatch.from_pydict({"word": pa.array([-1, *range(len(words))], pa.int32()), "n": pa.array([rows, *counts.tolist()], pa.int64())})

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per template word
    by = {r["word"]: r["n"] for r in found}
    return by.get(-1, 0), {w: by.get(i, 0) for i, w in enumerate(words)}


class Matcher:
    """Cosines of units of text to the templates under given document frequencies."""

    def __init__(self, templates: dict[str, list[str]], n_docs: int, df: dict[bytes, int], marks: bool = False) -> None:
        self.unknown = math.log(n_docs + 1) + 1
        self.words = vocabulary(templates, marks)
        self.number = {w: i for i, w in enumerate(self.words)}
        self.idf = np.array([math.log((n_docs + 1) / (df[w] + 1)) + 1 for w in self.words])
        self.idf[[self.number[w] for w in MARKS if w in self.number]] = 0.0
        self.names, self.sizes, vectors = [], [], []
        for name in sorted(templates):
            for text in templates[name]:
                vector = np.zeros(len(self.words))
                for w, n in Counter(words_of(text.encode())).items():
                    vector[self.number[w]] = n * self.idf[self.number[w]]
                if norm := math.sqrt(vector @ vector):
                    self.names.append(name)
                    self.sizes.append(len(words_of(text.encode())))
                    vectors.append(vector / norm)
        self.licence = np.array([sorted(set(self.names)).index(name) for name in self.names])
        #: What one occurrence of a word adds to the product with each template.
        self.gain = np.array(vectors).reshape(len(vectors), len(self.words)).T * self.idf[:, None]

    def best(self, unit: bytes) -> tuple[str | None, float]:
        return self.best_size(unit)[:2]

    def best_size(self, unit: bytes) -> tuple[str | None, float, int]:
        """Name and cosine of the nearest template, and how many words it has."""
        return self.nearest(unit)[:3]

    def nearest(self, unit: bytes) -> tuple[str | None, float, int, float]:
        """``best_size``, and the cosine of the nearest template of another licence."""
        counts = Counter(words_of(unit))
        at, times, strange = [], [], 0
        for w, n in counts.items():
            i = self.number.get(w)
            if i is None:
                strange += n * n
            else:
                at.append(i)
                times.append(n)
        if not at or not self.names:
            return None, 0.0, 0, 0.0
        n = np.array(times, float)
        norm = math.sqrt(((n * self.idf[at]) ** 2).sum() + strange * self.unknown**2)
        if not norm:
            return None, 0.0, 0, 0.0
        scores = n @ self.gain[at] / norm
        top = float(scores.max())
        i = int(np.flatnonzero(scores > top - 1e-12)[0])
        others = scores[self.licence != self.licence[i]]
        return (self.names[i], top, self.sizes[i], float(others.max(initial=0.0))) if top > 0 else (None, 0.0, 0, 0.0)

    def whole_text(self, unit: bytes, cosine: float) -> tuple[str | None, float]:
        """Name and cosine of the licence that a text is as a whole.

        The name is null below ``cosine``, where the text is much longer or shorter
        than the licence, and where it is about as near to another licence, as
        legal texts without a template are to several.
        """
        name, top, size, second = self.nearest(unit)
        many = len(words_of(unit))
        same = size <= FILE_LENGTHS * many and many <= FILE_LENGTHS * size
        return (name if top >= cosine and same and (top >= FILE_CLEAR or top - second >= FILE_MARGIN) else None), top

    def bounds(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For words numbered as in ``words`` (-1: any other): most that one adds to a product, least it adds to the squared norm."""
        most, least = np.zeros(len(words) + 1), np.full(len(words) + 1, self.unknown**2)
        for i, w in enumerate(words):
            if w in self.number:
                most[i] = self.gain[self.number[w]].max(initial=0.0)
                least[i] = self.idf[self.number[w]] ** 2
        return most, least


def bounded(most: np.ndarray, least: np.ndarray, unit: np.ndarray, n_units: int, cosine: float) -> np.ndarray:
    """Which units may reach ``cosine``, from what their words add (see ``Matcher.bounds``)."""
    product = np.bincount(unit, weights=most, minlength=n_units)
    square = np.bincount(unit, weights=least, minlength=n_units)
    return (product > 0) & (product >= (cosine - 1e-6) * np.sqrt(square))


def scan(
    docs: DataFrame,
    key_col: str,
    text_col: str = "text",
    path_col: str | None = None,
    templates: dict[str, list[str]] | None = None,
    line_cosine: float = LINE_COSINE,
    file_cosine: float = FILE_COSINE,
    passages: dict[str, list[str]] | None = None,
    texts: dict[str, list[str]] | None = None,
    block_cosine: float = BLOCK_COSINE,
) -> DataFrame:
    """(key, path, line_license, line_score, file_license, file_score): licence of the best line or block, and of the whole text.

    Given ``templates`` stand alone, unless ``passages`` (headers) and ``texts`` (whole licences) are given too.
    """
    own_templates = templates is not None
    templates = TEMPLATES if templates is None else templates
    passages = ({} if own_templates else PASSAGES) if passages is None else passages
    texts = ({} if own_templates else TEXTS) if texts is None else texts
    words = vocabulary(merged(templates, passages, texts), marks=True)
    n_docs, df = document_frequencies(docs, text_col, words)
    matcher = Matcher(merged(templates, passages), n_docs, df, marks=True)
    whole = Matcher(merged(templates, passages, texts), n_docs, df, marks=True)
    copyright_hash = word_hashes([b"copyright"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        known = hashes[order]
        most, least = matcher.bounds(words)
        seen: dict[bytes, tuple[str | None, float, int]] = {}

        def best_of(line: bytes) -> tuple[str | None, float, int]:
            """Licence, score and size of the template of a line; none below the threshold."""
            if line not in seen:
                if len(seen) > 50_000:
                    seen.clear()
                found = matcher.best_size(line)
                seen[line] = found if found[1] >= line_cosine else (None, 0.0, 0)
            return seen[line]

        for batch in batches:
            data, offsets = kernels.raw_text(batch.column(2))
            out: list[tuple] = [(None, 0.0, None, 0.0)] * batch.num_rows
            for lo, hi in kernels.row_chunks(offsets):
                own = offsets[lo : hi + 1]
                place, word, hashed = chunk_words(data, own, known, order)
                if not len(place):
                    continue
                starts = line_starts(data, own)
                ends = np.append(starts[1:], own[-1] - own[0])
                line_of = np.searchsorted(starts, place, "right") - 1
                possible = bounded(most[word], least[word], line_of, len(starts), line_cosine)
                row_of = np.searchsorted(own - own[0], starts, "right") - 1
                found: dict[int, tuple[str | None, float, int]] = {}
                for i in np.flatnonzero(possible).tolist():
                    name, score, size = best_of(data[own[0] + starts[i] : own[0] + ends[i]].tobytes())
                    r = int(row_of[i])
                    if name is not None and (r not in found or (name != FALLBACK, score) > (found[r][0] != FALLBACK, found[r][1])):
                        found[r] = name, score, size
                opening = np.flatnonzero(np.append(True, line_of[1:] != line_of[:-1]))
                copyright = np.zeros(len(starts), bool)
                copyright[line_of[opening[hashed[opening] == copyright_hash]]] = True
                blocks = block_lines(data[own[0] : own[-1]], starts, row_of, np.bincount(line_of, minlength=len(starts)), copyright)
                sums = [np.append(0.0, np.cumsum(np.bincount(line_of, weights=x[word], minlength=len(starts)))) for x in (most, least)]
                product, square = (x[blocks[:, 1]] - x[blocks[:, 0]] for x in sums)
                widest: dict[int, tuple[bool, int, float, str]] = {}
                for a, b in blocks[product >= (block_cosine - 1e-6) * np.sqrt(np.maximum(square, 0.0)) - 1e-6].tolist():
                    name, score, size = matcher.best_size(data[own[0] + starts[a] : own[0] + ends[b - 1]].tobytes())
                    r = int(row_of[a])
                    if score >= block_cosine and (r not in widest or (name != FALLBACK, size, score) > widest[r][:3]):
                        widest[r] = name != FALLBACK, size, score, name
                for r, (told, size, score, name) in widest.items():
                    if r not in found or (told, size) > (found[r][0] != FALLBACK, found[r][2]):
                        found[r] = name, score, size
                for r in np.unique(row_of[line_of[word >= 0]]).tolist():
                    line_name, line_top, _ = found.get(r, (None, 0.0, 0))
                    file_name, file_top = whole.whole_text(data[own[r] : own[r + 1]].tobytes(), file_cosine)
                    out[lo + r] = (line_name, round(line_top, 6), file_name, round(file_top, 6))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64()) * 2, strict=True))], names=["key", "path", "line_license", "line_score", "file_license", "file_score"])

    path = F.lit(None).cast("string") if path_col is None else F.col(path_col)
    return docs.select(F.col(key_col).cast("long").alias("key"), path.alias("path"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCAN)


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (path, line_license, line_score, file_license, file_score, ...) with license, license_score and license_from.

    license_from: header (a line or block), file (the whole text), inherited, or none.
    A text that is a licence as a whole has that one, whatever its lines name.
    """
    folder = F.regexp_extract(F.coalesce("path", F.lit("")), r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*)$", 1)
    placed = files.withColumn("__dir", folder)
    is_file = F.col("file_license").isNotNull() | (name.rlike(LICENSE_NAME) & F.col("line_license").isNotNull())
    named = placed.filter(is_file).select("__dir", F.coalesce("file_license", "line_license").alias("__license"), F.greatest("file_score", "line_score").alias("__score"), "path")
    best = named.groupBy("__dir").agg(F.min_by(F.struct("__license", "__score"), F.struct(-F.col("__score"), F.coalesce("path", F.lit("")))).alias("__best")).select(F.col("__dir").alias("__above"), "__best")
    dirs = placed.select("__dir").distinct()
    steps = F.when(F.col("__dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(F.split("__dir", "/"))), lambda i: F.array_join(F.slice(F.split("__dir", "/"), F.lit(1), i), "/"))))
    above = dirs.select("__dir", F.posexplode(steps).alias("__depth", "__above")).join(best, "__above")
    nearest = above.groupBy("__dir").agg(F.max_by("__best", "__depth").alias("__best"))
    joined = placed.join(nearest, "__dir", "left")
    own = F.when(F.col("line_license").isNotNull() & F.coalesce(F.col("file_license") == F.col("line_license"), F.lit(True)), F.struct("line_license", F.col("line_score"), F.lit("header"))).when(F.col("file_license").isNotNull(), F.struct(F.col("file_license").alias("line_license"), F.col("file_score").alias("line_score"), F.lit("file")))
    picked = F.coalesce(own, F.when(F.col("__best").isNotNull(), F.struct(F.col("__best.__license").alias("line_license"), F.col("__best.__score").alias("line_score"), F.lit("inherited"))), F.struct(F.lit(None).cast("string").alias("line_license"), F.lit(0.0).alias("line_score"), F.lit("none")))
    return joined.withColumn("__picked", picked).select(*files.columns, F.col("__picked").getField("line_license").alias("license"), F.col("__picked").getField("line_score").alias("license_score"), F.col("__picked").getField("col3").alias("license_from"))


def scan_tree(docs: DataFrame, key_col: str, path: Column, text_col: str = "text") -> DataFrame:
    """Scan and inheritance of documents that stand for the files of a tree."""
    return inherit(scratch.materialise(scan(docs.withColumn("__path", path.cast("string")), key_col, text_col, path_col="__path"), "license-scan"))
