"""License notices in documents: winnowed fingerprints, then alignment.

Templates and documents are read as word sequences.  Their word trigrams
are winnowed: of every ``window`` consecutive trigram hashes the smallest
is kept, so two texts that share ``window + 2`` words in a row are sure to
share a fingerprint.  A template that the allowed edits can break into
shorter runs is looked up by all its trigrams, or bigrams where they can
leave no trigram.  The templates' fingerprints form a small inverted
index (its size is that of the templates, a parameter).  A document's
fingerprints looked up in it give candidates: a template and the diagonal
its words would lie on.  A banded alignment around the diagonal then
counts the matched words, which gives the coverage and the exact span.

An alignment only reads the stretch of the document the diagonal allows,
and a document is worked on whole, wherever in it the notice stands.  A
long template, a license's body, is looked for in sections; the sections
that are found one after the other make up its coverage and span.  A
section counts as a candidate only where as many of its trigrams are close
to a diagonal as the allowed edits must leave, so that phrases of everyday
language start no alignment.

The notices below are the default; ``read_templates`` takes others, bodies
included, from a folder with a file per license.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

# --- fixed values: notices of well-known licenses, as they are published ---
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you "
     "may not use this file except in compliance with the License. You may "
     "obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under "
     "the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES "
     "OR CONDITIONS OF ANY KIND, either express or implied."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, "
                "version 2."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public "
                 "License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public "
                 "License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public "
                 "License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the "
                "Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this "
            "software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission "
            "notice appear in all copies."),
    ("GPL-2.0-header",
     "This program is free software: you can redistribute it and/or modify "
     "it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 2 of the License, or (at "
     "your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, "
                "version 3."),
    ("GPL-3.0-header",
     "This program is free software: you can redistribute it and/or modify "
     "it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at "
     "your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT-header",
     "Permission is hereby granted, free of charge, to any person obtaining "
     "a copy of this software and associated documentation files (the "
     "\"Software\"), to deal in the Software without restriction, including "
     "without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so."),
    # the line that all BSD licenses share
    ("BSD",
     "Redistribution and use in source and binary forms, with or without "
     "modification, are permitted provided that the following conditions "
     "are met:"),
    ("All-rights-reserved", "All rights reserved."),
)
# Words that tell a notice from its relatives: each must stand in the span
# as it is, without a word between.
KEYS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("apache license", "2.0"),
    "Apache-2.0-header": ("apache license", "2.0"),
    "CC-BY-4.0": ("cc by 4.0",), "CC-BY-NC-4.0": ("cc by nc 4.0",),
    "CC-BY-SA-4.0": ("cc by sa 4.0",), "CC-BY-ND-4.0": ("cc by nd 4.0",),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",),
    "GPL-2.0": ("gnu general public license", "version 2"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "GPL-2.0-header": ("gnu general public license", "version 2"),
    "GPL-3.0-header": ("gnu general public license", "version 3"),
    "LGPL-2.1": ("gnu lesser general public license", "version 2.1"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3"),
    "AGPL-3.0": ("gnu affero general public license", "version 3"),
    "MPL-2.0": ("mozilla public license", "2.0"), "MIT": ("mit",),
}
# --- end of fixed values ---


@dataclass(frozen=True)
class LicenseParams:
    """``coverage``: least share of a template's words that must match.
    ``band``: words that may be missing or extra on either side.
    ``section``: words of a section of a long template (one of more than
    twice as many)."""

    section: int = 80
    gram: int = 3
    window: int = 4
    band: int = 6
    coverage: float = 0.8


@dataclass
class _Index:
    """The templates' words and their fingerprints, sorted by hash."""

    names: list[str]
    words: list[np.ndarray]
    hashes: np.ndarray
    template: np.ndarray
    offset: np.ndarray
    short: list[bool]       # edits can leave no run that winnowing keeps
    widths: list[int]       # words of a gram, per template
    keys: list[list[np.ndarray]]    # words that must stand as they are
    votes: list[int]        # grams near a diagonal that a match must have
    part: list[tuple[int, int] | None]  # (license, section) of a section
    bodies: list[tuple[str, int]]       # (license, words) of long templates


def _words(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    h, _ = C.word_hashes(data, np.array([0, len(data)]), C.ALNUM_WORDS)
    return h


def _grams(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each word on."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.uint64)
    g = h[:n].copy()
    for k in range(1, width):
        g = C.mix(g) + h[k:k + n]
    return C.mix(g)


def _winnow(g: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the smallest of some window (the last one of
    equal hashes); all of them when there are fewer than a window."""
    n = len(g) - window + 1
    if n < 1:
        return np.arange(len(g)) if len(g) else np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, window)[:, ::-1]
    return np.unique(np.arange(n) + window - 1 - view.argmin(axis=1))


def _run(m: int, p: LicenseParams) -> int:
    """Words in a row that stay of a template of ``m`` whatever words are
    changed or missing within the coverage, and with one extra word."""
    keep = max(1, math.ceil(p.coverage * m - 1e-9))
    return -(-keep // (m - keep + 2))


def _votes(m: int, width: int, p: LicenseParams) -> int:
    """Grams of a template of ``m`` words that any match has within the
    band of one diagonal: each word changed, missing or extra takes as many
    as a gram has words beside it."""
    keep = max(1, math.ceil(p.coverage * m - 1e-9))
    breaks = (m - keep) + 2 * p.band + 1
    return max(1, keep - (width - 1) * breaks)


def _index(templates: Sequence[tuple[str, str]], p: LicenseParams) -> _Index:
    names, words, keys, part, bodies = [], [], [], [], []
    for name, text in templates:
        w = _words(text.encode())
        if len(w) <= 2 * p.section:
            cuts = [0, len(w)]
            keys.append([_words(k.encode()) for k in KEYS.get(name, ())])
            part.append(None)
        else:
            n = len(w) // p.section
            cuts = [len(w) * k // n for k in range(n + 1)]
            keys += [[]] * n
            part += [(len(bodies), k) for k in range(n)]
            bodies.append((name, len(w)))
        for x, y in zip(cuts, cuts[1:]):
            names.append(name)
            words.append(w[x:y])
    hashes, template, offset = [], [], []
    widths = [max(1, min(p.gram, _run(len(w), p))) for w in words]
    for i, w in enumerate(words):
        g = _grams(w, widths[i])
        # every gram of the few templates: a document's fingerprint finds
        # its place whatever the words around the notice are
        hashes.append(g)
        template.append(np.full(len(g), i))
        offset.append(np.arange(len(g)))
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.argsort(h, kind="stable")
    return _Index(names, words, h[order],
                  np.concatenate(template)[order] if hashes else h,
                  np.concatenate(offset)[order] if hashes else h,
                  [_run(len(w), p) < p.window + p.gram - 1 for w in words],
                  widths, keys, [_votes(len(w), k, p) for w, k in zip(
                      words, widths, strict=True)], part, bodies)


# Templates are sent to every task.
TEMPLATE_BYTES = 16 << 20


def read_templates(spark: SparkSession, folder: str
                   ) -> list[tuple[str, str]]:
    """(name, text) of the files of a folder: a license each, named by its
    file without the ending; several files of one license (a body and its
    headers) have its name before a ``+``.  Templates are a parameter, sent
    to every task; more than TEMPLATE_BYTES of them are refused."""
    files = spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_name").alias("name"), "value")
    size = files.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{folder} has {size} bytes of templates, more "
                         f"than {TEMPLATE_BYTES}")
    rows = files.orderBy("name").collect()
    return [(r["name"].rsplit(".txt", 1)[0].split("+", 1)[0], r["value"])
            for r in rows]


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int
          ) -> tuple[int, int, int]:
    """Longest common subsequence of the template and ``text`` within
    ``band`` of the diagonal: matched words and their span [first, last).

    Of the ways to match as many words the one with the shortest span is
    taken, and of these the first."""
    m = len(template)
    # best[d]: (matched, -first, last) of paths that end on diagonal d
    best = [(0, 0, 0)] * (2 * band + 1)
    top = (0, 0, 0)
    for i in range(m):
        new = list(best)
        for d in range(2 * band + 1):
            j = i + diagonal + d - band
            if 0 <= j < len(text) and text[j] == template[i]:
                n, first, _ = best[d]
                new[d] = max(new[d], (n + 1, first if n else -j, j + 1))
        # a text word more or less moves to the next diagonal
        for d in range(1, 2 * band + 1):
            if new[d - 1][0] > new[d][0]:
                new[d] = new[d - 1]
        for d in range(2 * band - 1, -1, -1):
            if new[d + 1][0] > new[d][0] and new[d + 1][2] <= (
                    i + 1 + diagonal + d - band):
                new[d] = new[d + 1]
        best = new
        for x in best:
            if x[0] > top[0] or x[0] == top[0] and x[0] and (
                    x[2] + x[1] < top[2] + top[1]):
                top = x
    return top[0], -top[1], top[2]


MATCH_SCHEMA = ("doc_id long, n_words long, license array<string>, "
                "matched array<int>, coverage array<double>, "
                "first array<int>, last array<int>")


def _candidates(ix: _Index, g: np.ndarray, p: LicenseParams):
    """(template, diagonal) pairs that a fingerprint of the text shows."""
    if not len(g) or not len(ix.hashes):
        return []
    lo = np.searchsorted(ix.hashes, g, "left")
    n = np.searchsorted(ix.hashes, g, "right") - lo
    pos = np.repeat(np.arange(len(g)), n)
    if not len(pos):
        return []
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    t, d = ix.template[at].astype(np.int64), pos - ix.offset[at]
    near = np.ones(len(pos), bool)
    votes = np.array(ix.votes)[t]
    many = votes > 1
    if many.any():
        # grams of a template close to each other's diagonals
        wide = np.int64(1) << 40
        key = np.sort(t[many] * wide + d[many])
        own = t[many] * wide + d[many]
        near[many] = (np.searchsorted(key, own + p.band, "right")
                      - np.searchsorted(key, own - p.band)) >= votes[many]
    picked = np.zeros(len(g), bool)
    picked[_winnow(g, p.window)] = True
    near &= picked[pos] | np.array(ix.short)[t] | many
    return sorted(set(zip(t[near].tolist(), d[near].tolist(), strict=True)))


def _stands(key: np.ndarray, text: np.ndarray) -> bool:
    """Whether the words of ``key`` are in ``text``, one after the other."""
    return any(np.array_equal(text[i:i + len(key)], key)
               for i in np.flatnonzero(text == key[0]))


def _bodies(ix: _Index, found: list[tuple], p: LicenseParams
            ) -> list[tuple]:
    """Long templates that enough of their sections' words make up: the
    sections in their order, from one that comes no later than the last
    anew.  A body's number follows those of the templates."""
    best: dict[tuple[int, int, int], tuple] = {}
    for n, _, first, last, t in found:      # one span per place
        key = (*ix.part[t], first)
        if key not in best or n < best[key][0]:
            best[key] = (n, first, last)
    out = []
    for b, (_, total) in enumerate(ix.bodies):
        rows = sorted((first, k, n, last) for (body, k, first), (n, _, last)
                      in best.items() if body == b)
        chain: list[tuple] = []

        def close():
            n = sum(x[2] for x in chain)
            if chain and -n >= p.coverage * total:
                out.append((n, n / total, chain[0][0], chain[-1][3],
                            len(ix.words) + b))
        for row in rows:
            if chain and row[1] <= chain[-1][1]:
                if row[1] == chain[-1][1] and row[0] < chain[-1][3]:
                    if row[2] < chain[-1][2]:   # a better place of it
                        chain[-1] = row
                    continue
                close()
                chain = []
            chain.append(row)
        close()
    return out


def _scan_text(ix: _Index, h: np.ndarray, p: LicenseParams) -> list[tuple]:
    """Matches of one text, each stretch given to the template that matches
    most of its words there."""
    found = []
    for width in sorted(set(ix.widths)):
        g = _grams(h, width)
        for t, d in _candidates(ix, g, p):
            w = ix.words[t]
            # beside an accepted span there can be a second one
            todo = [(max(0, d - p.band), min(len(h), d + len(w) + p.band))]
            while todo:
                lo, hi = todo.pop()
                if hi - lo < p.coverage * len(w):
                    continue
                n, first, last = align(w, h[lo:hi], d - lo, p.band)
                if n and n >= p.coverage * len(w):
                    span = h[lo + first:lo + last]
                    if not all(_stands(k, span) for k in ix.keys[t]):
                        todo.append((lo + first + 1, hi))
                        continue
                    found.append((-n, -n / len(w), first + lo, last + lo, t))
                    todo += [(lo, lo + first), (lo + last, hi)]
    found = [x for x in found if ix.part[x[4]] is None] + _bodies(
        ix, [x for x in found if ix.part[x[4]] is not None], p)
    # accepted spans don't overlap: sorted, only the neighbours can
    begins, out = [], {}
    for n, c, first, last, t in sorted(set(found)):
        k = bisect.bisect_left(begins, first)
        if (k and out[begins[k - 1]][3] > first) or (
                k < len(begins) and begins[k] < last):
            continue
        begins.insert(k, first)
        out[first] = (n, c, first, last, t)
    return [out[b] for b in begins]


def _scan(w, p: LicenseParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = w.value
        names = [*ix.names, *(n for n, _ in ix.bodies)]
        for batch in batches:
            data, off = C.texts_of(batch.column(1))
            for a, b in C.row_chunks(off):
                h, border = C.word_hashes(data, off[a:b + 1], C.ALNUM_WORDS)
                rows = [[] for _ in range(b - a)]
                # one lookup for all texts tells which ones need a look
                may = np.zeros(b - a, bool)
                for width in sorted(set(ix.widths)):
                    g = _grams(h, width)
                    if len(g) and len(ix.hashes):
                        at = np.minimum(np.searchsorted(ix.hashes, g),
                                        len(ix.hashes) - 1)
                        hit = np.flatnonzero(ix.hashes[at] == g)
                        may[np.searchsorted(border, hit, "right") - 1] = True
                for i in np.flatnonzero(may):
                    rows[i] = _scan_text(ix, h[border[i]:border[i + 1]], p)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a),
                     pa.array(np.diff(border).astype(np.int64)),
                     pa.array([[names[x[4]] for x in r] for r in rows],
                              pa.list_(pa.string())),
                     pa.array([[-x[0] for x in r] for r in rows],
                              pa.list_(pa.int32())),
                     pa.array([[-x[1] for x in r] for r in rows],
                              pa.list_(pa.float64())),
                     pa.array([[x[2] for x in r] for r in rows],
                              pa.list_(pa.int32())),
                     pa.array([[x[3] for x in r] for r in rows],
                              pa.list_(pa.int32()))],
                    names=[c.split()[0] for c in MATCH_SCHEMA.split(", ")])
    return run


def scan_licenses(docs: DataFrame, params: LicenseParams = LicenseParams(),
                  templates: Sequence[tuple[str, str]] = TEMPLATES,
                  id_col: str = "doc_id", text_col: str = "text"
                  ) -> DataFrame:
    """One row per document: doc_id, n_words and, per match in text order,
    license, matched (words), coverage (share of the template's words) and
    the span [first, last) in words of the document.

    Spans don't overlap: a stretch goes to the template that matches most
    words there.  Null, empty and license-free texts have empty lists;
    repeated rows and null ids are scanned like any other row.
    """
    rows = C.own_columns(docs, {id_col: "doc_id", text_col: "text"}).select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    spark = docs.sparkSession
    w = spark.sparkContext.broadcast(_index(templates, params))
    with C.text_batches(spark):
        return C.save(rows.mapInArrow(_scan(w, params), MATCH_SCHEMA),
                      "licenses")


def license_report(docs: DataFrame, params: LicenseParams = LicenseParams(),
                   templates: Sequence[tuple[str, str]] = TEMPLATES
                   ) -> DataFrame:
    """The scan with a row per document and its best match in columns:
    doc_id, n_words, n_matches, licenses (names in text order), best,
    best_coverage, first_word, last_word."""
    m = scan_licenses(docs, params, templates)
    best = F.expr(
        "array_max(transform(sequence(1, size(license)), i -> struct("
        "matched[i - 1] AS m, coverage[i - 1] AS c, -i AS i)))")
    m = m.withColumn("top", F.when(F.size("license") > 0, best))
    at = (-F.col("top.i")).cast("int")
    return m.select(
        "doc_id", "n_words", F.size("license").cast("long").alias("n_matches"),
        F.array_join("license", ",").alias("licenses"),
        F.element_at("license", at).alias("best"),
        F.round("top.c", 6).alias("best_coverage"),
        F.element_at("first", at).cast("long").alias("first_word"),
        F.element_at("last", at).cast("long").alias("last_word"))
