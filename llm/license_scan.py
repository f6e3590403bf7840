"""Licence scans by a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a run of lines with words.  Its passages are the paragraph as a whole, its lines and its sentences, which may run over
lines.  Features of a passage are its word 1-, 2- and 3-grams (A-Z in lower case, punctuation and comment marks taken off the words' ends)
over the root of its words: those of the training texts, licence templates and other prose alike.  Multinomial logistic regression tells the
licence families and an ``unknown`` class apart.  It is trained on sentences made from the templates, on parts of them and, for the
unknown class, on prose about licences and on a bounded sample of the corpus's own passages that no template confirms.  A temperature
calibrates the probabilities, fitted on texts of wordings, parts and passages that a first fit has not seen; the last fit has them all.

A passage is a licence passage of its family if the calibrated probability is at least ``least_score`` and at least ``least_share``
of its 3-grams are in the family's templates; one of one or two words has no 3-gram and must be a name of the family, alone or after
a lead.  A paragraph that is such a passage stands for itself; else each of its lines that is one does; of the sentences that start in a line
and touch no such line, the one with the largest share, then probability, then the first does.  Only passages that templates can confirm are scored.

Edge cases: null and empty texts have no licence; ties between families go to the first in the order of ``FAMILIES``; repeated rows are
scanned alike; an empty table gives an empty result; further columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_rows, lean, small_batches
from .textkernel import U64, Words, buffers, mix64, slices

# Names of licences and short passages of their notices.
FAMILIES = {
    "Apache-2.0": (["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"], ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"]),
    "MIT": (["the MIT License", "MIT License", "the MIT licence", "MIT"], ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction', 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.']),
    "BSD": (["the BSD License", "the 3-Clause BSD License", "the 2-Clause BSD License", "BSD-3-Clause", "BSD-2-Clause"], ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]),
    "GPL-2.0": (["the GNU General Public License, version 2", "the GNU General Public License v2.0", "GPL-2.0", "GPLv2"], ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."]),
    "GPL-3.0": (["the GNU General Public License, version 3", "the GNU General Public License v3.0", "GPL-3.0", "GPLv3"], ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."]),
    "LGPL": (["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License, version 2.1", "LGPL-3.0", "LGPL-2.1"], ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"]),
    "AGPL-3.0": (["the GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"], ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"]),
    "MPL-2.0": (["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"], ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"]),
    "CC-BY-4.0": (["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"], ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    "CC-BY-SA-4.0": (["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"], ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    "CC-BY-NC-4.0": (["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"], ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
    "CC0-1.0": (["CC0 1.0", "the CC0 1.0 Universal Public Domain Dedication", "CC0-1.0"], ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    "Unlicense": (["the Unlicense", "The Unlicense"], ["This is free and unencumbered software released into the public domain."]),
    "ISC": (["the ISC License", "ISC License"], ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"]),
}
LEADS = ["Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This software is licensed under {}.", "Distributed under {}.", "Available under {}.", "The code is released under the terms of {}.", "This project is licensed under {}", "License: {}", "SPDX-License-Identifier: {}", "Content is available under {}.", "All files in this repository are licensed under {} unless noted."]
OTHERS = [
    "The driver needs a valid license to operate the vehicle on public roads.", "She renewed her fishing license in the spring.", "All rights reserved.", "The terms of the agreement were released to the public.", "The license plate was found under the bridge.",
    "Permission to enter the building must be granted by the owner.", "The software was distributed to all schools in the district.", "General public opinion was against the new version of the law.", "The work is available in the library and in the source archive.",
    "Free software and open standards were discussed at the conference.", "You can copy the file to another folder.", "Use of this site is subject to the terms of use.", "The museum is open to the general public, version or no version.", "The university granted a degree to any person who passed.",
]
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33), *b"\"'(),;:!?[]{}<>.*|"]] = True
#: Bytes of words proper; a word's other bytes at its ends are comment marks and the like, a word without one is left out.
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SENTENCE = re.compile(r"(?<=[.!?;])[\"')\]]*\s+(?=[\"'(\[¿¡]*[^\W\d_a-zß-ÿ])")
#: Documents that the unknown class is sampled from, bytes of such a text at most, and passages of it.
CORPUS_ROWS, MOST_BYTES, PASSAGES = 300, 1 << 16, 2000
#: Grams of the unknown class that are features: those in so many of its passages.
COMMON = 4
_BLOOM = 20


def _words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Words without marks at their ends."""
    words = Words(raw, offsets, _EDGE)
    core = np.flatnonzero(_CORE[raw])
    ends = words.start + words.length
    a, b = np.searchsorted(core, words.start), np.searchsorted(core, ends)
    full = a < b
    words.start, words.length = core[a[full]], core[b[full] - 1] + 1 - core[a[full]]
    words.offsets = np.searchsorted(words.start, offsets)
    return words


def _grams(h: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words and, at each word, of the 2- and 3-gram that starts there (0 where it would leave the words of one id)."""
    out = [h]
    for k in (2, 3):
        g = np.zeros(len(h), U64)
        if len(h) >= k:
            same = ids[k - 1 :] == ids[: len(ids) - k + 1]
            g[: len(h) - k + 1][same] = mix64(out[-1][: len(h) - k + 1][same] * U64(0x9E3779B97F4A7C15) + h[k - 1 :][same] + U64(k))
        out.append(g)
    return out


def grams(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The grams of each text's words, and the words' offsets by text."""
    words = _words(*buffers(texts))
    return _grams(words.hashes(), words.text_ids()), words.offsets


def _member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of hashes in sorted keys, -1 for none."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


@dataclass
class Licences:
    """keys: sorted hashes of the features; weights: by key and class, the constant last; families: whether a class's templates have a gram."""

    names: list[str]
    keys: np.ndarray
    weights: np.ndarray
    families: np.ndarray
    temperature: float
    #: for each family, hashes of its names of one word and of two, alone or after a lead
    short: list[tuple[set[int], set[int]]]
    _hints: tuple[np.ndarray, ...] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_hints": None}

    def logits(self, hashes: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        out = np.tile(self.weights[-1], (len(n), 1))
        ids = np.repeat(np.arange(len(n)), n)
        for h in hashes:
            rows = _member(self.keys, h)
            hit = np.flatnonzero((rows >= 0) & (h != 0))
            if len(hit):
                own = ids[hit]
                first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                out[own[first]] += np.add.reduceat(self.weights[rows[hit]], first, axis=0) / np.sqrt(n[own[first], None])
        return out

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Class, calibrated probability and share of the text's 3-grams in the templates of that class, for each text."""
        hashes, at = grams(texts)
        n = np.diff(at)
        logits = self.logits(hashes, at)
        ids = np.repeat(np.arange(len(n)), n)
        best = logits.argmax(1)
        e = np.exp((logits - logits.max(1, keepdims=True)) / self.temperature)
        score = e[np.arange(len(n)), best] / e.sum(1)
        rows = _member(self.keys, hashes[2])
        ok = (rows >= 0) & (hashes[2] != 0)
        ok[ok] = self.families[rows[ok], best[ids[ok]]]
        share = np.bincount(ids[ok], minlength=len(n)) / np.maximum(n - 2, 1)
        for t in np.flatnonzero((n == 1) | (n == 2)):
            share[t] = best[t] < len(self.short) and int(hashes[n[t] - 1][at[t]]) in self.short[best[t]][n[t] - 1]
            # "mit" and "Mit" alone are words of prose
            if share[t] and n[t] == 1 and "licen" not in (one := texts[int(t)].as_py()).lower():
                share[t] = sum(c.isupper() for c in one) > 1
        return best, score, share

    def hinted(self, texts: pa.Array) -> list[tuple[int, int, int]]:
        """(text, first line, last line) of the paragraphs that hold a 3-gram of a template or a short name: no other has a licence."""
        if self._hints is None:
            keys = self.keys[self.families.any(1)]
            bloom = np.zeros(1 << _BLOOM, bool)
            bloom[(keys >> U64(64 - _BLOOM)).astype(np.int64)] = True
            one, two = (np.array(sorted({h for pair in self.short for h in pair[k]}), U64) for k in (0, 1))
            bloom[(two >> U64(64 - _BLOOM)).astype(np.int64)] = True
            self._hints = bloom, keys, one, two
        bloom, keys, names, pairs = self._hints
        raw, offsets = buffers(texts)
        words = _words(raw, offsets)
        if not len(words.start):
            return []
        breaks = np.flatnonzero(raw == 10)
        text, line = words.text_ids(), np.searchsorted(breaks, words.start)
        # lines without a word, and texts, part paragraphs
        paragraph = np.cumsum(np.append(False, (text[1:] != text[:-1]) | (line[1:] - line[:-1] > 1)))
        one, two, three = _grams(words.hashes(), paragraph)
        hit = np.zeros(len(one), bool)
        for h, wanted in ((three, keys), (two, pairs)):
            maybe = np.flatnonzero(bloom[(h >> U64(64 - _BLOOM)).astype(np.int64)])
            hit[maybe] |= (_member(wanted, h[maybe]) >= 0) & (h[maybe] != 0)
        # names of one word count as lines of their own only
        at = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])))
        few = at[np.diff(np.append(at, len(one))) == 1]
        hit[few] |= _member(names, one[few]) >= 0
        found = np.unique(paragraph[hit])
        begin, end = np.searchsorted(paragraph, found), np.searchsorted(paragraph, found, "right") - 1
        base = np.searchsorted(breaks, offsets[:-1])
        return [(int(text[a]), int(line[a] - base[text[a]]), int(line[b] - base[text[b]])) for a, b in zip(begin, end, strict=True)]


def _templates() -> tuple[list[str], list[int], list[bool]]:
    """Sentences and parts of templates, their families, and whether the first fit leaves them out: every fourth wording and part."""
    texts, labels, held = [], [], []
    for c, (names, notices) in enumerate(FAMILIES.values()):
        made = [(lead.format(name), (j + k) % 4 == 3) for k, name in enumerate(names) for j, lead in enumerate(LEADS)] + [(x, False) for x in notices]
        for notice in notices:
            words = notice.split()
            for size in (8, 12, 18):
                made += [(" ".join(words[a : a + size]), j % 4 == 3) for j, a in enumerate(range(0, max(1, len(words) - size + 1), 3))]
        texts += [x for x, _ in made]
        held += [x for _, x in made]
        labels += [c] * len(made)
    return texts, labels, held


def _short_forms() -> list[tuple[set[int], set[int]]]:
    """For each family, the hashes of its names of one word and of two, with or without their article, alone or after a lead."""
    out = []
    for key, (names, _) in FAMILIES.items():
        made = {x for name in (key, *names) for x in (name, re.sub("^[Tt]he ", "", name))}
        hashes, at = grams(pa.array(sorted(made | {lead.format(name) for name in made for lead in LEADS})))
        n = np.diff(at)
        out.append(tuple({int(x) for x in hashes[k][at[:-1][n == k + 1]]} for k in (0, 1)))
    return out


def _regression(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, features: int, classes: int, steps: int = 300, rate: float = 2.0, ridge: float = 1e-6) -> np.ndarray:
    """Multinomial logistic regression on sparse rows, each class weighing the same: gradient descent with momentum.  The last weight is the constant."""
    weight = (1 / np.maximum(np.bincount(labels, minlength=classes), 1))[labels] / classes
    target = np.eye(classes)[labels]
    w, v = np.zeros((features + 1, classes)), 0.0
    by = np.argsort(cols, kind="stable")
    used, first = np.unique(cols[by], return_index=True)
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    for _ in range(steps):
        z = np.tile(w[-1], (len(labels), 1))
        if len(rows):
            z[rows[begin]] += np.add.reduceat(w[cols] * values[:, None], begin, axis=0)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - target) * weight[:, None]
        g = ridge * w
        g[-1] += error.sum(0)
        if len(rows):
            g[used] += np.add.reduceat((error[rows] * values[:, None])[by], first, axis=0)
        v = 0.9 * v - rate * g
        w = w + v
    return w


def fit(corpus: list[str]) -> Licences:
    """Trains on the templates and on passages of the corpus, leaving out those that a template confirms."""
    names, unknown = [*FAMILIES, "unknown"], len(FAMILIES)
    texts, labels, held = _templates()
    templates, at = grams(pa.array(texts))
    family = np.repeat(labels, np.diff(at))
    own = np.unique(np.concatenate(templates))
    own = own[own != 0]
    short = _short_forms()
    named = {h for pair in short for kind in pair for h in kind}
    hashes, at = grams(pa.array(corpus, pa.string()))
    plain = []
    for k, n in enumerate(np.diff(at)):
        three = hashes[2][at[k] : at[k] + max(0, n - 2)]
        confirmed = (n > 2 and 2 * np.count_nonzero(_member(own, three) >= 0) >= n - 2) or (0 < n <= 2 and int(hashes[n - 1][at[k]]) in named)
        if n and not confirmed:
            plain.append(corpus[k])
    more = OTHERS + plain
    texts, labels, held = texts + more, np.array(labels + [unknown] * len(more)), np.array(held + [k % 4 == 3 for k in range(len(more))])
    hashes, at = grams(pa.array(texts, pa.string()))
    n = np.diff(at)
    ids = np.repeat(np.arange(len(n)), n)
    # features: all grams of the templates, and those that several of the other passages have
    tokens, where = np.concatenate(hashes), np.tile(ids, 3)
    other = (labels[where] == unknown) & (tokens != 0)
    kinds, place = np.unique(tokens[other], return_inverse=True)
    once = np.unique(place * len(n) + where[other])
    keys = np.union1d(own, kinds[np.bincount(once // len(n), minlength=len(kinds)) >= COMMON])
    families = np.zeros((len(keys), unknown + 1), bool)
    for h in templates:
        ok = h != 0
        families[np.searchsorted(keys, h[ok]), family[ok]] = True
    found = _member(keys, tokens)
    hit = (found >= 0) & (tokens != 0)
    by = np.argsort(where[hit], kind="stable")
    rows, cols = where[hit][by], found[hit][by]
    values = 1 / np.sqrt(n[rows])
    stay = ~held[rows]
    renumber = np.cumsum(~held) - 1
    first = _regression(renumber[rows[stay]], cols[stay], values[stay], labels[~held], len(keys), unknown + 1)
    model = Licences(names, keys, first, families, 1.0, short)
    late = np.flatnonzero(held)
    z = model.logits(*grams(pa.array([texts[k] for k in late], pa.string())))
    losses, grid = [], np.geomspace(0.2, 5, 25)
    for t in grid:
        q = z / t - (z / t).max(1, keepdims=True)
        losses.append(-(q[np.arange(len(q)), labels[late]] - np.log(np.exp(q).sum(1))).mean())
    return Licences(names, keys, _regression(rows, cols, values, labels, len(keys), unknown + 1), families, float(grid[int(np.argmin(losses))]), short)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = CORPUS_ROWS, most_bytes: int = MOST_BYTES, passages: int = PASSAGES) -> Licences:
    """Fits with passages of at most `rows` documents of at most most_bytes, chosen by a hash of the id, for the unknown class.

    Of their lines and sentences, at most `passages` are taken, at even distances.
    """
    d = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).filter(F.octet_length("t") <= most_bytes)
    ids = hashed_rows(d.select("d", F.lit(0).alias("k")), "k", "d", rows)
    texts = [r.t for r in d.join(F.broadcast(ids), "d").orderBy("h", "d").select("t").collect()][:rows]
    found = [x for t in texts for line in t.split("\n") for x in (sentences(line) or [line])]
    step = max(1, -(-len(found) // passages))
    return fit(found[::step])


def sentences(text: str) -> list[str]:
    """The sentences of a text that has more than one; one word ("MIT!!" in shouted German) is none."""
    return [text[a:b] for a, b in _spans(text)]


def _spans(text: str) -> list[tuple[int, int]]:
    cuts = [(m.start(), m.end()) for m in _SENTENCE.finditer(text)]
    if not cuts:
        return []
    spans = zip([0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)], strict=True)
    return [(a, b) for a, b in spans if len(text[a:b].split(None, 1)) > 1]


def passages_of(lines: list[str]) -> list[tuple[int, int, int, str]]:
    """(kind, first line, last line, text) of a paragraph's passages: kind 0 the whole, 1 a line, 2 a sentence."""
    out = [(0, 0, len(lines) - 1, " ".join(lines))] if len(lines) > 1 else []
    out += [(1, k, k, line) for k, line in enumerate(lines)]
    whole = " ".join(lines)
    ends = np.cumsum([len(x) + 1 for x in lines])
    for a, b in _spans(whole):
        first, last = np.searchsorted(ends, [a, b - 1], "right").tolist()
        out.append((2, first, last, whole[a:b]))
    return out


def scan(docs: DataFrame, model: Licences, id_col: str = "doc_id", text_col: str = "text", least_score: float = 0.5, least_share: float = 0.5) -> DataFrame:
    """One row for each licence passage: doc_id, line and last_line (from 0), family, score, share, text."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "line", "last_line", "family", "score", "share", "text"]

    def run(batches):
        for batch in batches:
            for b in slices(batch, "t"):
                yield found_in(b)

    def found_in(b: pa.RecordBatch) -> pa.RecordBatch:
        model = shipped.value
        texts, ids = b.column("t").fill_null(""), b.column("d")
        split: dict[int, list[str]] = {}
        parts: list[tuple[int, int, int, int, str]] = []
        place: list[tuple[int, int]] = []
        for k, (t, low, high) in enumerate(model.hinted(texts)):
            if t not in split:
                split = {t: texts[t].as_py().split("\n")}
            for kind, first, last, text in passages_of(split[t][low : high + 1]):
                parts.append((k, kind, low + first, low + last, text))
                place.append((t, k))
        best, score, share = model.scan(pa.array([x[-1] for x in parts], pa.string()))
        ok = np.flatnonzero((best < len(FAMILIES)) & (score >= least_score) & (share >= least_share))
        rows = []
        taken: dict[int, set[int]] = {}
        # a paragraph before its lines, lines before sentences, sentences that start in one line by share, probability, place
        for x in sorted(ok.tolist(), key=lambda x: (parts[x][0], parts[x][1], -share[x] if parts[x][1] == 2 else 0, -score[x] if parts[x][1] == 2 else 0, x)):
            k, kind, first, last, text = parts[x]
            # lines that a paragraph or a line has taken, and, as numbers below 0, lines in which a sentence has started
            used = taken.setdefault(k, set())
            if not used.isdisjoint(range(first, last + 1)) or kind == 2 and ~first in used:
                continue
            used.update(range(first, last + 1) if kind < 2 else [~first])
            rows.append((ids[place[x][0]].as_py(), first, last, model.names[best[x]], score[x], share[x], text))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)

    schema = "doc_id long, line int, last_line int, family string, score double, share double, text string"
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(lean(run), schema)
