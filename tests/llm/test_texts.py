"""Operators on single texts, against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import LETTERS  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm import bestfit_packing, html_extract, language_id, license_scan, line_quality, source_mixing, toxicity
from llm.textkernel import Words, buffers, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = r"[^\x20\x09-\x0D]+"


def test_kernel_splits_and_hashes_as_python():
    texts = ["", None, "a", " a  b\tc\n", "x" * 300 + " y", "é z A a", "b"]
    w = Words(*buffers(pa.array(texts)))
    assert np.diff(w.offsets).tolist() == [len(re.findall(WORDS, t or "")) for t in texts]
    h = w.hashes().tolist()
    flat = [x for t in texts for x in re.findall(WORDS, t or "")]
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in flat]
    assert all((h[i] == h[j]) == (low[i] == low[j]) for i in range(len(h)) for j in range(len(h)))
    _, at = windows(w.hashes(), w.offsets, 2)
    assert np.diff(at).tolist() == [max(0, n - 1) or int(n == 1) for n in np.diff(w.offsets)]


TEXTS = ["", "a", " a", "a ", "a  b", "a\n\nb", "a \nb\n c", "don't we'll\tgo", "x y  z", "1234 56,78!? ...", "é ñß 日本語 text", "\n", "a\r\nb", "\x1c \x85", "a<|endoftext|>b", " <|endoftext|> \n<|endoftext|><|endoftext|>", "<|endoftext", "x <|endoftext|>y  z"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts_encode_as_the_library(text):
    t = Tokenizer.from_file(PATH)
    assert np.frombuffer(bestfit_packing.encoder(PATH)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = True
    assert np.frombuffer(bestfit_packing.encoder(PATH, False)(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(docs, rows):
    tokens = Tokenizer.from_file(PATH)
    out = bestfit_packing.pack(docs, PATH, 64, with_ids=True).collect()
    parts = defaultdict(list)
    for r in out:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        parts[r.doc_id].append(r)
    repeats = Counter(i for i, _ in rows)
    for i, t in dict(rows).items():
        ids = tokens.encode(t or "", add_special_tokens=False).ids + [0]
        own = sorted(parts[i], key=lambda r: r.piece)[:: repeats[i]]
        assert [x for r in own for x in r.ids] == ids and [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert all(r.length == 64 for r in own[1:])
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 64
    assert len(sequences) <= -(-sum(r.length for r in out) // 64) * 1.05 + 1


def test_packing_empty(nothing):
    assert bestfit_packing.pack(nothing, PATH).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_everything_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.randrange(1, 129) if seed % 2 else rng.choice([3, 40, 61, 64, 128]) for _ in range(rng.randrange(1, 3000)))
    plan = bestfit_packing.plan(counts, 128)
    used = Counter()
    for members, n in plan:
        assert sum(members) <= 128
        for m in members:
            used[m] += n
    assert used == counts
    assert sum(n for _, n in plan) >= -(-sum(k * n for k, n in counts.items()) // 128)


def test_exact_complements_leave_no_gap():
    assert sum(n for _, n in bestfit_packing.plan({100: 10, 28: 10, 60: 5, 40: 5, 14: 10}, 128)) == 15


def test_mixing(docs, rows):
    mixed = source_mixing.mix(docs.withColumn("size", source_mixing.words())).collect()
    assert len(mixed) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in mixed:
        assert r.size == len(re.findall(WORDS, r.text or "")) and 0 <= r.taken <= 3 * r.size and sum(c.words for c in r.copies) == r.taken
        assert all(0 <= c.position <= 1 for c in r.copies)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = (r.target, r.source_size)
    assert all(target[s][1] == size[s] and taken[s] == int(target[s][0] + 1e-9) for s in size)
    assert abs(sum(t for t, _ in target.values()) - sum(size.values())) < 1e-6
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s)), [1, 2, 3, 1], strict=True))
    free = [target[s][0] / weights[s] for s in size if target[s][0] < 3 * size[s]]
    assert max(free) - min(free) < 1e-6


def test_mixing_limits_and_order(spark):
    d = spark.createDataFrame([(i, "abc"[0 if i < 3 else 1 if i < 20 else 2], 10) for i in range(100)], "doc_id long, source string, size long")
    mixed = source_mixing.mix(d)
    by = {r.source: (r.target, r.taken) for r in mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    assert by["a"] == (90.0, 90) and sum(t for _, t in by.values()) >= 998
    order = source_mixing.curriculum(mixed, partitions=4)
    assert order.rdd.glom().map(lambda part: [r.position for r in part] == sorted(r.position for r in part)).collect() == [True] * 4


def test_training_order(spark, sf_dir):
    """Positions by hand: every copy in training order, and the query's first and last one of each document."""
    from llm import queries

    docs = queries.table(spark, sf_dir, "documents")
    rows = queries.op6_source_mixing(spark, sf_dir).collect()
    taken = {r.doc_id: r for r in rows}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    names = sorted(set(source.values()), key=lambda s: (s is None, s))
    ramp = {s: (-0.5, 0.0, 0.5)[k % 3] for k, s in enumerate(names)}
    start: Counter = Counter()
    every, copies = [], defaultdict(list)
    for i in sorted(source, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        r, at, g = taken[i], start[source[i]], ramp[source[i]]
        start[source[i]] += r.size
        for p in range(4):
            n = min(r.size, max(0, int(r.target) - p * r.source_size - at))
            if n:
                due = min(1.0, (p * r.source_size + at + n / 2) / r.target)
                copies[i].append(((((1 - g) ** 2 + 4 * g * due) ** 0.5 - (1 - g)) / (2 * g)) if g else due)
                if 2 * n >= r.size:
                    every.append((i, copies[i][-1]))
    for i, r in taken.items():
        assert r.n_copies == len(copies[i])
        ends = (copies[i][0], copies[i][-1]) if copies[i] else (None, None)
        assert all(a is b or abs(a - b) < 1e-9 for a, b in zip((r.first_position, r.last_position), ends, strict=True))
    order = [2.0 if r.first_position is None else r.first_position for r in rows]
    assert order == sorted(order) and len(rows) == len(source)
    got = [(r.doc_id, r.position) for r in source_mixing.curriculum(source_mixing.mix(docs.withColumn("size", source_mixing.words()))).select("doc_id", "position").collect()]
    assert [p for _, p in got] == sorted(p for _, p in got)
    assert sorted((i, round(p, 9)) for i, p in got) == sorted((i, round(p, 9)) for i, p in every)


def test_mixing_empty(nothing):
    assert source_mixing.mix(nothing.withColumn("size", source_mixing.words())).collect() == []


def brute_quality(text):
    w = re.findall(WORDS, text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(WORDS, line):
            again += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    cover = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover)


def test_quality_base(docs, rows):
    extra = [(900, "a b c d e a b c d e\nx x\nx x\n#$ |"), (901, "q " * 400)]
    frame = docs.select("doc_id", "text", "n").union(docs.sparkSession.createDataFrame([(i, t, 0) for i, t in extra], "doc_id long, text string, n long"))
    for r in line_quality.assess(frame).collect():
        n, *rest = brute_quality(dict(rows + extra)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[-1] > 20 * n) and (not r.kept or not r.base_failed)


def brute_verdict(text):
    """Share of words' characters on lines that fail a rule, by the rules as the docstring states them."""
    seen, lost, total, lines = set(), 0, 0, (text or "").split("\n")
    for k, line in enumerate(lines):
        w = re.findall(WORDS, line)
        if not w:
            continue
        n, chars = len(w), sum(map(len, w))
        bars = sum(line.count(c) for c in "|»›•·")
        steps = len(re.findall(r"[|»›•·]|(?<=\s)[>/-](?=\s)", line))
        fails = line in seen or bars > 1 and 4 * bars >= n or " > " in line and 3 * steps >= n or len(re.findall(r"[#*$%&|<>]", line)) > n / 4
        fails = fails or n >= 4 and line.isupper() or any(p in line.lower() for p in line_quality.BOILERPLATE)
        fails = fails or n >= 12 and k + 1 < len(lines) and not re.search(r"""[.!?…:;"'”’»)\]}。！？][ \t\n\r\x0b\x0c]*$""", line)
        seen.add(line)
        lost, total = lost + fails * chars, total + chars
    return 2 * lost <= total


def test_quality_verdict_against_brute_force(spark, rows, sf_dir):
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(10**6 + k, t) for k, (_, t) in enumerate(rows)]
    own += [(2 * 10**6, "Home | News | More\n" * 3 + "A plain sentence stays here, of some ten words or more.\n" * 2), (2 * 10**6 + 1, ("A word and more of it. " * 9 + "\n") * 3000)]
    text = dict(own)
    for r in line_quality.assess(spark.createDataFrame(own, "doc_id long, text string"), with_text=False).collect():
        assert r.kept == (not r.base_failed and brute_verdict(text[r.doc_id]))


def test_quality_rules(docs, nothing):
    rule = line_quality.line_rule
    assert rule("Home | News | Sport | More", 7, False, False) == "navigation"
    assert rule("THIS IS ALL SHOUTED!!", 4, False, False) == "shouting"
    assert rule("Please read our privacy policy now.", 6, False, False) == "boilerplate"
    assert rule("fine words end here without any stop at all in this long line", 13, False, False) == "punctuation"
    assert rule("A plain sentence stays.", 4, False, False) is None
    assert rule("A plain sentence stays.", 4, True, False) == "repeated"
    assert line_quality.assess(nothing).collect() == []


def test_language(docs, nothing, spark):
    rng = random.Random(2)
    make = {"aa": "ka lo mi tu", "bb": "zer vist gro plem", "cc": "ñao éti üla"}
    rows = [(i, " ".join(rng.choice(make[lang].split()) + rng.choice(make[lang].split()) for _ in range(20)), lang) for i in range(120) for lang in [list(make)[i % 3]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(frame.filter("doc_id < 60"))
    got = {r.doc_id: r for r in language_id.predict(frame.filter("doc_id >= 60"), model).collect()}
    assert all(r.lang_pred == rows[i][2] and 0 <= r.score <= 1 for i, r in got.items())
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "ka lo"), (4, "ka lo")], "doc_id long, text string")
    assert sorted(r.lang_pred for r in language_id.predict(odd, model).collect()) == ["aa", "aa", "und", "und", "und"]
    assert language_id.predict(nothing, model).collect() == []
    none = language_id.train(frame.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, none).collect()} == {"und"}
    carried = language_id.annotate(docs, model)
    assert carried.count() == docs.count() and "tokens" in carried.columns


def brute_code_length(training, text):
    """PPM with escapes of method C, order 3, by dictionaries."""
    follow: dict = defaultdict(Counter)
    for t in training:
        data = b"\0\0\0" + t.lower().encode()
        for k in range(3, len(data)):
            for order in range(4):
                follow[data[k - order : k]][data[k]] += 1
    bits, data = 0.0, b"\0\0\0" + text.lower().encode()
    for k in range(3, len(data)):
        for order in (3, 2, 1, 0):
            seen = follow.get(data[k - order : k])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if data[k] in seen:
                bits -= math.log2(seen[data[k]] / total)
                break
            bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_trees():
    rng = random.Random(3)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    training = {"x": [make("abAB é", 90) for _ in range(4)] + [""], "y": [make("bcß 1\n", 60) for _ in range(3)], "z": [make("日本", 9)]}
    model = language_id.fit(pa.array([t for own in training.values() for t in own]), [name for name, own in training.items() for _ in own])
    texts = ["", "a", "abab", "ÉéB", "日本 語", "c1\n\x00zzq", make("abcé1日", 300)] + training["x"][:1]
    got = model.code_lengths(pa.array(texts))
    for i, text in enumerate(texts):
        for k, name in enumerate(model.languages):
            assert abs(got[i, k] - brute_code_length(training[name], text)) < 1e-3 * max(1, len(text) / 100)


def test_places_in_sorted_arrays():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 5000).astype(np.uint32))
    asked = np.concatenate([keys, rng.integers(0, 2**32, 5000).astype(np.uint32)])
    expected = [int(np.searchsorted(keys, x)) if x in set(keys.tolist()) else -1 for x in asked.tolist()]
    assert language_id.Places(keys).find(asked).tolist() == expected
    assert language_id.Places(keys[:0]).find(asked[:3]).tolist() == [-1] * 3


def test_language_of_very_long_texts_and_ties(spark):
    frame = spark.createDataFrame([(k, "ka lo mi tu " * 5, "ab"[k % 2]) for k in range(8)], "doc_id long, text string, lang string")
    model = language_id.train(frame)
    out = {r.doc_id: r for r in language_id.predict(spark.createDataFrame([(1, "ka lo mi tu " * 60000), (2, "ka")], "doc_id long, text string"), model).collect()}
    assert out[1].lang_pred == out[2].lang_pred == "a" and abs(out[1].score - 0.5) < 1e-9


def test_language_sample_is_bounded(spark):
    frame = spark.createDataFrame([(k, "x" * 10 if k % 2 else "y" * 500, "en") for k in range(300)], "doc_id long, text string, lang string")
    model = language_id.train(frame, rows_per_language=20, most_bytes=100)
    assert model.code_lengths(pa.array(["y"]))[0, 0] > 8
    whole = language_id.train(frame, rows_per_language=20)
    assert whole.code_lengths(pa.array(["y"]))[0, 0] < 8


def test_toxicity(spark, nothing):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(30)]
        if bad:
            for _ in range(3):
                w[rng.randrange(30)] = rng.choice(["idiot", "moron", "grubbel", "grubbels"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([x for x in labels if x[0] % 2 == 0], "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    held = [(got[i], y) for i, y in labels if i % 2]
    assert sum((s >= 0.7) == bool(y) for s, y in held) >= 0.97 * len(held)
    assert toxicity.score(nothing, model).collect() == []
    no_labels = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, no_labels).collect()} == {0.0}


def test_toxicity_follows_the_labels_whatever_the_cap(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta omega sigma".split()) for _ in range(20)), int(i % 10 == 0)) for i in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    for cap in (2000, 100):
        model = toxicity.train(frame, frame, rows_per_class=cap)
        assert abs(model.share - 0.1) < 1e-9
        assert toxicity.score(frame, model).agg(F.avg("score")).first()[0] < 0.2


def test_toxicity_of_odd_rows(spark):
    """Very long texts, repeated rows, ties and columns with the operator's names."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(15)) + " moron idiot" * (i % 4 == 0), int(i % 4 == 0)) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(train, train.union(train))
    odd = [(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (3, "word " * 400000), (4, "you moron idiot"), (None, "alpha beta"), (5, None)]
    frame = spark.createDataFrame(odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("d", F.lit(7)).withColumn("t", F.lit("x"))
    got = toxicity.score(frame, model).collect()
    scores = defaultdict(set)
    for r in got:
        scores[r.doc_id].add(r.score)
    assert len(got) == len(odd) and len(scores[1] | scores[2] | scores[None]) == 1 and all(0 <= s <= 1 for x in scores.values() for s in x)
    assert min(scores[4]) > max(scores[3] | scores[1])


def brute_isotonic(y, w):
    """The non-decreasing fit by its max-min formula."""
    n = len(y)
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_against_its_formula(seed):
    rng = np.random.default_rng(seed)
    x, y, w = np.arange(30.0), rng.integers(0, 2, 30), rng.random(30) + 0.1
    knots, values = toxicity.isotonic(x, y, w)
    got = np.interp(x, *toxicity.isotonic(x, y, w))
    assert np.allclose(got, brute_isotonic(y, w)) and (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def brute_split(x, g, h, ridge):
    """The best first split over all cuts between values, by the gain of Newton leaves."""
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = g[left].sum() ** 2 / (h[left].sum() + ridge) + g[~left].sum() ** 2 / (h[~left].sum() + ridge) - g.sum() ** 2 / (h.sum() + ridge)
            if gain > best[0] + 1e-12:
                best = (gain, j, cut)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_trees_split_where_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, (80, 4)).astype(float)
    y = (x[:, seed] + rng.normal(size=80) > 6).astype(float)
    trees = toxicity.Trees(rounds=1, depth=1, rate=1.0, bins=400, least=0.0)
    trees.fit(x, y)
    p = y.mean()
    gain, j, cut = brute_split(x, p - y, np.full(80, p * (1 - p)), 1.0)
    found = trees.trees[0][0]
    left = x[:, j] <= cut
    # any cut between two values parts the rows alike
    assert found[0] == j and ((x[:, j] <= found[1]) == left).all()
    raw = trees.raw(x)
    for side in (left, ~left):
        leaf = (y - p)[side].sum() / (side.sum() * p * (1 - p) + 1.0)
        assert np.allclose(raw[side] - trees.base, leaf)


def test_isotonic_weighs_rows():
    assert toxicity.isotonic(np.array([1.0, 1, 2]), np.array([1, 0, 1]), np.array([1.0, 3, 1]))[1].tolist() == [0.25, 0.25, 1, 1]


def test_isotonic_is_sorted_and_pools():
    knots, values = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert (np.diff(values) >= 0).all() and np.interp(2.5, knots, values) == 0.5


def test_licences(spark, docs, nothing):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "He lost his driving license in the storm.", "", "Nothing to see."]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, None), (3, "")], "doc_id long, text string")
    model = license_scan.train(docs)
    got = [(r.doc_id, r.line, r.family) for r in license_scan.scan(frame, model).orderBy("line").collect()]
    assert got == [(1, 0, "Apache-2.0"), (1, 1, "MIT"), (1, 2, "GPL-3.0"), (1, 3, "CC-BY-NC-4.0")]
    assert license_scan.scan(nothing, model).collect() == []


def test_licences_short_commented_and_among_prose(spark, docs):
    lines = ["SPDX-License-Identifier: MIT", "// SPDX-License-Identifier: MIT", "# SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: Apache-2.0 */", "License: Apache-2.0", "MIT License", "GPLv2", "//SPDX-License-Identifier: ISC"]
    prose = "The harbour was quiet in the early morning and nobody saw the boats leave. Released under the MIT License. Later that day the market opened and the street was full of people who had come from the hills."
    plain = ["this software", "The", "mit uns", "Mit", "DIE BOOTE!! FAHREN!! MIT!! DER!!", "free software", "of the", "The license", "// nothing here", "General public", "Die Boote fahren mit. Sie kommen nicht."]
    frame = spark.createDataFrame([(1, "\n".join(lines)), (2, prose), (3, "\n".join(plain))], "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.family) for r in license_scan.scan(frame, license_scan.train(docs)).collect())
    expected = ["MIT", "MIT", "MIT", "Apache-2.0", "Apache-2.0", "MIT", "GPL-2.0", "ISC"]
    assert got == [(1, k, x) for k, x in enumerate(expected)] + [(2, 0, "MIT")]


WRAPPED = """A file of tools for the harbour.

Permission is hereby granted, free of charge, to any person
obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without
restriction

Nothing else is said. Redistribution and use in source and
binary forms, with or without modification, are permitted provided that
the following conditions are met. The boats left early in the morning."""


def test_licences_wrapped_over_lines(spark, docs):
    """A notice wrapped over lines is one passage, and so is a sentence that runs over lines among prose."""
    model = license_scan.train(docs)
    frame = spark.createDataFrame([(1, WRAPPED), (1, WRAPPED), (2, "prose of the harbour. " * 30000 + "\n" + WRAPPED), (3, "MIT License\n\nGPLv2")], "doc_id long, text string").withColumn("family", F.lit("clash"))
    got = sorted((r.doc_id, r.line, r.last_line, r.family) for r in license_scan.scan(frame, model).collect())
    assert got == [(1, 2, 5, "MIT")] * 2 + [(1, 7, 9, "BSD")] * 2 + [(2, 3, 6, "MIT"), (2, 8, 10, "BSD"), (3, 0, 0, "MIT"), (3, 2, 2, "GPL-2.0")]


def brute_licences(model, text):
    """Every passage of every paragraph scored, whether a template hints at it or not."""
    lines, out = (text or "").split("\n"), []
    k = 0
    has_word = lambda x: len(license_scan.grams(pa.array([x]))[0][0]) > 0
    while k < len(lines):
        if not has_word(lines[k]):
            k += 1
            continue
        end = k
        while end + 1 < len(lines) and has_word(lines[end + 1]):
            end += 1
        parts = license_scan.passages_of(lines[k : end + 1])
        best, score, share = model.scan(pa.array([x[-1] for x in parts]))
        ok = [x for x in range(len(parts)) if best[x] < len(license_scan.FAMILIES) and score[x] >= 0.5 and share[x] >= 0.5]
        used: set[int] = set()
        for kind in (0, 1):
            for x in ok:
                if parts[x][0] == kind and not used & set(range(parts[x][1], parts[x][2] + 1)):
                    used |= set(range(parts[x][1], parts[x][2] + 1))
                    out.append((k + parts[x][1], k + parts[x][2], model.names[best[x]]))
        begun: set[int] = set()
        for x in sorted((x for x in ok if parts[x][0] == 2), key=lambda x: (-share[x], -score[x], x)):
            if parts[x][1] not in begun and not used & set(range(parts[x][1], parts[x][2] + 1)):
                begun.add(parts[x][1])
                out.append((k + parts[x][1], k + parts[x][2], model.names[best[x]]))
        k = end + 1
    return sorted(out)


def test_licences_against_brute_force(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()][:120] + [(10**6 + k, t) for k, t in enumerate([WRAPPED, None, "", " \n\n", "x MIT License. y.\nMIT\n// GPLv2", "Text here. License: MIT. Other text."])]
    model = license_scan.train(docs)
    got = defaultdict(list)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got[r.doc_id].append((r.line, r.last_line, r.family))
    assert sum(map(len, got.values())) > 5
    for i, text in rows:
        assert sorted(got[i]) == brute_licences(model, text)


def test_licence_classes_hold_out_and_calibrate():
    """The temperature comes from wordings and parts that the first fit has not seen, and regression learns sparse rows."""
    texts, labels, held = license_scan._templates()
    assert 0.15 < np.mean(held) < 0.4 and len(set(np.array(labels)[np.array(held)])) == len(license_scan.FAMILIES)
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 300)
    rows, cols = np.repeat(np.arange(300), 2), np.stack([labels, rng.integers(3, 9, 300)], 1).ravel()
    w = license_scan._regression(rows, cols, np.ones(600), labels, 9, 3)
    z = w[cols].reshape(300, 2, 3).sum(1) + w[-1]
    assert (z.argmax(1) == labels).all()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p>First   <b>bold</b>&nbsp;text<p>Second<br>third<form>Sign up</form><div class="ad">Buy</div><ul><li>one<li>two</ul>
<section id="comments"><p>Nice post</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def alone(html):
    """The text of a page that is the only one of its host."""
    if not html:
        return ""
    tree = html_extract.parse(html)
    return html_extract.Wrapper(html_extract.Tree.unpacked(tree.packed()), frozenset(), frozenset()).text_of(tree)


def test_html_rules():
    assert alone(PAGE) == "Head & line\nFirst bold text\nSecond\nthird\none\ntwo"
    assert alone("<p>a<p>b &amp;lt; <i>c") == "a\nb &lt; c"
    assert alone("plain < text &eacute;") == "plain < text é"
    # one page says nothing about menus that are not called so: what the contract does not name stays
    assert alone('<div><a href="/">Only links here</a></div><p>Text stays.</p><script>x') == "Only links here\nText stays."


def test_html_wrapper(spark):
    page = lambda k, body: f"<html><body><div><p>Daily Gazette of the North</p></div><div><p>{body}</p><p>Story number {k} goes on and on with {k * 7} words.</p></div></body></html>"
    rows = [(k, "http://a.example/x", page(k, f"Unique opening line {k} of the article.")) for k in range(8)]
    rows += [(50 + k, "http://b.example/x", page(1, "Same page every time.")) for k in range(4)] + [(90, None, None), (91, "odd", "<p>x</p>"), (91, "odd", "<p>x</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_extract.extract(frame).collect()}
    assert got[3] == "Unique opening line 3 of the article.\nStory number 3 goes on and on with 21 words."
    # copies of one page say nothing about a template
    assert got[51].startswith("Daily Gazette") and got[90] == "" and got[91] == "x"
    assert html_extract.extract(frame).count() == len(rows) and html_extract.extract(frame.limit(0)).collect() == []


def test_html_wrappers_joined_when_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "MOST_BROADCAST", -1)
    test_html_wrapper(spark)


def brute_match(a, b, p=0, q=0):
    """Simple tree matching by its recurrence."""
    if a.names[p] != b.names[q]:
        return 0
    x, y = a.kids[p], b.kids[q]
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x):
        for j, d in enumerate(y):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + brute_match(a, b, c, d))
    return 1 + m[-1][-1]


def random_tree(rng, size):
    tree = html_extract.Tree()
    for _ in range(size):
        tree.add(rng.choice([1, 2, 3]), rng.choice(range(max(0, len(tree.names) - 6), len(tree.names))), 0)
    return tree


@pytest.mark.parametrize("seed", range(40))
def test_tree_matching_is_largest(seed):
    rng = random.Random(seed)
    a, b = random_tree(rng, rng.randrange(0, 24)), random_tree(rng, rng.randrange(0, 24))
    if seed % 3 == 0:
        b = html_extract.Tree.unpacked(a.packed())
        for _ in range(4):
            b.add(rng.choice([1, 2]), rng.randrange(len(b.names)), 0)
    slots, n = html_extract.align(a, b)
    assert n == brute_match(a, b) == sum(q >= 0 for q in slots)
    for p, q in enumerate(slots):
        if p and q >= 0:
            assert a.names[p] == b.names[q] and slots[a.parents[p]] == b.parents[q]
    for kids in a.kids:
        matched = [slots[c] for c in kids if slots[c] >= 0]
        assert matched == sorted(set(matched))


def test_wide_nodes_match_by_number(monkeypatch):
    monkeypatch.setattr(html_extract, "WIDE", 0)
    for seed in range(20):
        rng = random.Random(seed)
        a, b = random_tree(rng, 30), random_tree(rng, 30)
        slots, n = html_extract.align(a, b)
        assert sum(q >= 0 for q in slots) == n <= brute_match(a, b)
        for kids in a.kids:
            matched = [slots[c] for c in kids if slots[c] >= 0]
            assert matched == sorted(set(matched))


def test_deep_and_wide_pages_end(spark):
    import time

    deep = lambda k: "<div>" + f"<span class=s{k % 2}>" * 5000 + f"<p>deep {k}</p>" + "<i>" * 5000 + f"tail {k}"
    wide = lambda k: "<html><body>" + "".join(f"<div><b>{j + k}</b><p>w{(j + 1) * (k + 1)}</p></div>" + "<hr>" * (j % 3 == k % 3) for j in range(10000)) + "</body></html>"
    rows = [(k, "http://deep.example/", deep(k)) for k in range(4)] + [(10 + k, "http://wide.example/", wide(k)) for k in range(4)]
    start = time.time()
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "deep 2\ntail 2" and len(got[11].split("\n")) == 20000 and time.time() - start < 60


def gazette(k, body):
    """A page without a marked article: a name, a menu and a line below on every page, and two paragraphs of its own."""
    menu = "".join(f'<li><a href="/{x}">{x} {k if x == "today" else ""}</a></li>' for x in ("home", "world", "today"))
    own = "".join(f"<p>{x}</p>" for x in body)
    return f"<html><body><div><p>Daily Gazette of the North</p><ul>{menu}</ul></div><div>{own}</div><div><p>Printed in the old town since 1890.</p></div></body></html>"


def test_wrapper_decides_on_hosts_without_article_marks(spark):
    """Template texts and menus go on every page of the host, however many pages it has; without the wrapper they stay."""
    bodies = {k: [f"Opening line {k} of this story.", *(f"Line {k}-{j} goes on and on." for j in range(k % 4))] for k in range(60)}
    rows = [(k, "http://g.example/x", gazette(k, b)) for k, b in bodies.items()]
    # one page's paragraph equals another's, and copies of a page count once
    rows += [(100 + k, "http://g.example/copy", gazette(7, bodies[7])) for k in range(30)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(b) for k, b in bodies.items()) and got[115] == got[7]
    changed = sum(alone(html) != got[k] for k, _, html in rows)
    assert changed == len(rows)


def test_template_goes_from_marked_articles_too(spark):
    """Slots of an article are judged over all pages of the layout; links in it and texts that vary stay."""
    own = lambda k: [f"Opening line {k} of this story.", *(f"Line {k}-{j} goes on and on." for j in range(k % 3)), f"More on {k}"]
    page = lambda k: "<html><body><nav>Menu</nav><article><p>Read by our own staff.</p>" + "".join(f"<p>{x}</p>" for x in own(k)[:-1]) + f'<div><a href="/{k}">{own(k)[-1]}</a></div></article></body></html>'
    rows = [(k, "http://m.example/x", page(k)) for k in range(40)] + [(90, "http://two.example/x", page(1)), (91, "http://two.example/x", page(2))]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(own(k)) for k in range(40))
    assert got[90] == "\n".join(["Read by our own staff.", *own(1)])


def test_near_copies_of_one_page_have_no_template(spark):
    text = [f"Sentence {j} of the only page." for j in range(20)]
    rows = [(k, "http://c.example/", "<body>" + "".join(f"<p>{x if j != k else 'edited'}</p>" for j, x in enumerate(text)) + "</body>") for k in range(12)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "\n".join(x if j != k else "edited" for j, x in enumerate(text)) for k in range(12))


def test_every_page_goes_through_its_wrapper(spark, sf_dir, monkeypatch):
    """On the real pages every kept block stands in a content slot, or in an element of one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    wrappers = {(r.host, r.layout): html_extract.read_wrapper(r.asDict(recursive=True)) for r in html_extract.induce(html_extract.shapes(pages.withColumn("host", html_extract.host_of("url")).select("page_id", "host", "html"))).collect()}
    for r in pages.withColumn("host", html_extract.host_of("url")).collect():
        page = html_extract.parse(r.html)
        wrapper = wrappers[r.host, page.layout()]
        assert wrapper.text_of(page) == got[r.page_id]
        nothing = html_extract.Wrapper(wrapper.tree, frozenset(), frozenset())
        nothing.content = [False] * len(nothing.content)
        left = nothing.text_of(page)
        assert left != got[r.page_id] or not got[r.page_id]
