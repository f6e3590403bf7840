"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from llm.shared import saved

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema))
    before = docs
    names = []
    for name, stage in pipeline.STAGES:
        after = saved(stage(spark, before, sf_dir))
        names.append(name)
        if name != pipeline.STAGES[-1][0]:
            assert after.columns == pipeline.COLUMNS
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "language_id":
            assert before.count() - after.count() == 2
        if name == "line_dedup":
            lines = [x for r in after.orderBy("doc_id").collect() for x in r.text.split("\n") if len(re.findall(r"[^\x20\x09-\x0D]+", x)) >= 5]
            assert max(Counter(lines).values()) == 1
        if name == "ngram_jaccard":
            from llm import ngram_jaccard

            groups = {r.component_id for r in ngram_jaccard.join(before).collect()}
            assert ids == groups
        if name == "source_mixing":
            assert Counter(r.doc_id for r in after.select("doc_id").collect()).most_common(1)[0][1] <= 3
        if name == "bestfit_packing":
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
            assert {r.doc_id for r in before.select("doc_id").collect()} == ids
        before = after
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "source_mixing", "bestfit_packing"]


def brute_pipeline(rows, folds):
    """(doc_id, piece, start, length, ids_crc32) of every packed piece, by plain Python, stage by stage."""
    from test_joins import shingles, smallest, words
    from test_texts import WORDS, brute_code_length

    # language ID: the trees see rows of the right fold that have a language
    training = defaultdict(list)
    for i, t, lang, _ in rows:
        if t is not None and lang is not None and folds[i] != 2:
            training[lang].append(t)
    kept = {}
    for i, t, _, source in rows:
        if t and any(map(str.isalpha, t)) and min(brute_code_length(own, t) for own in training.values()) < 8.0 * len(t.encode()):
            kept[i] = t, source
    # line dedup
    seen, cut = [], {}
    for i in sorted(kept):
        stay = []
        for line in kept[i][0].split("\n"):
            w = words(line)
            own = shingles(line) if len(w) >= 5 else {tuple(w)} if w else set()
            if not (own and any(100 * len(own & o) >= 80 * len(own | o) for o in seen)):
                stay.append(line)
            if own:
                seen.append(own)
        if len(stay) == len(kept[i][0].split("\n")) or any(words(x) for x in stay):
            cut[i] = "\n".join(stay), kept[i][1]
    # one document of each group of near copies
    sets = {i: shingles(t) for i, (t, _) in cut.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = smallest(sets, links)
    docs = {i: x for i, x in cut.items() if root[i] == i}
    # mixing: how often each document is there
    size = {i: len(re.findall(WORDS, t)) for i, (t, _) in docs.items()}
    by = defaultdict(list)
    for i in sorted(docs, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        by[docs[i][1]].append(i)
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in by[s]) for s in by}
    target, open_, left = {}, set(by), float(sum(total.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * total[s]}
        for s in full or open_:
            target[s] = 3.0 * total[s] if full else level * weight[s]
            left -= target[s]
        open_ -= full or open_
    times = {}
    for s, ids in by.items():
        at = 0
        for i in ids:
            taken = [min(size[i], max(0, int(target[s]) - p * total[s] - at)) for p in range(4)]
            times[i] = sum(n > 0 and 2 * n >= size[i] for n in taken)
            at += size[i]
    # packing: pieces of at most 2048 ids, the first one the shorter
    tokens, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, n in times.items():
        ids = np.array(tokens.encode(docs[i][0], add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            out[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += n
    return +out


def test_run_against_brute_force(spark, rows, tmp_path):
    first = {}
    for i, t in rows:
        if i != 400:
            first.setdefault(i, t)
    first[900] = "word " * 5000
    table = [(i, t, (None, "en", "de")[i % 3], (None, "a", "b", "c")[i % 4]) for i, t in first.items()]
    frame = spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in table], "doc_id long, text string, lang string, source string, n_chars long, id int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    folds = {i: zlib.crc32(str(i).encode()) % 4 for i in first}
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute_pipeline(table, folds)
    ends = Counter()
    for r in got:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert max(ends.values()) <= 2048 and sum(ends.values()) == sum(r.length for r in got)


@pytest.mark.parametrize("stage", pipeline.STAGES, ids=lambda s: s[0])
def test_stages_of_odd_tables(spark, stage):
    """Empty tables, nulls in any column, repeated rows and columns with the operators' names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, component_id long, score double, line int"
    name, run = stage
    assert run(spark, spark.createDataFrame([], schema), "").collect() == []
    text = "the harbour was quiet and nobody saw the boats leave in the morning of that day"
    odd = [(1, text, "en", "a", 9, 1, 1, 1.0, 1)] * 2 + [(None, text + " or later", None, None, None, None, None, None, None), (2, None, "en", "a", 0, 1, 1, 1.0, 1), (3, "", None, "b", None, 1, 1, 1.0, 1), (4, "word " * 70000, "en", None, 5, 1, 1, 1.0, 1), (5, text.upper(), "en", "b", 5, 1, 1, 1.0, 1)]
    out = run(spark, spark.createDataFrame(odd, schema), "")
    got = out.collect()
    ids = Counter(r.doc_id for r in got)
    if name != "bestfit_packing":
        assert out.columns == pipeline.COLUMNS
    if name == "language_id":
        assert ids == Counter({1: 2, None: 1, 4: 1, 5: 1}) and all(r.lang == "en" for r in got)
    if name == "line_dedup":
        assert ids[1] == 2 and ids[4] == 1 and ids[5] == 0
    if name == "ngram_jaccard":
        assert ids[1] == 2 and ids[None] == 1 and ids[2] == ids[3] == ids[4] == 1 and ids[5] == 0
    if name == "source_mixing":
        assert set(ids) <= {None, 1, 4, 5} and ids[4] >= 1
    if name == "bestfit_packing":
        assert sum(r.length for r in got if r.doc_id == 2) == 1 and ids[4] > 30


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_mixing_matches_sql(spark, sf_dir):
    from oracle import same

    from llm import queries

    ours, theirs = same(spark, sf_dir, queries.QUERIES["op6_source_mixing"], queries.SQL["op6_source_mixing"])
    assert ours == theirs
