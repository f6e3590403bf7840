"""The similarity joins against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from llm import embedding_dedup, line_dedup, ngram_jaccard
from llm.setjoin import PACKED, Rarity, Seen, by_rarity, chain, needed, pack, prefixes, signatures, unpack
from llm.shared import components
from llm.textkernel import distinct_flat

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def smallest(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def rarity_of(level, buckets=4):
    return Rarity(level, np.zeros(1 << 20, np.uint8), buckets)


def prefix(x, order, percent, part):
    return prefixes(x, np.array([0, len(x)]), order, percent, part)[0]


@pytest.mark.parametrize("last", [0, 40, 200_000])
def test_components(spark, monkeypatch, last):
    from llm import shared

    monkeypatch.setattr(shared, "LAST_EDGES", last)
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == smallest({x for e in edges for x in e}, edges)


def test_ngram_jaccard(docs, rows):
    got = ngram_jaccard.join(docs).collect()
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = smallest(sets, links)
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), expected[r.doc_id]) for r in got)


def test_ngram_jaccard_empty(nothing):
    assert ngram_jaccard.join(nothing).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip_finds_all(seed):
    rng = random.Random(seed)
    lists = [sorted(rng.sample(range(60), rng.randrange(0, 40))) for _ in range(25)]
    count = Counter(x for one in lists for x in one)
    flat, length = np.array([x for one in lists for x in one]), np.array([len(one) for one in lists])
    for need in (1, 3, 8, 12, 20):
        ids, common = ngram_jaccard.divide_skip(flat, length, need)
        assert dict(zip(ids.tolist(), common.tolist(), strict=True)) == {x: n for x, n in count.items() if n >= need}


@pytest.mark.parametrize("seed", range(6))
def test_connect_joins_what_brute_force_joins(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**63, 80).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(40):
        s = base[k % 4].copy()
        s[rng.integers(0, 80, rng.integers(0, 12))] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(s))
    plain = [set(s.tolist()) for s in sets]
    links = [(a, b) for a in range(40) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    assert smallest(range(40), ngram_jaccard.connect(sets, 80)) == smallest(range(40), links)


def near_copies(rng, many, size, edits):
    base = [rng.integers(0, 2**63, size).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(many):
        s = base[k % 4].copy()
        s[rng.integers(0, size, rng.integers(0, edits))] = rng.integers(0, 2**63, 1)[0]
        sets.append(np.unique(s))
    return sets


def test_every_link_comes_from_t_occurrence_search(monkeypatch):
    """Links are those that divide_skip reports: without its answers there are none, and each has the overlap that it counted."""
    sets = near_copies(np.random.default_rng(11), 120, 80, 12)
    plain, real, told = [set(s.tolist()) for s in sets], ngram_jaccard.divide_skip, []

    def counted(ids, length, need):
        found, common = real(ids, length, need)
        told.extend(common.tolist())
        return found, common

    monkeypatch.setattr(ngram_jaccard, "divide_skip", counted)
    links = ngram_jaccard.connect(sets, 80)
    assert len(links) == 116 and len(told) >= len(links)
    assert all(len(plain[a] & plain[b]) in told for a, b in links)
    monkeypatch.setattr(ngram_jaccard, "divide_skip", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert ngram_jaccard.connect(sets, 80) == []


@pytest.mark.parametrize("seed", range(3))
def test_block_pairs_find_all_links_between_them(seed):
    """Three blocks in three pairs, as blocks() deals them: together they connect what brute force connects."""
    rng = np.random.default_rng(seed)
    sets = near_copies(rng, 60, 60, 16)
    plain = [set(s.tolist()) for s in sets]
    block = rng.integers(0, 3, 60)
    found, gone = [], set()
    for i, j in ((0, 1), (0, 2), (1, 2)):
        own = np.flatnonzero((block == i) | (block == j))
        side = (block[own] == j).astype(int)
        # the pair (k, k + 1) compares block k with itself, the last one (k - 1, k)
        inside = np.where(block[own] < 2, (j == i + 1) & (block[own] == i), (i, j) == (1, 2))
        found += [(own[a], own[b]) for a, b in ngram_jaccard.connect([sets[k] for k in own], 80, side, inside)]
        gone |= {own[x] for x in line_dedup.later_matches([sets[k] for k in own], 80, side, inside)}
    links = [(a, b) for a in range(60) for b in range(a) if 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b])]
    assert smallest(range(60), found) == smallest(range(60), links)
    assert gone == {a for a, _ in links}


def test_seen_tells_true_places():
    rng = np.random.default_rng(2)
    seen = Seen(bits=3)
    first: dict = {}
    for _ in range(40):
        s1 = rng.integers(0, 12, 30)
        a, b = rng.integers(0, 500, 30), rng.integers(0, 3, 30)
        known, twin = seen.earlier(s1, s1 + 1, s1 + 2, a, b)
        for k, s in enumerate(s1.tolist()):
            first.setdefault(s, set()).add((int(a[k]), int(b[k])))
        for k in np.flatnonzero(known):
            places = first[int(s1[k])]
            assert min(places) < (a[k], b[k]) and any(p[0] == twin[k] for p in places)


def test_packed_postings_chain_as_by_hand():
    rng = np.random.default_rng(8)
    tokens = np.repeat(rng.integers(1, 2**59, 200).astype(np.uint64) << np.uint64(4), 5)
    tokens[::7] |= np.uint64(2)
    ids, sizes = rng.integers(0, 400, 1000), rng.integers(1, 30, 1000)
    sizes = (ids * 7919 % 29 + 1).astype(np.int64)
    batch = pack(tokens, ids, sizes, 8)
    got = []
    for bucket in range(8):
        import pyarrow as pa

        rows = pa.Table.from_batches([batch]).filter(pa.array([x == bucket for x in batch.column("bucket").to_pylist()]))
        if rows.num_rows:
            got.append(unpack(rows))
    t, i, n = (np.concatenate(x) for x in zip(*got, strict=True))
    assert sorted(zip(t.tolist(), i.tolist(), n.tolist(), strict=True)) == sorted(zip(tokens.tolist(), ids.tolist(), sizes.tolist(), strict=True))
    kept = {(int(np.uint64(np.int64(x))), int(y)) for y, _, x, *_ in zip(*chain(t, i, n, 80), strict=True)}
    lists: dict = {}
    for x, y, z in sorted(set(zip(tokens.tolist(), ids.tolist(), sizes.tolist(), strict=True))):
        lists.setdefault(x, []).append((z, y))
    for x, own in lists.items():
        own.sort()
        for k, (z, y) in enumerate(own):
            close = any(80 * max(z, w) <= 100 * min(z, w) for w, v in own[max(0, k - 1) : k + 2] if v != y)
            assert ((x, y) in kept) == (close or bool(x & 15))


def test_prefix_of_linked_sets_share_tokens():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 4, 1 << 20).astype(np.uint8)
    order = rarity_of(level)
    for n in (1, 4, 5, 9, 30, 200):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
        cut = x[: math.ceil(0.8 * len(x))]
        a, b = set(prefix(x, order, 80, 8).tolist()), set(prefix(cut, order, 80, 8).tolist())
        assert len(a & b) >= needed(len(cut), 8)
        assert sorted(by_rarity(x, level).tolist()) == x.tolist()


def test_many_sets_at_once():
    rng = np.random.default_rng(4)
    level = rng.integers(0, 8, 1 << 20).astype(np.uint8)
    raw = [rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) for n in (1, 3, 40, 7, 300)]
    raw[2][5] = raw[2][6] = raw[2][5]
    flat, at = distinct_flat(np.concatenate(raw), np.cumsum([0] + [len(x) for x in raw]))
    sets = [np.unique(x) for x in raw]
    assert flat.tolist() == np.concatenate(sets).tolist() and np.diff(at).tolist() == [len(s) for s in sets]
    order = rarity_of(level)
    cut, ends = prefixes(flat, at, order, 80, 16)
    assert [cut[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [prefix(s, order, 80, 16).tolist() for s in sets]
    one = [signatures(s, np.array([0, len(s)])) for s in sets]
    assert list(zip(*(x.tolist() for x in signatures(flat, at)), strict=True)) == [(int(a[0]), int(b[0])) for a, b in one]


def brute_lines(rows):
    lines = sorted({(i, k, line) for i, t in rows if t is not None for k, line in enumerate(t.split("\n"))})
    full = [(i, k, shingles(line)) for i, k, line in lines if len(words(line)) >= 5]
    gone: dict[int, set[int]] = {}
    for x, (i, k, s) in enumerate(full):
        if any(100 * len(s & o) >= 80 * len(s | o) for _, _, o in full[:x]):
            gone.setdefault(i, set()).add(k)
    return gone


def test_line_dedup(docs, rows):
    small = [(i, t) for i, t in rows if i != 400]
    gone = brute_lines(small)
    out = line_dedup.dedup(docs.filter("doc_id <> 400"))
    assert set(docs.columns) | {"n_lines_removed"} == set(out.columns)
    got = sorted(((r.doc_id, r.text, r.n_lines_removed) for r in out.collect()), key=repr)
    expected = [(i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())), len(gone.get(i, ()))) for i, t in small]
    assert got == sorted(expected, key=repr)


def test_short_lines_against_brute_force(spark):
    """Lines of 1 to 4 words match lines of equal words only; the earliest stays."""
    rng = random.Random(8)
    rows = [(k, "\n".join(" ".join(rng.choice(["a", "B", "c,", "d"]) for _ in range(rng.randrange(0, 6))) for _ in range(12))) for k in range(30)]
    seen, expected = [], {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n")):
            w = words(line)
            s = shingles(line) if len(w) >= 5 else {tuple(w)} if w else set()
            if s and any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                expected.setdefault(i, set()).add(k)
            seen.append(s)
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert got == {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in expected.get(i, ())), len(expected.get(i, ()))) for i, t in rows}


def test_line_dedup_of_texts_with_very_many_lines(spark, rows):
    many = "\n".join(f"line {k % 4000} of a text that has very many lines" for k in range(9000))
    out = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame([(1, many), (2, many)], "doc_id long, text string")).collect()}
    gone = brute_lines([(1, "\n".join(many.split("\n")[:60]))])
    assert not gone.get(1) or min(gone[1]) > 0
    assert out[2].n_lines_removed == 9000 and out[2].text == "" and out[1].n_lines_removed >= 5000


def test_line_dedup_takes_repeated_short_lines(spark):
    rows = [(1, "All rights reserved.\nLes.\n \n\none two three four"), (2, "ALL rights  reserved.\nother\n \n\none two three"), (3, "Les.\nall rights reserved.\none two three four five\none two three four")]
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("other\n \n\none two three", 1), 3: ("one two three four five", 3)}


def test_queries_take_repeated_short_lines(spark, tmp_path):
    import corpus_pipeline
    from llm import queries

    docs = spark.createDataFrame([(1, "All rights reserved.\nx", "en", "s", 22), (2, "y\nAll rights reserved.", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_lines_removed for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {1: "All rights reserved.\nx", 2: "y"}


def test_line_dedup_keeps_the_earliest_of_near_copies_repeated(spark):
    w = [f"word{k}" for k in range(40)]
    rows = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join([*w[:-1], "other"]))]
    got = sorted((r.doc_id, r.text, r.n_lines_removed) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, rows[0][1], 0), (1, rows[0][1], 0), (2, "", 1)]


def test_line_dedup_empty(nothing):
    assert line_dedup.dedup(nothing).collect() == []


def test_later_matches_keeps_first():
    a = np.arange(10, dtype=np.uint64)
    assert line_dedup.later_matches([a, a[:9], a[:5]], 80) == [1]


def unit_of(v):
    v = np.array(v, float)
    return (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())


@pytest.mark.parametrize("kind", ["double", "float"])
def test_embeddings(spark, kind):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    vectors = [centres[k % 6] + rng.normal(size=16) * 0.08 for k in range(150)] + [rng.normal(size=16) for _ in range(50)]
    vectors += [vectors[3]] * 20 + [vectors[3] * 2]
    rows = [(10 * k, [float(np.float32(x)) for x in v], k % 3) for k, v in enumerate(vectors)]
    odd = [(5, None, 0), (15, [], 0), (25, [0.0] * 16, 0), (35, [math.nan] * 16, 0), (45, [None] + [1.0] * 15, 0), (55, [1.0, 2.0], 0), (65, [2.0, 4.0], 0), (75, [math.inf] * 16, 0), (85, [float(np.float32(1e-30))] * 16, 0)]
    frame = spark.createDataFrame(rows + odd, f"vec_id long, embedding array<{kind}>, label int").withColumnRenamed("label", "unit")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    unit = {i: unit_of(v) for i, v, _ in rows + odd if v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    expected = smallest([i for i, *_ in rows + odd], links)
    count = Counter(x for e in links for x in e)
    assert len(got) == len(rows) + len(odd)
    for i, r in got.items():
        assert (r.n_links, r.component_id, r.kept) == (count[i], expected[i], i == expected[i])
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    monkeypatch.setattr(embedding_dedup, "TILE", 3)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 5)
    test_embeddings(spark, "float")


def test_embeddings_with_repeated_and_missing_ids(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x), (1, y), (2, x), (3, [0.05, 1.0, 0.0]), (4, z), (4, z), (None, z), (5, [1.0, 0.01, 0.0]), (None, None), (6, [-1.0, 0.0, 0.0]), (7, [-1.0, 0.0, 0.02]), (7, [0.0, 0.0, -1.0]), (8, [0.0, 0.02, -1.0])]
    got = sorted(((r.vec_id is None, r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=repr)
    expected = [
        (False, 1, 2, 1, True), (False, 1, 1, 1, True), (False, 2, 2, 1, False), (False, 3, 1, 1, False), (False, 4, 1, 4, True), (False, 4, 1, 4, True), (False, 5, 2, 1, False),
        (False, 6, 1, 6, True), (False, 7, 1, 6, False), (False, 7, 1, 6, False), (False, 8, 1, 6, False), (True, None, 0, None, False), (True, None, 0, None, False),
    ]
    assert got == sorted(expected, key=repr)


def test_cells_send_every_link(spark):
    """Where the triangle inequality and the witnesses rule a cell out, it holds no vector that links."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(400, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cells = embedding_dedup.Cells({4: embedding_dedup.spread(v[:60], 20)}, float(np.arccos(0.95)))
    d = cells.distances(v)
    home = d.argmin(1)
    cells.low[4], cells.high[4] = (np.stack([f(d[home == j], axis=0) if (home == j).any() else np.zeros(20) for j in range(20)]) for f in (np.min, np.max))
    row, j = cells.visits(d, 4)
    sent = set(zip(row.tolist(), j.tolist(), strict=True))
    links = [(a, b) for a in range(400) for b in range(400) if home[a] < home[b] and v[a] @ v[b] >= 0.95]
    assert links and all((a, home[b]) in sent for a, b in links) and len(sent) < 400 * 19 / 4


def test_smaller_partner_is_not_pruned(spark):
    """A set and a subset of four fifths of it: the subset's prefix has fewer tokens to share."""
    from llm.setjoin import candidate_groups

    rng = np.random.default_rng(9)
    level = np.zeros(1 << 20, np.uint8)
    rows = []
    for k, n in enumerate((10, 25, 40, 80, 100, 161)):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) << np.uint64(1))
        for j, s in enumerate((x, x[len(x) - math.ceil(0.8 * len(x)) :])):
            cut = prefix(s, rarity_of(level), 80, 8)
            rows.append((10 * k + j, pack(cut, np.full(len(cut), 10 * k + j), np.full(len(cut), len(s)), 4)))
    packed = [tuple(r.values()) for _, b in rows for r in b.to_pylist()]
    got = {r.id: r.group for r in candidate_groups(spark.createDataFrame(packed, PACKED), 80, 8).collect()}
    assert got == {i: i // 10 * 10 for i, *_ in rows}


def test_batches_are_bounded_by_bytes(spark):
    from llm.shared import BATCH_BYTES, small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for given, left in (("64m", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("100k", "100k"), ("5000", "5000")):
            spark.conf.set(key, given)
            small_batches(spark)
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)


def test_saved_tables_leave_no_shuffle_files_and_discard_goes(spark):
    from pyspark.sql import functions as F

    from llm.shared import discard, saved

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    table = saved(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert table.count() == 7 and spark.conf.get(key, None) in (None, "false")
    discard(table)
    with pytest.raises(Exception, match="(?i)not.exist|not found|FILE_NOT_EXIST"):
        table.collect()


def test_a_cluster_without_a_shared_folder_is_an_error():
    from llm.shared import shared_folder

    class Session:
        class sparkContext:
            master = "yarn"

            @staticmethod
            def getCheckpointDir():
                return None

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session)


def test_filter_holds_all_ids_and_few_others(spark):
    from llm.setjoin import id_filter, in_filter

    ids = [k * 977 for k in range(3000)] + [-5, None, 7, 7]
    packed = id_filter(spark.createDataFrame([(k,) for k in ids], "id long"))
    assert in_filter(packed, np.array([k for k in ids if k is not None])).all()
    others = np.arange(10**9, 10**9 + 20000)
    assert in_filter(packed, others).mean() < 0.15
    assert not in_filter(id_filter(spark.createDataFrame([], "id long")), others).any()


@pytest.mark.parametrize("most", [10_000, 1])
def test_samples_are_alike_however_counts_travel(spark, monkeypatch, most):
    from llm import shared

    monkeypatch.setattr(shared, "MOST_LABELS", most)
    rows = [(k, (None, "a", "b", "b", "b")[k % 5]) for k in range(2000)] + [(1, "a"), (None, "b")]
    frame = spark.createDataFrame(rows, "id long, label string")
    got = shared.hashed_rows(frame, "label", "id", 100).collect()
    count = Counter(r.label for r in got)
    assert set(count) == {"a", "b"} and all(50 < n < 130 for n in count.values()) and len({(r.id, r.label) for r in got}) == len(got)
    highest = {x: max(r.h % (1 << 31) for r in got if r.label == x) for x in count}
    sampled = {(r.id, r.label) for r in got}
    by_id = {r.id: r.h for r in got}
    assert all(by_id[i] % (1 << 31) <= highest[x] for i, x in sampled)
    assert shared.hashed_rows(frame.limit(0), "label", "id", 100).collect() == []
