"""Groups of many sets: dealt out by size, chained again and compared in waves, without losing a link."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from llm import line_dedup, ngram_jaccard, setjoin


def test_blocks_meet_only_where_sizes_allow_links(spark):
    sizes = [10 + k * k // 40 for k in range(120)]
    members = spark.createDataFrame([(k, n, 5) for k, n in enumerate(sizes)], "id long, n long, group long")
    dealt, _ = setjoin.blocks(members, "id", 5, 1 << 40, 80)
    units: dict = {}
    for r in dealt.collect():
        units.setdefault((r.bin, r.pair), []).append(r)
    met: dict = {}
    for rows in units.values():
        for x, y in combinations(rows, 2):
            if x.side != y.side or x.inside:
                key = min(x.id, y.id), max(x.id, y.id)
                met[key] = met.get(key, 0) + 1
    fit = {(a, b) for a, b in combinations(range(120), 2) if 100 * min(sizes[a], sizes[b]) >= 80 * max(sizes[a], sizes[b])}
    assert fit <= met.keys() and set(met.values()) == {1}
    # 24 blocks that all meet would repeat each member 23 times
    assert dealt.count() < 120 * 12


def near_texts(r: random.Random) -> list[str]:
    """Texts that share tokens with many others, and near copies of a third of them, and one large group of near copies."""
    shared = [" ".join(r.choice("abcdefgh") * 2 + str(r.randrange(50)) for _ in range(12)) for _ in range(12)]
    texts = []
    for k in range(90):
        words = " ".join([*r.sample(shared, r.randint(1, 4)), *(f"own{k}-{j}" for j in range(r.randint(3, 30)))]).split()
        texts.append(" ".join(words))
        if k % 3 == 0:
            for _ in range(4):
                edited = list(words)
                edited[r.randrange(len(edited))] = f"edit{r.randrange(10**6)}"
                texts.append(" ".join(edited))
    base = [f"base{j}" for j in range(120)]
    for _ in range(60):
        edited = list(base)
        edited[r.randrange(120)] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(edited))
    return texts


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


@pytest.fixture
def rounds(monkeypatch):
    """Blocks of few sets, waves of few tokens and short prefixes; a list of the times that refined() chains again."""
    found = []
    inner = setjoin.candidate_groups
    monkeypatch.setattr(setjoin, "candidate_groups", lambda *a: found.append(a) or inner(*a))
    monkeypatch.setattr(setjoin, "WAVE_TOKENS", 4000)
    for module in (ngram_jaccard, line_dedup):
        monkeypatch.setattr(module, "BLOCK_SETS", 3)
        monkeypatch.setattr(module, "PART", 1000)
    return found


def links_of(texts: list[str]) -> list[tuple[int, int]]:
    sets = [shingles(t) for t in texts]
    return [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]


def test_large_groups_of_documents_keep_all_links(spark, rounds):
    texts = near_texts(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label, links = list(range(len(texts))), links_of(texts)
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.doc_id: r.component_id for r in ngram_jaccard.join(docs).collect()} == dict(enumerate(label))
    assert rounds


def test_large_groups_of_lines_keep_all_matches(spark, rounds):
    texts = near_texts(random.Random(3))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.repeated_lines(docs, short=True).collect()} == {b for _, b in links_of(texts)}
    assert rounds


@pytest.mark.parametrize("each", [1, 10**9])
def test_waves_hold_a_bounded_part_of_the_sets(spark, monkeypatch, each):
    """However many classes there are, a wave reads and repeats only its own share of the table's tokens."""
    members = spark.createDataFrame([(k, 100, k // 4) for k in range(400)], "id long, n long, group long")
    pairs = members.selectExpr("id", "n", "group AS bin", "-1L AS pair", "0 AS side", "true AS inside")
    monkeypatch.setattr(setjoin, "WAVE_TOKENS", 1)
    monkeypatch.setattr(setjoin, "SETS_TOKENS", 1)
    asked = []

    def read(some):
        asked.append(sorted(r.id for r in some.select("id").collect()))
        return members.selectExpr("id", "cast('x' AS binary) AS tokens")

    compare = lambda t: t.select(["id"]).rename_columns(["a"])
    got = setjoin.compared(pairs, members, read, ["id"], 4, 4 * 4000 if each == 1 else each, compare, "a long").collect()
    assert sorted(r.a for r in got) == list(range(400)) == sorted(x for ids in asked for x in ids)
    assert (len(asked) == 10 and max(map(len, asked)) < 120) if each == 1 else len(asked) == 1


def test_set_joins_leave_only_small_tables(spark):
    """What a set join has saved goes with it but for what its result is read from, so the next stage of a pipeline has the disk."""
    from pathlib import Path

    from llm.shared import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    texts = near_texts(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for work in (line_dedup.dedup, ngram_jaccard.join):
        before = set(folder.iterdir())
        assert work(docs).count() == len(texts)
        left = {c for p in set(folder.iterdir()) - before for c in spark.read.parquet(str(p)).columns if next(p.glob("*.parquet"), None)}
        assert not left & {"s1", "s2", "part", "tokens", "token"}
