from __future__ import annotations

import random

import pytest

LETTERS = "the of and to in that is was for with on by at from this have not are but they which one you were all their there been many".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(LETTERS) + rng.choice(["", "s", "ed", "ing", "er"]) + str(rng.randrange(40)) * (rng.random() < 0.5) for _ in range(words))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and very long texts, repeated rows, exact and near copies, shared passages; names clash with the operators' own."""
    rng = random.Random(5)
    out: list[tuple] = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four"), (6, "one two three four"), (7, "One two THREE four")]
    base = prose(rng, 120)
    passage = prose(rng, 30)
    for k in range(30):
        w = base.split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        out.append((100 + k, " ".join(w)))
    for k in range(30):
        out.append((200 + k, prose(rng, rng.randrange(3, 60)) + "\n" + passage + ".\n" + prose(rng, rng.randrange(3, 60))))
    out += [(300 + k, base.upper() if k % 2 else base) for k in range(12)]
    out.append((400, "\n".join(prose(rng, 20) for _ in range(1500))))
    out.append((401, "é ñ ß " * 50))
    out += [out[-2], out[20]]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, (None, "a", "b", "c")[(i or 0) % 4], (None, "en", "de")[i % 3], 0 if t is None else len(t), -1, 9.0, "x", [1]) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, n long, score double, id string, tokens array<int>")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
