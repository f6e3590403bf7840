"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text (``FEATURES``): densities of a fixed insult lexicon and of a lexicon learned from the labels (words, and word
stems of 4 and 6 bytes, weighted by smoothed log odds), their strongest weights, lexicon words near a second-person pronoun,
shares of capitals and of words in capitals, densities of punctuation marks, and rates of obfuscation (digits or symbols within
words, letters set apart by dots).  Words are runs of letters; in them digits and @ that stand for letters are read as these.

The lexicon and the trees see labels of the training rows only.  The rows are dealt into two folds: each fold's features come from
the other fold's lexicon, each fold's raw scores from trees grown on the other, and isotonic regression on these raw scores
gives the calibration; the final lexicon and trees use both folds.  Trees and calibration weigh each training row by the labelled rows
of its class that it stands for, so scores follow the share of toxic rows among all labels, however few of them are sampled.

Edge cases: a null text is empty; empty texts get a score like any other; without training rows of both classes every score is the
share of toxic rows (0 without rows); ties and repeated rows are scored alike; an empty table gives an empty result; further
columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hashed_rows, lean, small_batches
from .textkernel import U64, Words, buffers, mix64, slices

#: Training rows of each class at most, those with the smallest hash of the id, and bytes of such a row's text.
ROWS_PER_CLASS, MOST_BYTES = 2000, 1 << 16
# Common insults, and second-person pronouns, in four languages.
INSULTS = "arschloch bastard bitch clown connard cretin cunt dickhead disgusting dumb dummkopf estúpido fuck garbage hijueputa idiot idiota idioten imbécile imbécil jerk loser merde mierda moron pathetic puta salope scheiße scum shit stupid stupide trash tonto ugly whore worthless wichser".split()
PRONOUNS = "du dich dein dir euch ihr sie te ti toi ton tu tus tuyo usted ustedes vos votre vosotros vous you your yours youre yourself u".split()
NEAR = 6
FEATURES = (
    "insult_density", "learned_density", "learned_words", "word_max", "stem4_max", "stem6_max", "stem4_density", "stem6_density", "top3_sum",
    "near_second_person", "second_person_density", "capitals", "shouted_words", "exclaims", "questions", "marks", "obfuscated", "log_words",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(64, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[ord(c) for c in "0134578@"]] = [ord(c) for c in "oieastba"]


def _fixed(words: list[str]) -> np.ndarray:
    return np.sort(_hashes(pa.array(words))[0])


def _hashes(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Word hashes, 4- and 6-byte stem hashes, word offsets, words and bytes of the texts."""
    raw, offsets = buffers(texts)
    w = Words(_FOLD[raw], offsets, ~_LETTER)
    full, length = w.hashes(), w.length
    stems = []
    for k in (4, 6):
        w.length = np.minimum(length, k)
        stems.append(mix64(w.hashes() + U64(k)))
    w.length = length
    return full, stems[0], stems[1], w.offsets, w, raw, offsets


@dataclass
class Lexicon:
    """Sorted hashes of words, 4-byte and 6-byte stems, with their weights."""

    keys: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]

    def weigh(self, k: int, hashes: np.ndarray) -> np.ndarray:
        keys = self.keys[k]
        if not len(keys) or not len(hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, self.weights[k][at], 0.0)


def learn_lexicon(texts: pa.Array, toxic: np.ndarray, least: int = 3, weight: float = 1.5) -> Lexicon:
    """Words and stems that occur in at least `least` toxic texts and whose log odds are at least `weight`."""
    found = _hashes(texts)
    ids = np.repeat(np.arange(len(texts)), np.diff(found[3]))
    keys, weights = [], []
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    for h in found[:3]:
        u, inv = np.unique(h, return_inverse=True)
        pair = np.unique(inv.astype(np.int64) * len(texts) + ids)
        word, text = np.divmod(pair, max(1, len(texts)))
        one = np.bincount(word[toxic[text]], minlength=len(u))
        zero = np.bincount(word[~toxic[text]], minlength=len(u))
        odds = np.log((one + 0.5) / (n1 + 1)) - np.log((zero + 0.5) / (n0 + 1))
        # the share of toxic texts tells a lexicon word from a name that few texts share
        odds *= one / (one + 6.0)
        keep = (one >= least) & (odds >= weight)
        keys.append(u[keep])
        weights.append(odds[keep])
    return Lexicon(tuple(keys), tuple(weights))


_INSULTS, _PRONOUNS = _fixed(INSULTS), _fixed(PRONOUNS)


def _member(sorted_keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _maxima(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(values, offsets[:-1][full])
    return out


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    full, stem4, stem6, at, w, raw, offsets = _hashes(texts)
    n = np.maximum(np.diff(at), 1)
    insult = _member(_INSULTS, full)
    you = _member(_PRONOUNS, full)
    a, b, c = (lexicon.weigh(k, h) for k, h in enumerate((full, stem4, stem6)))
    hit = insult | (a > 0) | (b > 2.5) | (c > 2)
    # distance to the nearest pronoun of the same text, by running maxima of their places
    place = np.arange(len(full))
    ids = np.repeat(np.arange(len(n)), np.diff(at))
    before = np.maximum.accumulate(np.where(you, place, -(10**9))) if len(full) else place
    after = np.minimum.accumulate(np.where(you, place, 10**9)[::-1])[::-1] if len(full) else place
    first, last = (at[:-1][ids], at[1:][ids]) if len(full) else (place, place)
    near = hit & (((place - before <= NEAR) & (before >= first)) | ((after - place <= NEAR) & (after < last)))
    best = np.maximum(np.maximum(a, b), c)
    strong = best > 2.5
    size = np.maximum(np.diff(offsets), 1)
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    caps = np.concatenate([[0], np.cumsum(upper)])
    shout = (caps[w.start + w.length] - caps[w.start] == w.length) & (w.length > 2)
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57) | (raw == 64))])
    inner = digit[w.start + w.length] - digit[w.start]
    obfuscated = (inner > 0) & (inner < w.length)
    single = w.length == 1
    apart = single.copy()
    apart[1:] &= single[:-1] & (w.start[1:] - w.start[:-1] == 2)
    letters = np.maximum(_sums(upper, offsets) + _sums(lower, offsets), 1)
    marks = _LETTER[raw] | np.isin(raw, np.frombuffer(b" \n\t\r", np.uint8))
    cols = [
        _sums(insult, at) / n, _sums(a, at) / n, _sums(a > 0, at), _maxima(a, at), _maxima(b, at), _maxima(c, at), _sums(b, at) / n, _sums(c, at) / n, _sums(np.where(strong, best, 0), at),
        _sums(near, at), _sums(you, at) / n, _sums(upper, offsets) / letters, _sums(shout, at) / n, _sums(raw == 33, offsets) / n, _sums(raw == 63, offsets) / n, _sums(~marks, offsets) / size,
        _sums(obfuscated | apart, at) / n, np.log1p(np.diff(at)),
    ]
    return np.stack(cols, 1)


class Trees:
    """Gradient boosting on the logistic loss: trees of a fixed depth over quantile bins, Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Trees:
        """Weights count relative to their mean."""
        weight = np.ones(len(y)) if weight is None else weight / weight.mean()
        share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        q = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)
        raw = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(q, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9))
            self.trees.append(tree)
            raw += self._leaf(tree, x)
        return self

    def _grow(self, q: np.ndarray, g: np.ndarray, h: np.ndarray) -> list:
        """Heap of (feature, cut, value): an inner node's rows with x <= cut go to child 2k + 1."""
        tree: list = [None] * (2 ** (self.depth + 1) - 1)
        rows = {0: np.arange(len(g))}
        for node in range(len(tree)):
            own = rows.pop(node, None)
            if own is None:
                continue
            gs, hs = g[own].sum(), h[own].sum()
            best = (1e-6, None)
            if node < 2**self.depth - 1:
                for j, cuts in enumerate(self.cuts):
                    if not len(cuts):
                        continue
                    lg = np.cumsum(np.bincount(q[own, j], g[own], len(cuts) + 1))[:-1]
                    lh = np.cumsum(np.bincount(q[own, j], h[own], len(cuts) + 1))[:-1]
                    gain = lg**2 / (lh + self.ridge) + (gs - lg) ** 2 / (hs - lh + self.ridge) - gs**2 / (hs + self.ridge)
                    ok = (lh > self.least * 0.05) & (hs - lh > self.least * 0.05)
                    k = int(np.argmax(np.where(ok, gain, -1)))
                    if ok[k] and gain[k] > best[0]:
                        best = (gain[k], (j, k))
            if best[1] is None:
                tree[node] = (-1, 0.0, float(-self.rate * gs / (hs + self.ridge)))
            else:
                j, k = best[1]
                left = q[own, j] <= k
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
                tree[node] = (j, float(self.cuts[j][k]), 0.0)
        return tree

    @staticmethod
    def _leaf(tree: list, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), {0: np.arange(len(x))}
        for node, spec in enumerate(tree):
            own = rows.pop(node, None)
            if own is None or spec is None:
                continue
            j, cut, value = spec
            if j < 0:
                out[own] = value
            else:
                left = x[own, j] <= cut
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._leaf(t, x) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: knots and values of the non-decreasing fit."""
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order].astype(float)
    ws = np.ones(len(x)) if weight is None else weight[order]
    blocks: list[list[float]] = []
    for a, b, w in zip(xs.tolist(), ys.tolist(), ws.tolist(), strict=True):
        blocks.append([b, w, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, n, _, hi = blocks.pop()
            u, m, lo, _ = blocks[-1]
            blocks[-1] = [(u * m + v * n) / (m + n), m + n, lo, hi]
    knots = np.array([z for b in blocks for z in (b[2], b[3])])
    return knots, np.array([z for b in blocks for z in (b[0], b[0])])


@dataclass
class Scorer:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        return np.clip(np.interp(self.trees.raw(features(texts, self.lexicon)), self.knots, self.values), 0, 1)


def fit(texts: pa.Array, toxic: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None) -> Scorer:
    """fold: 0 or 1 for each row; weight: the labelled rows that each row stands for."""
    toxic = toxic.astype(bool)
    weight = np.ones(len(toxic)) if weight is None else weight
    share = float(np.average(toxic, weights=weight)) if len(toxic) else 0.0
    parts = [np.flatnonzero(fold == k) for k in (0, 1)]
    if not all(0 < toxic[p].sum() < len(p) for p in parts):
        return Scorer(Lexicon((), ()), None, np.zeros(0), np.zeros(0), share)
    take = lambda p: texts.take(pa.array(p))
    x = np.zeros((len(toxic), len(FEATURES)))
    for own, other in (parts, parts[::-1]):
        x[own] = features(take(own), learn_lexicon(take(other), toxic[other]))
    raw = np.zeros(len(toxic))
    for own, other in (parts, parts[::-1]):
        raw[own] = Trees().fit(x[other], toxic[other], weight[other]).raw(x[own])
    knots, values = isotonic(raw, toxic, weight)
    return Scorer(learn_lexicon(texts, toxic), Trees().fit(x, toxic, weight), knots, values, share)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS, most_bytes: int = MOST_BYTES) -> Scorer:
    """Fits on at most rows_per_class labelled rows of each class, of texts of most_bytes at most, chosen by a hash of the id and weighted back to their class's count."""
    known = labels.select(F.col(id_col).alias("d"), F.col(label_col).cast("int").alias("y")).filter("d IS NOT NULL AND y IN (0, 1)").groupBy("d").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    ids = hashed_rows(known, "y", "d", rows_per_class)
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).filter(F.coalesce(F.octet_length("t"), F.lit(0)) <= most_bytes)
    sample = rows.join(F.broadcast(ids), "d").toArrow().sort_by([("h", "ascending"), ("d", "ascending")])
    hashes, toxic = (np.asarray(sample.column(c).combine_chunks(), np.int64) for c in ("h", "y"))
    keep = np.sort(np.concatenate([np.flatnonzero(toxic == y)[:rows_per_class] for y in (0, 1)])).astype(np.int64)
    toxic, fold = toxic[keep], hashes[keep] & 1
    # labelled rows that a sampled one stands for
    stands = np.array([max(1.0, counts.get(y, 0) / max(1, np.count_nonzero(toxic == y))) for y in (0, 1)])
    return fit(sample.column("t").combine_chunks().take(pa.array(keep)).fill_null(""), toxic, fold, stands[toxic])


def score(docs: DataFrame, model: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for b in slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([b.column("d"), pa.array(shipped.value.score(b.column("t").fill_null("")))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(lean(run), "doc_id long, score double")
