"""Language identification by prediction by partial matching (PPM).

For each language, a variable-order context tree over bytes: contexts of 3, 2, 1 and 0 bytes with escape probabilities of
method C.  In a context that was followed by ``t`` bytes, ``d`` of them different, a byte seen ``c`` times gets ``c / (t + d)``
and the escape to the next shorter context ``d / (t + d)``; a context never seen costs nothing; below order 0 all 256 bytes are
equally likely.  Statistics are frozen after fitting, so a text's code length in a language is a sum over its bytes, each
looked up in tables of the strings that any language's tree has.  The language with the shortest code wins; the score is its
posterior probability under equal priors.

Texts are lower-cased, and each begins after three zero bytes.  The trees grow from at most ``rows_per_language`` rows of each language,
none with a text over ``most_bytes``.

Edge cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0, as is everything if there are no
training rows; the smallest name wins ties; repeated rows are scored alike; an empty table gives an empty result; further
columns are ignored by predict and passed through by annotate.  Whole texts are read, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hashed_rows, lean, small_batches
from .textkernel import U64, buffers, mix64, slices

#: Training rows of each language at most, those with the smallest hash of the id, and bytes of such a row's text.
ROWS_PER_LANGUAGE, MOST_BYTES = 400, 1 << 16
_ORDER = 3


class Places:
    """Where numbers stand in a sorted array: hash tables in which every number has a slot of its own in one of them."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        while len(left):
            bits = max(4, int(4 * len(left)).bit_length())
            odd = mix64(np.array([len(self.tables) + 11], U64))[0] | U64(1)
            table = np.full(1 << bits, -1, np.int32)
            slot = keys[left].astype(U64) * odd >> U64(64 - bits)
            table[slot] = left
            self.tables.append((odd, U64(64 - bits), table))
            left = left[table[slot] != left]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """-1 where a number is not there."""
        out, left = np.full(len(wanted), -1, np.int64), np.arange(len(wanted))
        for odd, shift, table in self.tables:
            value = wanted[left]
            at = table[value.astype(U64) * odd >> shift]
            hit = (at >= 0) & (self.keys[at] == value)
            out[left[hit]] = at[hit]
            # a number that is in a later table met another one here
            left = left[~hit & (at >= 0)]
            if not len(left):
                break
        return out


@dataclass
class PPM:
    """Frozen statistics: code lengths, by language, of 2-byte strings, of the 3- and 4-byte strings seen, and of escapes from contexts.

    Strings are numbers with the last byte lowest.  cost2, escape2: by all 2-byte strings; seen3 and cost3, seen4 and cost4: strings that
    any tree has; context3 and escape3: the contexts of order 3 that any tree has.
    """

    languages: list[str]
    cost2: np.ndarray
    escape2: np.ndarray
    seen3: np.ndarray
    cost3: np.ndarray
    context3: np.ndarray
    escape3: np.ndarray
    seen4: np.ndarray
    cost4: np.ndarray
    _places: tuple[Places, ...] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_places": None}

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text (lower-cased here) in each language."""
        if self._places is None:
            self._places = tuple(map(Places, (self.seen4, self.context3, self.seen3)))
        codes, begin = _codes(texts)
        if not len(codes):
            return np.zeros((len(texts), len(self.languages)))
        strings = _packed(codes, _ORDER + 1)
        at = self._places[0].find(strings)
        bits = self.cost4[at]
        new = np.flatnonzero(at < 0)
        bits[new] = self._escaped(strings[new])
        bits[_heads(begin)] = 0
        return np.add.reduceat(bits, begin[:-1], axis=0, dtype=np.float64)

    def _escaped(self, strings: np.ndarray) -> np.ndarray:
        """Bits of 4-byte strings that no tree has."""
        out = np.zeros((len(strings), len(self.languages)), np.float32)
        at = self._places[1].find(strings >> np.uint32(8))
        known = np.flatnonzero(at >= 0)
        out[known] = self.escape3[at[known]]
        three = strings & np.uint32(0xFFFFFF)
        at = self._places[2].find(three)
        known, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        out[known] += self.cost3[at[known]]
        out[new] += self.escape2[three[new] >> np.uint32(8)] + self.cost2[three[new] & np.uint32(0xFFFF)]
        return out


def _heads(begin: np.ndarray) -> np.ndarray:
    return (begin[:-1, None] + np.arange(_ORDER)).ravel()


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, three zeros before each, and the n + 1 offsets."""
    raw, offsets = buffers(pc.utf8_lower(texts))
    n = len(offsets) - 1
    begin = offsets + _ORDER * np.arange(n + 1)
    out = np.zeros(begin[-1] if n else 0, np.uint8)
    where = np.ones(len(out), bool)
    if n:
        where[_heads(begin)] = False
    out[where] = raw
    return out, begin


def _packed(codes: np.ndarray, k: int) -> np.ndarray:
    """At each place, the k bytes that end there as one number."""
    out = codes.astype(np.uint32)
    for j in range(1, k):
        out[j:] |= codes[:-j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _order(codes: np.ndarray, begin: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of order + 1 bytes of one language's texts and their bits; their contexts and the bits of the escape from each."""
    inside = np.ones(len(codes), bool)
    inside[_heads(begin)] = False
    strings, counts = np.unique(_packed(codes, order + 1)[inside], return_counts=True)
    context, first, kinds = np.unique(strings >> np.uint32(8), return_index=True, return_counts=True)
    total = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    return strings, -np.log2(counts / np.repeat(total + kinds, kinds)), context, -np.log2(kinds / (total + kinds))


def _fill(seen: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], base: np.ndarray | float = 0.0) -> np.ndarray:
    """By string in seen and language: the language's value, else the base."""
    out = np.empty((len(seen), len(tables)))
    out[:] = base
    for k, (strings, values) in enumerate(tables):
        out[np.searchsorted(seen, strings), k] = values
    return out


def fit(texts: pa.Array, languages: list[str]) -> PPM:
    """Trees from labelled texts, one for each language."""
    names = sorted(set(languages))
    own = [_codes(texts.take(pa.array([i for i, x in enumerate(languages) if x == name]))) for name in names]
    trees = [[_order(*codes, k) for codes in own] for k in range(_ORDER + 1)]
    strings, escapes = [[t[:2] for t in tree] for tree in trees], [[t[2:] for t in tree] for tree in trees]
    union = lambda parts: np.unique(np.concatenate([p[0] for p in parts])) if parts else np.zeros(0, np.uint32)
    one, two = np.arange(256), np.arange(1 << 16)
    cost1 = _fill(one, strings[0], _fill(one[:1], escapes[0]) + 8.0)
    cost2 = _fill(two, strings[1], _fill(one, escapes[1])[two >> 8] + cost1[two & 0xFF])
    escape2 = _fill(two, escapes[2])
    seen3, context3, seen4 = union(strings[2]), union(escapes[3]), union(strings[3])
    cost3 = _fill(seen3, strings[2], escape2[seen3 >> np.uint32(8)] + cost2[seen3 & np.uint32(0xFFFF)])
    escape3 = _fill(context3, escapes[3])
    # the last three bytes of a string that is there are there too, in the same language's tree
    cost4 = _fill(seen4, strings[3], escape3[np.searchsorted(context3, seen4 >> np.uint32(8))] + cost3[np.searchsorted(seen3, seen4 & np.uint32(0xFFFFFF))])
    return PPM(names, *(x.astype(np.float32) if x.dtype == np.float64 else x for x in (cost2, escape2, seen3, cost3, context3, escape3, seen4, cost4)))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, most_bytes: int = MOST_BYTES) -> PPM:
    """Fits on at most rows_per_language rows of each language, chosen by a hash of the id, of texts of most_bytes at most."""
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(F.octet_length("t") <= most_bytes)
    ids = hashed_rows(rows, "l", "d", rows_per_language)
    sample = rows.join(F.broadcast(ids), ["d", "l"]).toArrow().sort_by([("l", "ascending"), ("h", "ascending"), ("d", "ascending")])
    names = sample.column("l").to_pylist()
    keep = [k for k in range(len(names)) if k < rows_per_language or names[k - rows_per_language] != names[k]]
    return fit(sample.column("t").take(pa.array(keep, pa.int64())).combine_chunks(), [names[k] for k in keep])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: PPM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score and bits_per_byte, the code length in that language."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return annotate(d, model, "text").drop("text")


def annotate(docs: DataFrame, model: PPM, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and bits_per_byte, which replace columns of these names."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "bits_per_byte")

    def run(batches):
        ppm = shipped.value
        for batch in batches:
            for b in slices(batch, text_col):
                texts = b.column(text_col)
                letters = np.array([has_letter(t) for t in texts.to_pylist()], bool)
                n = len(texts)
                if ppm.languages:
                    bits = ppm.code_lengths(texts.fill_null(""))
                    best = bits.argmin(1)
                    least = bits[np.arange(n), best]
                    score = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(1)
                    name = np.array(ppm.languages, object)[best]
                    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.float64)
                else:
                    letters, least, score, name, size = np.zeros(n, bool), np.zeros(n), np.zeros(n), np.full(n, "und", object), np.ones(n)
                name[~letters] = "und"
                score = np.where(letters, score, 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(name, pa.string()), pa.array(score), pa.array(least / np.maximum(size, 1))], [*b.schema.names, "lang_pred", "score", "bits_per_byte"])

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return docs.mapInArrow(lean(run), schema)
