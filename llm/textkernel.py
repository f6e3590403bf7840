"""Vectorised byte kernels shared by the text operators.

A batch of texts is one UTF-8 byte buffer with document offsets.  Words are maximal runs of bytes
outside ``\\x20\\x09-\\x0D``; as those are all ASCII, working on bytes equals working on code points.
Nulls are empty texts.  All functions take whole texts of any length and any batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on an array of unsigned 64-bit numbers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: Masks for the first 0 to 8 bytes of a little-endian word, and odd multipliers.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_ODD = mix64((np.arange(64, dtype=U64) + U64(7)) * U64(0xD1B54A32D192ED03)) | U64(1)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of n texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


class Words:
    """Words of a batch: first byte and length of each, and the n + 1 word offsets of the texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE):
        """between: for each byte value, whether it separates words."""
        inside = ~between[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[:-1]
        cuts = cuts[cuts < len(raw)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:-1]
        ends = ends[ends > 0] - 1
        last[ends] = inside[ends]
        self.raw, self.start = raw, np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        self.offsets = np.searchsorted(self.start, offsets)
        self.inside = inside

    def __len__(self) -> int:
        return len(self.start)

    def text_ids(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word; with lower, of its A-Z in lower case."""
        if not len(self):
            return np.zeros(0, U64)
        data = np.zeros(len(self.raw) + 8, np.uint8)
        data[:-8] = _LOWER[self.raw] if lower else self.raw
        eight = np.lib.stride_tricks.as_strided(data[:8].view(U64), (len(self.raw) + 1,), (1,))
        h = (eight[self.start] & _MASK[np.minimum(self.length, 8)]) * _ODD[62]
        rest, done = np.flatnonzero(self.length > 8), 8
        while len(rest):
            chunk = eight[self.start[rest] + done] & _MASK[np.minimum(self.length[rest] - done, 8)]
            h[rest] = mix64(h[rest] + _ODD[61]) + chunk * _ODD[60]
            done += 8
            rest = rest[self.length[rest] > done]
        return mix64(h + self.length.astype(U64) * _ODD[63])


def windows(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text, and their offsets; texts with 1 to k - 1 words have their whole sequence as one."""
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    if not len(words):
        return np.zeros(0, U64), out
    sums = np.zeros(max(0, len(words) - k + 1), U64)
    for j in range(k):
        sums += words[j : j + len(sums)] * _ODD[j]
    begin = np.repeat(offsets[:-1], count) + np.arange(out[-1]) - np.repeat(out[:-1], count)
    short = np.repeat((n > 0) & (n < k), count)
    h = np.zeros(out[-1], U64)
    h[~short] = sums[begin[~short]]
    for size in range(1, k):
        t = np.flatnonzero(n == size)
        h[out[t]] = _ODD[40 + size % 8]
        for j in range(size):
            h[out[t]] += words[offsets[t] + j] * _ODD[j]
    return mix64(h), out


def distinct(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each text."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        v = np.sort(values[a:b])
        out.append(v[np.append(True, v[1:] != v[:-1])] if b - a > 1 else v)
    return out


def distinct_flat(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As distinct, for many short texts at once: all sorted distinct values, text by text, and their offsets."""
    n = len(offsets) - 1
    ids = np.repeat(np.arange(n, dtype=np.uint64), np.diff(offsets))
    v = values[np.lexsort((values, ids))] if n >= 1 << 24 else None
    if v is None:
        key = (ids << U64(40)) | (values >> U64(24))
        order = np.argsort(key)
        v, key = values[order], key[order]
        if ((key[1:] == key[:-1]) & (v[1:] != v[:-1])).any():  # values that only differ in their low bits
            v = values[np.lexsort((values, ids))]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (ids[1:] != ids[:-1])
    return v[new], np.concatenate([[0], np.cumsum(np.bincount(ids[new].astype(np.int64), minlength=n))]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 19):
    """The batch in runs of rows of about limit bytes of text; a longer text is a run of its own."""
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64)
    run = np.cumsum(size) // limit
    edges = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)) if len(run) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))
