"""Best-fit packing of token sequences by exact-complement hashing.

Documents become runs of token ids, each closed by an end id.  A run longer than the capacity is cut into pieces of the
capacity, the remainder coming first; no other run is cut.  Packing only depends on how many pieces there are of each
length, so the driver plans over that histogram (at most ``capacity`` numbers, whatever the input) and a piece finds its
place from its length and its rank among the pieces of that length.

The plan: from the longest length down, the gap ``capacity - length`` is looked up in an index of the single lengths, of
the sums of two and of the sums of three lengths that are still available; a combination that fills the gap exactly is used
as often as its members' counts allow.  What has no exact complement goes to the open sequence with the least room that
still holds it (best fit, longest first).

Edge cases: a null or empty text is the end id alone; an empty table gives an empty result; repeated rows (the same
document id too) are packed as often as they occur; ties fall in the order of id, piece and start; further columns of the
input are ignored, whatever their names.  Very long texts are cut in pieces as above.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lean, saved, small_batches

MOST_BLOCKS = 2048


@lru_cache(maxsize=2)
def encoder(path: str, split_added: bool = True):
    """A function from a text to the bytes of its ids, for a byte-level BPE vocabulary file of the tokenizers library.

    Tokens are those of that library; the merging itself is done by tiktoken, which is about five times as fast, on the ranks
    read from the file.  As there, the file's added tokens are ids of their own where a text holds them; without split_added
    (the library's encode_special_tokens) they are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens with rules of their own are not supported")
    ranks = {bytes(shown[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # the longest of several that start at one place
    stops = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added and split_added else None
    marks = {x: np.array([i], "<u4").tobytes() for x, i in added.items()}

    def part(text: str) -> bytes:
        return np.array(encode(text), "<u4").tobytes()

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if stops is None or not (m := stops.search(text)):
            return part(text)
        out, at = [], 0
        while m:
            if m.start() > at:
                out.append(part(text[at : m.start()]))
            out.append(marks[m[0]])
            at = m.end()
            m = stops.search(text, at)
        if at < len(text):
            out.append(part(text[at:]))
        return b"".join(out)

    return ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, with with_ids, the token ids themselves."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids
    close = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encode(text.as_py() or "") + close
                n = len(data) // 4
                at, head, k = 0, n % capacity or capacity, 0
                while at < n:
                    size = n if n <= capacity else head if not k else capacity
                    part = data[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, size, zlib.crc32(part), *([np.frombuffer(part, "<u4").astype(np.int32)] * with_ids)))
                    at, k = at + size, k + 1
                if len(rows) >= 4096:
                    yield _batch(rows, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, with_ids)

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(lean(cut), schema)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    if with_ids:
        names, kinds = [*names, "ids"], [*kinds, pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Templates (lengths of the pieces of a sequence, how many such sequences) that use every piece of the histogram once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[tuple[int, ...], int]] = []

    def use(members: tuple[int, ...]) -> int:
        need: dict[int, int] = {}
        for m in members:
            need[m] = need.get(m, 0) + 1
        times = min(int(left[m]) // k for m, k in need.items())
        if times:
            for m, k in need.items():
                left[m] -= times * k
            out.append((members, times))
        return times

    use((capacity,))
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        if left[length]:
            use((length, gap))
        while left[length]:
            # pairs: lengths a >= b with a + b = gap, both available, the largest a first
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            a = a[(left[a] > 0) & (left[gap - a] > 0)]
            if not any([use((length, int(x), int(gap - x))) for x in a if left[length]]):
                break
        if left[length] and gap >= 3:
            _triples(left, length, gap, use)
    _best_fit(left, capacity, out)
    return out


def _triples(left: np.ndarray, length: int, gap: int, use) -> None:
    """Uses lengths a >= b >= c with a + b + c = gap, found through the sums of two available lengths."""
    have = (left[:gap] > 0).astype(np.float64)
    reach = np.fft.irfft(np.fft.rfft(have, 2 * gap) ** 2, 2 * gap)[: gap + 1] > 0.5
    for a in range(gap - 2, (gap - 1) // 3, -1):
        rest = gap - a
        if not left[length]:
            return
        if left[a] and reach[rest]:
            b = np.arange(min(a, rest - 1), (rest - 1) // 2, -1)
            for x in b[(left[b] > 0) & (left[rest - b] > 0)]:
                if not left[length] or not left[a]:
                    break
                use((length, a, int(x), int(rest - x)))


def _best_fit(left: np.ndarray, capacity: int, out: list) -> None:
    """Places what is left, longest first, each into the open sequences with the least room that holds it."""
    rooms: list[int] = []
    open_: dict[int, list[list]] = {}

    def put(members: tuple[int, ...], times: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([members, times])

    for length in range(capacity, 0, -1):
        while left[length]:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                fit = capacity // length
                times, rest = divmod(int(left[length]), fit)
                if times:
                    put((length,) * fit, times, capacity - fit * length)
                if rest:
                    put((length,) * rest, 1, capacity - rest * length)
                left[length] = 0
                continue
            room = rooms[k]
            members, times = open_[room][-1]
            fit = min(room // length, int(left[length]))
            n = min(times, int(left[length]) // fit)
            left[length] -= n * fit
            if n == times:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                open_[room][-1][1] -= n
            put((*members, *(length,) * fit), n, room - fit * length)
    out.extend((tuple(m), n) for group in open_.values() for m, n in group)


def place(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the pieces (doc_id, piece, start, length, ...); parts is read more than once, so save it."""
    # ranks within a length: in blocks by a hash, so that a frequent length is no single task; at most capacity * MOST_BLOCKS counts
    blocks = int(min(MOST_BLOCKS, max(64, parts.count() // 20_000)))
    dealt = parts.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(blocks)).cast("int"))
    found = dealt.groupBy("length", "block").agg(F.count("*").alias("n")).toArrow()
    table = np.zeros((capacity + 1, blocks), np.int64)
    length, block, n = (np.asarray(found.column(c).combine_chunks()) for c in ("length", "block", "n"))
    table[length, block] = n
    before = np.cumsum(table, 1) - table
    counts = {int(k): int(table[k].sum()) for k in np.unique(length)}
    templates = plan(counts, capacity)
    # runs: pieces of one length, by rank, that one template takes; each sequence takes `per` of them
    runs: dict[int, list[tuple[int, int, int, list[int]]]] = {}
    used: dict[int, int] = {}
    base = 0
    for members, times in templates:
        spots: dict[int, list[int]] = {}
        at = 0
        for m in members:
            spots.setdefault(m, []).append(at)
            at += m
        for m, offs in spots.items():
            runs.setdefault(m, []).append((used.get(m, 0), base, len(offs), offs))
            used[m] = used.get(m, 0) + times * len(offs)
        base += times
    flat = [(m, *r) for m in sorted(runs) for r in runs[m]]
    key = np.array([(r[0] << 48) + r[1] for r in flat], np.int64)
    first, start, per = (np.array([r[k] for r in flat], np.int64) for k in (1, 2, 3))
    at = np.cumsum([0, *(r[3] for r in flat)])[:-1].astype(np.int64) if flat else np.zeros(0, np.int64)
    offs = np.array([x for r in flat for x in r[4]], np.int64)
    shipped = parts.sparkSession.sparkContext.broadcast((key, first, start, per, at, offs, before))
    within = W.partitionBy("length", "block").orderBy("doc_id", "piece", "start")
    ranked = dealt.withColumn("nth", F.row_number().over(within))

    names = parts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"

    def fill(batches):
        key, first, start, per, at, offs, before = shipped.value
        for b in batches:
            if not b.num_rows:
                continue
            length, block, nth = (np.asarray(b.column(c), np.int64) for c in ("length", "block", "nth"))
            nth += before[length, block] - 1
            k = np.searchsorted(key, (length << 48) + nth, "right") - 1
            sequence, slot = np.divmod(nth - first[k], per[k])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(start[k] + sequence), pa.array(offs[at[k] + slot])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(lean(fill), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """All pieces of docs with their places."""
    return place(saved(pieces(docs, tokenizer, capacity, id_col, text_col, end_id, with_ids)), capacity)
