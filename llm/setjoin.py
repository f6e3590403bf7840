"""What the exact set-similarity joins share: an order of tokens by rarity, prefixes, candidate groups and a filter of ids.

Sets are sorted arrays of 64-bit hashes.  Sets x and y link when ``percent * |x or y| <= 100 * |x and y|``; they then share at least
``least_overlap(|x|)`` tokens, so in any order of the tokens their first ``prefix_length`` ones have ``needed`` in common.  The order
here is by rarity: counts of all sets' tokens, in 2^20 cells by hash, give each cell a level, and within a level hashes decide.
Frequent tokens come last, so passages that many sets share are in few prefixes.  Any order gives the same links; the
cells only decide how many candidates are compared.

Prefix tokens travel in packed buckets by hash, a few large rows for each batch of texts.  Sets with too few prefix tokens that any
other set of a fitting size shares cannot link and leave.  The rest are chained along the tokens that they share, in order of size and
broken where sizes differ too much; connected chains are candidate groups.  No link leaves a group, so groups can be compared one by
one; large ones are dealt out in pairs of blocks of bounded size.

The more tokens a cell counts, the less it tells rare tokens from others, so in large tables sets that are not alike are chained too and
groups grow faster than the input.  Where dealing large groups out would repeat more tokens than all groups have, their sets alone are
counted, ranked and chained again, with longer prefixes, as long as that takes sets out of large groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import components, discard, give_back, lean
from .shared import saved_in_python as saved
from .textkernel import U64, mix64

CELL_BITS = 20
#: Where few sets are ranked again: bits at most, and tokens of a cell up to which fewer do.
MOST_CELL_BITS, CELL_TOKENS = 23, 64
#: Sets in large groups are chained again only if the last time left at most this share of their tokens in large groups.
SHRUNK = 0.75
SLICES = 64
#: The lowest bits of a prefix token tell how many parts its postings are salted into, as a power of two.
SALT_BITS = 4
SALT_MASK = (1 << SALT_BITS) - 1
#: Cells over so many times the mean are salted, into parts of about PART_TOKENS at most and a 4096th of all tokens.
HOT_TIMES, PART_TOKENS = 16, 1_000_000
#: Postings of a bucket, and buckets at least: also so many that a bucket's task is small against the rest.
BUCKET_TOKENS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 256, 1 << 22
#: Partitions at most that block pairs are dealt out to.
MOST_PARTITIONS = 100_000
#: Tokens of one wave of block pairs: so many, or this part of those of all sets.
WAVE_TOKENS, WAVE_PART = 1 << 22, 4
#: Tokens of classes up to which a wave may join the sets of all of them.
SETS_TOKENS = 1 << 22
#: Bits of a bitmap of ids, as powers of two.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 16, 28


def least_overlap(n, percent: int):
    return -(-percent * n // 100)


def pair_overlap(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def needed(n, part: int):
    """Prefix tokens that a set of this size shares at least with a linked set that is not smaller.

    A smaller `part` makes prefixes longer and candidates fewer.  With a smaller partner, the partner's number counts.
    """
    return 1 + n // part


def prefix_length(n, percent: int, part: int):
    """Of a number or an array of numbers of tokens."""
    return np.minimum(n, n - least_overlap(n, percent) + needed(n, part))


@dataclass
class Rarity:
    """By cell of tokens: level (0 is rarest) and salt bits; buckets for all prefix tokens; how many tokens all sets have."""

    level: np.ndarray
    salts: np.ndarray
    buckets: int
    tokens: int = 0

    @classmethod
    def of(cls, cells: np.ndarray) -> Rarity:
        cells = cells.astype(np.float64)
        total = cells.sum()
        twice = 2 * max(1.0, cells.mean())
        level = np.where(cells <= twice, 0, 1 + np.floor(2 * np.log2(np.maximum(cells, 1) / twice))).astype(np.uint8)
        part = max(HOT_TIMES * cells.mean(), min(PART_TOKENS, total / 4096), 1.0)
        salts = np.clip(np.ceil(np.log2(np.maximum(cells, 1) / part)), 0, SALT_MASK).astype(np.uint8)
        buckets = 1 << int(np.ceil(np.log2(max(1.0, total / 3 / BUCKET_TOKENS))))
        return cls(level, salts, min(MOST_BUCKETS, max(LEAST_BUCKETS, buckets)), int(total))


def cell_of(tokens: np.ndarray, cells: int) -> np.ndarray:
    """Of a number of cells that is a power of two."""
    return (tokens >> U64(65 - cells.bit_length())).astype(np.int64)


class CellCounts:
    """A task's counts of tokens by cell, to be sent as rows (k, part)."""

    def __init__(self, bits: int = CELL_BITS):
        self.cells, self.waiting, self.some = np.zeros(1 << bits, np.uint32), [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(cell_of(tokens, len(self.cells)))
        self.some += len(tokens)
        if self.some > len(self.cells):
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.cells += np.bincount(np.concatenate(self.waiting), minlength=len(self.cells)).astype(np.uint32)
        self.waiting, self.some = [], 0

    def rows(self) -> tuple[pa.Array, pa.Array]:
        self._count()
        parts = [(k, p.tobytes()) for k, p in enumerate(np.split(self.cells, SLICES)) if p.any()]
        return pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())


def rarity(parts: DataFrame, bits: int = CELL_BITS) -> Rarity:
    """From the rows (k, part) of all tasks; the driver gets one array of a fixed size."""

    def reduce(key, rows):
        total = np.zeros((1 << bits) // SLICES, np.uint64)
        for part in rows.column("part"):
            total += np.frombuffer(part.as_buffer(), np.uint32)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    cells = np.zeros((SLICES, (1 << bits) // SLICES), np.uint32)
    for k, part in parts.select("k", "part").groupBy("k").applyInArrow(reduce, "k int, part binary").collect():
        cells[k] = np.frombuffer(part, np.uint32)
    return Rarity.of(cells.ravel())


def by_rarity(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Distinct tokens, sorted by hash, in the order of rarity."""
    return tokens[np.argsort(level[cell_of(tokens, len(level))], kind="stable")]


def prefixes(tokens: np.ndarray, offsets: np.ndarray, order: Rarity, percent: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefixes of many sets (distinct, sorted by hash) at once, tokens with their salt bits, and their offsets."""
    n = np.diff(offsets)
    cell = cell_of(tokens, len(order.level))
    own = order.level[cell].astype(np.int64)
    at = np.argsort(np.repeat(np.arange(len(n)), n) * 64 + own, kind="stable")
    rank = np.arange(len(tokens)) - np.repeat(offsets[:-1], n)
    size = prefix_length(n, percent, part)
    at = at[rank < np.repeat(size, n)]
    return (tokens[at] & ~U64(SALT_MASK)) | order.salts[cell[at]].astype(U64), np.concatenate([[0], np.cumsum(size)])


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that equal sets share, for many sets; 0 for empty ones."""
    out = np.zeros((2, len(offsets) - 1), np.int64)
    full = np.diff(offsets) > 0
    at = offsets[:-1][full]
    if len(at):
        out[0, full] = np.add.reduceat(tokens, at).view(np.int64)
        out[1, full] = np.bitwise_xor.reduceat(mix64(tokens + U64(0x632BE59BD9B4E019)), at).view(np.int64)
    return out[0], out[1]


class Seen:
    """Sets that a task has met, with the first places it remembers, in a table of fixed size.

    What it says is true, but it forgets: of equal sets it may tell only some.
    """

    def __init__(self, bits: int = 16):
        self.bits = bits
        self.keys, self.places = np.zeros((3, 1 << bits), np.int64), np.full((2, 1 << bits), np.iinfo(np.int64).max)

    def earlier(self, s1: np.ndarray, s2: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sets at places (a, b): whether an equal one is known at a smaller place, and that one's a."""
        size = len(s1)
        known, twin = np.zeros(size, bool), a.copy()
        if not size:
            return known, twin
        by = np.lexsort((b, a, n, s2, s1))
        new = np.append(True, np.any([x[by[1:]] != x[by[:-1]] for x in (s1, s2, n)], axis=0))
        head = by[np.flatnonzero(new)]
        lead = head[np.cumsum(new) - 1]
        known[by] = (a[by] != a[lead]) | (b[by] != b[lead])
        twin[by] = a[lead]
        slot = (mix64(s1[head].view(U64)) >> U64(64 - self.bits)).astype(np.int64)
        same = (self.keys[:, slot] == np.stack([s1[head], s2[head], n[head]])).all(0)
        pa_, pb = self.places[:, slot]
        before = same & ((pa_ < a[head]) | (pa_ == a[head]) & (pb < b[head]))
        known[head], twin[head[before]] = before, pa_[before]
        put = np.flatnonzero(~before)
        put = put[np.unique(slot[put], return_index=True)[1]]
        self.keys[:, slot[put]] = np.stack([s1[head], s2[head], n[head]])[:, put]
        self.places[:, slot[put]] = np.stack([a[head], b[head]])[:, put]
        return known, twin


def pack(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings (token, id, set size) as a row (bucket, postings) for each bucket that they fall in.

    Bytes of equal weight stand together, so that those that hardly vary take no room when shuffled.
    """
    salt = mix64(ids.view(U64)) & ((U64(1) << (tokens & U64(SALT_MASK))) - U64(1))
    bucket = (mix64(tokens + salt * U64(0x9E3779B97F4A7C15)) & U64(buckets - 1)).astype(np.int32)
    by = np.argsort(bucket.astype(U64) << U64(42) | tokens >> U64(22))
    data = np.empty((len(by), 20), np.uint8)
    data[:, :8], data[:, 8:16], data[:, 16:] = (x[by].view(np.uint8).reshape(len(by), x.itemsize) for x in (tokens, ids, sizes.astype(np.uint32)))
    bucket = bucket[by]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(by) else np.zeros(0, np.int64)
    ends = np.append(at[1:], len(by))
    return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([data[a:b].T.tobytes() for a, b in zip(at, ends, strict=False)], pa.binary())], ["bucket", "postings"])


PACKED = "bucket int, postings binary"


def unpack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(20, -1).T) for x in rows.column("postings")]
    parts = [(d[:, :8], d[:, 8:16], d[:, 16:]) for d in data]
    kinds = (np.uint64, np.int64, np.uint32)
    return tuple(np.concatenate([np.ascontiguousarray(p[k]).view(kind).ravel() for p in parts]) for k, kind in enumerate(kinds))


def _as_before(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the one before it."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.all([c[1:] == c[:-1] for c in columns], axis=0)
    return out


def chain(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Postings whose list holds a neighbour, in order of size, that can link: ids, sizes, tokens, salts, neighbours before (-1: none) and whether there is one.

    Salted lists stay whole, as neighbours may be in other parts.
    """
    by = np.argsort(tokens)
    t = tokens[by]
    equal = _as_before(t)
    some = equal | np.append(equal, False)[1:] | ((t & U64(SALT_MASK)) > 0)
    by = by[some]
    t, i, n = tokens[by], ids[by], sizes[by].astype(np.int64)
    salt = (mix64(i.view(U64)) & ((U64(1) << (t & U64(SALT_MASK))) - U64(1))).astype(np.int64)
    by = np.lexsort((i, n, salt, t))
    t, i, n, salt = t[by], i[by], n[by], salt[by]
    again = _as_before(t, i)
    t, i, n, salt = t[~again], i[~again], n[~again], salt[~again]
    down = _as_before(t, salt) & (n * percent <= 100 * np.roll(n, 1))
    stay = down | np.append(down, False)[1:] | ((t & U64(SALT_MASK)) > 0)
    before = np.roll(i, 1)
    return i[stay], n[stay], t[stay].view(np.int64), salt[stay], before[stay], down[stay]


def candidate_groups(packed: DataFrame, percent: int, part: int) -> DataFrame:
    """From packed postings (bucket, postings) of sets' prefixes: (id, group) of the ids that may link with another id.

    Postings that repeat a token and an id count once.
    """

    def first_chains(rows: pa.Table) -> pa.Table:
        i, n, t, salt, before, down = chain(*unpack(rows), percent)
        out = pa.table({"id": pa.array(i), "n": pa.array(n), "token": pa.array(t), "salt": pa.array(salt.astype(np.int32)), "before": pa.array(before, mask=~down)})
        give_back()
        return out

    shared = saved(packed.groupBy("bucket").applyInArrow(first_chains, "id long, n long, token long, salt int, before long"))
    hot = F.col("token").bitwiseAND(F.lit(SALT_MASK)) > 0
    # the smallest partner has percent of the tokens, and its number of shared prefix tokens; only counts move, rows meet a bitmap of ids,
    # and an id too many only makes a group larger
    counts = shared.groupBy("id").agg(F.count("*").alias("k"), F.min("n").alias("n"))
    enough = saved(counts.filter(F.col("k") >= 1 + F.floor(F.ceil(F.col("n") * percent / 100) / part)).select("id"))
    fit = likely(shared.drop("before"), "id", enough)
    within = W.partitionBy("token", "salt").orderBy("n", "id")
    near = fit.withColumn("last", F.lag("id").over(within)).withColumn("n0", F.lag("n").over(within)).withColumn("n1", F.lead("n").over(within))
    down, up = F.coalesce(F.col("n") * percent <= F.col("n0") * 100, F.lit(False)), F.coalesce(F.col("n1") * percent <= F.col("n") * 100, F.lit(False))
    again = saved(near.filter(down | up | hot).select("id", "token", F.when(down, F.col("last")).alias("before")))
    discard(shared, enough)
    links = again.filter("before IS NOT NULL").select(F.least("before", "id").alias("a"), F.greatest("before", "id").alias("b"))
    # the salted parts of a hot token: each one's first postings join the first of all
    heads = again.filter(hot & F.col("before").isNull())
    least = heads.groupBy("token").agg(F.min("id").alias("least"))
    joined = heads.join(least, "token").filter("least < id").select(F.col("least").alias("a"), F.col("id").alias("b"))
    found = components(links.union(joined), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group"))
    discard(again)
    return found


def _parts(most_sets: int, most_tokens: int) -> Column:
    """Blocks of a group of so many sets and tokens."""
    parts = F.greatest(F.ceil(F.col("sets") / (2 * most_sets)), F.ceil(F.col("tokens") / (2 * most_tokens)))
    return F.when(parts > 1, 2 * parts).otherwise(parts).cast("int")


def refined(classes: DataFrame, key: str, read: Callable[[DataFrame], tuple[DataFrame, Callable[[Iterator], Iterator]]], percent: int, part: int, most_sets: int, most_tokens: int) -> DataFrame:
    """classes (key, n, group, ...), saved, in smaller groups where their blocks would repeat more tokens than all of them have.

    read(members) gives rows and what makes (keys, tokens, offsets) of their batches: all sets of the members, seldom others too.  It
    replaces classes, which is deleted.
    """
    before = float("inf")
    while True:
        parts = _parts(most_sets, most_tokens)
        size = saved(classes.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).withColumn("parts", parts))
        many = F.col("parts") > 1
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        every, some, repeated = size.agg(total("tokens"), total(F.when(many, F.col("tokens"))), total(F.when(many, F.col("tokens") * (F.col("parts") - 1)))).first()
        if repeated <= every or some > SHRUNK * before:
            discard(size)
            return classes
        before = some
        wide = size.filter(many).select("group")
        large = saved(classes.join(wide, "group", "left_semi"))
        small = classes.join(wide, "group", "left_anti")
        rows, sets = read(large)
        bits = min(MOST_CELL_BITS, max(CELL_BITS, (int(some) // CELL_TOKENS).bit_length()))

        def count(batches, sets=sets, bits=bits):
            cells = CellCounts(bits)
            for _, tokens, _ in sets(batches):
                cells.add(tokens)
            yield pa.RecordBatch.from_arrays([*cells.rows()], ["k", "part"])

        order = rows.sparkSession.sparkContext.broadcast(rarity(rows.mapInArrow(lean(count), "k int, part binary"), bits))

        def postings(batches, sets=sets, order=order):
            for ids, tokens, own in sets(batches):
                cut, ends = prefixes(tokens, own, order.value, percent, part)
                each = np.diff(ends)
                yield pack(cut, np.repeat(ids, each), np.repeat(np.diff(own), each), order.value.buckets)

        found = candidate_groups(rows.mapInArrow(lean(postings), PACKED), percent, part).withColumnRenamed("id", key)
        again = saved(small.unionByName(large.drop("group").join(found, key).select(small.columns)))
        discard(size, large, classes)
        classes = again


def blocks(members: DataFrame, order: str, most_sets: int, most_tokens: int, percent: int = 80) -> tuple[DataFrame, int]:
    """Adds bin and pair to members (group, n, order, ...), which name the unit of work that compares a member with others; and a number of partitions.

    A side of a pair of blocks has about most_sets sets, and tokens, at most.  Small groups share bins, as their members cannot link with
    each other's.  Large groups are dealt into blocks by size, and a member is repeated for each pair of blocks that its own is in and
    whose sizes allow links: side is its block within the pair, inside whether this pair is the one that compares the members of that block with
    each other.  Members of a group with one member are left out.
    """
    size = members.groupBy("group").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")).filter("sets > 1").withColumn("parts", _parts(most_sets, most_tokens))
    size = saved(size)
    all_sets, all_tokens = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bins = 1 << max(0, int(max(all_sets // most_sets, all_tokens // most_tokens)).bit_length())
    m = members.join(size.select("group", "parts"), "group")
    given = members.columns
    small = m.filter("parts = 1").select(*given, F.pmod(F.xxhash64("group"), F.lit(bins)).alias("bin"), F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side"), F.lit(True).alias("inside"))
    # sizes in steps of a thirtieth fill blocks one after the other, those of many sets several
    step = F.floor(F.log(F.col("n").cast("double")) * 30).cast("int")
    large = m.filter("parts > 1").withColumn("step", step)
    steps = large.groupBy("group", "step").agg(F.greatest(F.count("*") / F.lit(most_sets), F.sum("n") / F.lit(most_tokens)).alias("room"))
    steps = steps.withColumn("start", F.sum("room").over(W.partitionBy("group").orderBy("step").rowsBetween(W.unboundedPreceding, -1))).fillna(0.0, ["start"])
    unit = F.pmod(F.xxhash64(F.col(order), F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    large = saved(large.join(steps, ["group", "step"]).withColumn("own", F.floor(F.col("start") + unit * F.col("room")).cast("int")).select(*given, "own"))
    ranges = saved(large.groupBy("group", "own").agg(F.min("n").alias("low"), F.max("n").alias("high")))
    other = ranges.select("group", F.col("own").alias("other"), F.col("low").alias("low2"))
    near = ranges.join(other, "group").filter(F.col("own") < F.col("other")).filter(percent * F.col("low2") <= 100 * F.col("high"))
    name = (F.col("a") * F.lit(1 << 31) + F.col("b")).alias("pair")
    near = saved(near.select("group", F.col("own").cast("long").alias("a"), F.col("other").cast("long").alias("b")))
    both = near.select("group", F.col("a").cast("int").alias("own"), name, F.lit(0).alias("side")).union(near.select("group", F.col("b").cast("int").alias("own"), name, F.lit(1).alias("side")))
    # the first pair of a block compares its own members, or a pair of its own where there is no other
    both = ranges.select("group", "own").join(both, ["group", "own"], "left")
    first = both.groupBy("group", "own").agg(F.min("pair").alias("home"))
    both = saved(both.join(first, ["group", "own"]).select("group", "own", F.coalesce("pair", F.col("own").cast("long") * ((1 << 31) + 1)).alias("pair"), F.coalesce("side", F.lit(0)).alias("side"), F.coalesce(F.col("pair") == F.col("home"), F.lit(True)).alias("inside")))
    pairs = both.select("group", "pair").distinct().count()
    large = large.join(both, ["group", "own"]).select(*given, F.col("group").alias("bin"), "pair", "side", "inside")
    return small.unionByName(large).drop("group"), min((bins + pairs) // 2 + 1, MOST_PARTITIONS)


def compared(pairs: DataFrame, classes: DataFrame, read: Callable[[DataFrame], DataFrame], on: list[str], partitions: int, every: int, compare: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What compare finds in each unit of work of pairs, from blocks() of classes; every is the number of tokens of all sets of the table.

    read(members) gives the sets of the members, and seldom others, from the texts.  Sets are repeated for each pair of blocks.  Where
    that is much against all sets, the units are taken in waves, whose shuffle files go one after the other; a wave holds its own sets
    once to join them and once a unit.  So disk is bounded by the table, whatever the classes and pairs.
    """
    total = lambda x: x.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(WAVE_TOKENS, every // WAVE_PART)
    waves = max(1, -(-total(pairs) // most))
    all_at_once = waves == 1 or total(classes) <= max(SETS_TOKENS, most)
    sets = read(classes) if all_at_once else None
    if waves > 1:
        pairs = saved(pairs.withColumn("wave", F.pmod(F.xxhash64("bin", "pair", F.lit(3)), F.lit(waves))))
    out = None
    for k in range(waves):
        some = pairs.filter(F.col("wave") == k).drop("wave") if waves > 1 else pairs
        found = saved(some.join(sets if all_at_once else read(some), on).repartition(partitions // waves + 1, "bin", "pair").groupBy("bin", "pair").applyInArrow(compare, schema))
        out = found if out is None else out.unionByName(found)
    if waves > 1:
        discard(pairs)
    return out


def id_filter(ids: DataFrame, name: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> np.ndarray:
    """A bitmap of the hashed ids (id) that are not null, of 16 bits for each row within bounds: it only saves work, joins decide.

    With name, that gives the ids of a batch of rows.  ids is read twice.  They travel by slice of the bitmap, so the shuffle follows their
    number; the driver gets the bitmap.
    """
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, (16 * ids.count()).bit_length()))
    # small bitmaps are a few slices
    number = min(SLICES, 1 << bits - 14)
    low = bits - number.bit_length() + 1
    rows = ids if name else ids.select(F.col("id").cast("long").alias("id"))
    name = name or (lambda b: np.asarray(b.column(0).drop_null(), np.int64))

    def cells(batches):
        for b in batches:
            cell = np.unique(filter_cell(name(b), bits))
            yield pa.RecordBatch.from_arrays([pa.array((cell >> low).astype(np.int32)), pa.array((cell & ((1 << low) - 1)).astype(np.int32))], ["k", "cell"])

    def slices_of(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            k, cell = (np.asarray(b.column(c)) for c in ("k", "cell"))
            for own in np.unique(k).tolist():
                at = cell[k == own]
                np.bitwise_or.at(parts.setdefault(own, np.zeros(1 << low - 3, np.uint8)), at >> 3, (128 >> (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], ["k", "part"])

    dealt = rows.mapInArrow(cells, "k int, cell int").repartition(number, "k")
    out = np.zeros((number, 1 << low - 3), np.uint8)
    for k, part in dealt.mapInArrow(slices_of, "k int, part binary").collect():
        out[k] = np.frombuffer(part, np.uint8)
    return out.ravel()


def filter_cell(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(ids.view(U64)) >> U64(64 - bits)).astype(np.int64)


def in_filter(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    cell = filter_cell(ids, (8 * len(packed)).bit_length() - 1)
    return (packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


def likely(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """rows whose column is among ids (id), and a few others: nothing is shuffled but the bitmap."""
    kept = rows.sparkSession.sparkContext.broadcast(id_filter(ids))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(in_filter(kept.value, np.asarray(b.column(column).fill_null(0), np.int64))))

    return rows.mapInArrow(keep, rows.schema)


def binary_sets(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def unpack_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for x in column]
