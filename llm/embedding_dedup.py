"""Embedding near-dedup: an exact range join in the metric of angles.

Vectors link when their cosine, in double precision, is at least ``cosine``, that is when their angle is at most
``theta = arccos(cosine)``.  Pivots, taken from the data, partition the vectors: a vector's home is the cell of its nearest pivot.  By the
triangle inequality a vector x can only link with one at home in cell j if its distance to j's pivot is at most that to its own
pivot plus ``2 theta``, and if for every witness pivot p its distance d(x, p) is within ``theta`` of the range of the distances to p that
the vectors of cell j have.  Such cells are its boundary: x is sent to those of them that come after its home, so that every pair of cells
meets once, at the later one.  Cells are then joined independently, in blocks of bounded size, by matrix products in single
precision with room for their error; what they find is decided in double precision.

Equal vectors are joined as one and counted as often as they occur.  Connected components come from a spanning forest of each
block's links.

Edge cases: vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing and have 0 links and
a component of their own; vectors of different lengths do not link; repeated rows are vectors of their own; rows of one id, with
equal or different vectors, are one node, each with the links of its own vector; a row without an id has no component, is not kept and
links with nothing; an empty table gives an empty result; further columns, labels among them, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, discard, give_back, lean, saved, small_batches
from .textkernel import mix64

#: Vectors for each pivot, pivots at most (the driver holds 4 candidates for each), and those of them that are witnesses.
PER_PIVOT, MOST_PIVOTS, WITNESSES = 16384, 2048, 64
#: Vectors of a block; rows of a matrix product; pairs decided in double precision at a time.
BLOCK, TILE, PAIRS = 16384, 512, 1 << 16
#: Far over the error of an angle computed in double precision.
SLACK = 1e-6
SENT = "cell long, i int, j int, side int, h1 long, h2 long, rep long, copies long, raw binary"


def unit(v: np.ndarray) -> np.ndarray | None:
    """The vector of length 1 in double precision; None if it links with nothing."""
    a = v.astype(np.float64)
    if len(a) and np.isfinite(a).all() and (top := np.abs(a).max()) > 0:
        a = a / top
        return a / np.sqrt(a @ a)
    return None


def matrix(raw: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors of equal lengths, row by row as unit() gives them."""
    return np.stack([unit(np.frombuffer(x, kind)) for x in raw])


def spread(vectors: np.ndarray, k: int) -> np.ndarray:
    """k of the vectors far from each other: each next one has the smallest largest cosine to those chosen."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        nxt = int(near.argmin())
        chosen.append(nxt)
        near = np.maximum(near, vectors @ vectors[nxt])
    return vectors[chosen]


class Cells:
    """Pivots by length of the vectors; a cell is the length and the number of its pivot in one number."""

    def __init__(self, pivots: dict[int, np.ndarray], theta: float):
        self.pivots, self.theta = pivots, theta
        #: for each length, the least and the greatest distance to each witness that the vectors at home in each cell have
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}

    def distances(self, v: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(v @ self.pivots[v.shape[1]].T, -1, 1))

    def visits(self, d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and pivots of the cells that come after a row's home and may hold a vector that links with it."""
        home = d.argmin(1)
        near = d <= d[np.arange(len(d)), home][:, None] + 2 * self.theta + SLACK
        near &= np.arange(d.shape[1]) > home[:, None]
        row, j = np.nonzero(near)
        w = min(WITNESSES, d.shape[1])
        stay = np.ones(len(row), bool)
        for a in range(0, len(row), PAIRS):
            own, cell = d[row[a : a + PAIRS], :w], j[a : a + PAIRS]
            stay[a : a + PAIRS] = ((own >= self.low[size][cell] - self.theta - SLACK) & (own <= self.high[size][cell] + self.theta + SLACK)).all(1)
        return row[stay], j[stay]


def number(size: int, pivot):
    return size * 4096 + pivot


def _by_length(batch: pa.RecordBatch, kind: type):
    """(rows, their unit vectors) for each length of vectors."""
    data = batch.column("raw").to_pylist()
    sizes = np.array([len(x) for x in data], np.int64)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, matrix([data[k] for k in rows], kind)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A label for each of n nodes, equal within components."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not (label == label[label]).all():
            label = label[label]


def near_pairs(x: np.ndarray, y: np.ndarray, cosine: float, within: bool):
    """Rows of x and y whose cosine is at least that, in parts; within: x is y, and each pair comes once."""
    small, other = x.astype(np.float32), y.astype(np.float32).T
    room = np.float32(cosine - 1e-5 - x.shape[1] * 2.5e-7)
    for a in range(0, len(x), TILE):
        first = a if within else 0
        i, j = np.nonzero(small[a : a + TILE] @ other[:, first:] >= room)
        i, j = i + a, j + first
        if within:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), PAIRS):
            p, q = i[k : k + PAIRS], j[k : k + PAIRS]
            ok = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
            yield p[ok], q[ok]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept."""
    small_batches(vectors.sparkSession)
    context = vectors.sparkSession.sparkContext
    theta = float(np.arccos(cosine))
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("e"))

    def read(batches):
        for b in batches:
            raw, units = [], []
            for i, x in zip(b.column("vec_id"), b.column("e"), strict=True):
                a = np.asarray(x.values, kind) if i.is_valid and x.is_valid and len(x) and not x.values.null_count else np.zeros(0, kind)
                u = unit(a)
                raw.append(None if u is None else a.tobytes())
                units.append(None if u is None else u.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(units, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "unit", "raw"])

    hashed = v.mapInArrow(lean(read), "vec_id long, unit binary, raw binary")
    # equal units have equal 128 bits
    v = saved(hashed.select("vec_id", "raw", F.xxhash64("unit").alias("h1"), F.xxhash64(F.reverse(F.sha2("unit", 256))).alias("h2")))
    usable = v.filter("raw IS NOT NULL")
    classes = saved(usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("raw").alias("raw")))
    total = classes.count()
    count = int(min(MOST_PIVOTS, max(4, total // PER_PIVOT)))
    pivots: dict[int, np.ndarray] = {}
    width = np.dtype(kind).itemsize
    for size in [r[0] for r in classes.select((F.octet_length("raw") / width).cast("int")).distinct().collect()]:
        ours = classes.filter(F.octet_length("raw") == width * size)
        share = (8.0 * count + 64) / max(1, total)
        sample = ours.filter(F.pmod("h1", F.lit(1 << 31)) / float(1 << 31) <= share).select("raw", "h1").orderBy("h1").limit(4 * count).collect()
        sample = sample or ours.select("raw").limit(1).collect()
        pivots[size] = spread(matrix([bytes(r[0]) for r in sample], kind), count)
    cells = Cells(pivots, theta)
    shipped = context.broadcast(cells)

    def tally(batches):
        """Vectors at home in each cell, and the ranges of their distances to the witnesses."""
        n: dict[int, list] = {}
        for b in batches:
            for _, m in _by_length(b, kind):
                d = shipped.value.distances(m)
                home = d.argmin(1)
                for j in np.unique(home):
                    own = d[home == j, :WITNESSES]
                    at = n.setdefault(number(m.shape[1], int(j)), [0, own.min(0), own.max(0)])
                    at[0], at[1], at[2] = at[0] + len(own), np.minimum(at[1], own.min(0)), np.maximum(at[2], own.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array([x[0] for x in n.values()], pa.int64()), pa.array([x[1].tobytes() for x in n.values()], pa.binary()), pa.array([x[2].tobytes() for x in n.values()], pa.binary())], ["cell", "n", "low", "high"])

    def widest(rows: pa.Table) -> pa.Table:
        low, high = (np.stack([np.frombuffer(x.as_buffer()) for x in rows.column(c)]) for c in ("low", "high"))
        return pa.table({"cell": rows.column("cell")[:1], "n": pa.array([sum(rows.column("n").to_pylist())], pa.int64()), "low": pa.array([low.min(0).tobytes()], pa.binary()), "high": pa.array([high.max(0).tobytes()], pa.binary())})

    # one row for each cell: at most MOST_PIVOTS for each length
    homes: dict[int, int] = {}
    ranges = "cell long, n long, low binary, high binary"
    for size, p in pivots.items():
        cells.low[size], cells.high[size] = np.full((len(p), min(WITNESSES, len(p))), np.inf), np.full((len(p), min(WITNESSES, len(p))), -np.inf)
    for r in classes.select("raw").mapInArrow(lean(tally), ranges).groupBy("cell").applyInArrow(widest, ranges).collect():
        homes[r.cell] = -(-r.n // BLOCK)
        size, j = divmod(r.cell, 4096)
        cells.low[size][j], cells.high[size][j] = np.frombuffer(r.low), np.frombuffer(r.high)
    known = context.broadcast(cells)

    def count_visits(batches):
        n: dict[int, int] = {}
        for b in batches:
            for _, m in _by_length(b, kind):
                _, j = known.value.visits(known.value.distances(m), m.shape[1])
                for c, x in zip(*np.unique(j, return_counts=True), strict=True):
                    c = number(m.shape[1], int(c))
                    n[c] = n.get(c, 0) + int(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["cell", "n"])

    visitors = {r.cell: -(-r.n // BLOCK) for r in classes.select("raw").mapInArrow(lean(count_visits), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    dealt = context.broadcast({c: (n, visitors.get(c, 0)) for c, n in homes.items()})

    def send(batches):
        """Each vector to the block pairs of its home, and to those of the cells that it visits."""
        for b in batches:
            spin = mix64(np.asarray(b.column("h1"), np.int64).view(np.uint64)).astype(np.int64) & 0x7FFFFFFF
            for rows, m in _by_length(b, kind):
                d = known.value.distances(m)
                out: list[tuple[int, int, int, int, int]] = []
                for k, j in enumerate(d.argmin(1).tolist()):
                    c = number(m.shape[1], j)
                    n, visit = dealt.value[c]
                    own = int(spin[rows[k]]) % n
                    out.extend((c, min(own, o), max(own, o), int(own > o), k) for o in range(n))
                    out.extend((c, own, n + o, 0, k) for o in range(visit))
                for k, j in zip(*(x.tolist() for x in known.value.visits(d, m.shape[1])), strict=True):
                    c = number(m.shape[1], j)
                    if c in dealt.value:
                        n, visit = dealt.value[c]
                        out.extend((c, o, n + int(spin[rows[k]] >> 8) % visit, 1, k) for o in range(n))
                for a in range(0, len(out), 4096):
                    part = np.array(out[a : a + 4096], np.int64)
                    take = pa.array(rows[part[:, 4]])
                    yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), *(pa.array(part[:, k].astype(np.int32)) for k in (1, 2, 3)), *(b.column(c).take(take) for c in ("h1", "h2", "rep", "copies", "raw"))], [x.split()[0] for x in SENT.split(", ")])

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side").combine_chunks())
        h1, h2, rep, copies = (np.asarray(table.column(c).combine_chunks(), np.int64) for c in ("h1", "h2", "rep", "copies"))
        m = matrix(table.column("raw").to_pylist(), kind)
        within = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other = own if within else other
        links, label = np.zeros(len(m), np.int64), np.arange(len(m))
        if len(other):
            for x, y in near_pairs(m[own], m[other], cosine, within):
                a, b = own[x], other[y]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                if len(a):
                    label = forest(len(m), label[a], label[b])[label]
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(m)))
        out = pa.table({"x": pa.array(np.append(h1[some], rep[moved])), "y": pa.array(np.append(h2[some], rep[label[moved]])), "n": pa.array(np.append(links[some], np.zeros(len(moved), np.int64))), "link": pa.array(np.arange(len(some) + len(moved)) >= len(some))})
        give_back()
        return out

    sent = classes.mapInArrow(lean(send), SENT)
    joined = saved(sent.groupBy("cell", "i", "j").applyInArrow(compare, "x long, y long, n long, link boolean"))
    counts = joined.filter("NOT link").groupBy(F.col("x").alias("h1"), F.col("y").alias("h2")).agg(F.sum("n").alias("n"))
    per_class = saved(classes.select("h1", "h2", "rep", "copies").join(counts, ["h1", "h2"], "left").select("h1", "h2", "rep", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    linked = saved(usable.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"]))
    same = linked.filter("copies > 1 AND vec_id <> rep").select("rep", "vec_id")
    component = components(joined.filter("link").select("x", "y").union(same), "x", "y").withColumnRenamed("node", "vec_id")
    discard(classes)
    found = linked.select("vec_id", "n_links").unionByName(v.filter("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links")))
    out = found.join(component, "vec_id", "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id").isNotNull() & F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"))
