"""Line dedup by an exact set-similarity join with prefix, positional and length filters.

Documents are split into lines at ``\\n``.  A line's tokens are its distinct runs of ``width`` words (A-Z in lower case).  With
``short``, the one token of a line of fewer words is its whole sequence, so it matches lines of equal words only; without, such a
line has no token and is kept, as is always a line without a word.  Two lines match when the Jaccard similarity of their token sets is at least ``percent`` /
100.  In the order of (document id, line number), a line is removed if an earlier line of any document matches it, whether that
one is itself removed or not.

Lines with equal sets are one class, which stands at its earliest line.  Classes are dealt into candidate groups (see ``setjoin``).
Within a group they are taken in order of position; a class's tokens are ordered by rarity, its prefix is looked up in the
index of the prefixes of earlier classes, partners whose size or whose remaining tokens cannot reach the needed overlap
are passed over, and the others verified until one matches.

Edge cases: null and empty texts are kept as they are; equal lines within a document count too; rows that repeat an id and text
have equal positions, so one does not remove the other's lines; an empty table gives an empty result; other columns are passed
through, whatever their names.  Whole texts are read, however long.  Tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .setjoin import PACKED, CellCounts, Seen, binary_sets, blocks, by_rarity, candidate_groups, compared, id_filter, in_filter, least_overlap, likely, pack, pair_overlap, prefixes, rarity, refined, signatures, unpack_sets
from .shared import discard, give_back, lean, small_batches
from .shared import saved_in_python as saved
from .textkernel import U64, Words, buffers, distinct_flat, mix64, slices, windows

#: Prefixes are longer by this part of a set, and linked sets share that much more of them; the second, where large groups are refined.
PART, FINER_PART = 16, 6
#: Sets, and tokens, of one side of a block pair.
BLOCK_SETS, BLOCK_TOKENS = 1500, 500_000


def line_windows(batch: pa.RecordBatch, width: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all lines with at least width words (with whole, of all lines with words), their offsets by line, the lines' offsets by text, and whether a line has under width words."""
    raw, offsets = buffers(batch.column("t"))
    ends = np.flatnonzero(raw == 10) + 1
    # every text has one line at least, an empty one too
    counts = 1 + np.diff(np.searchsorted(ends, offsets + 1))
    by_text = np.concatenate([[0], np.cumsum(counts)])
    begin = np.empty(by_text[-1], np.int64)
    begin[by_text[:-1]] = offsets[:-1]
    rest = np.ones(len(begin), bool)
    rest[by_text[:-1]] = False
    begin[rest] = ends
    words = Words(raw, offsets)
    at = np.searchsorted(words.start, np.append(begin, len(raw)))
    h, out = windows(words.hashes(), at, width)
    short = np.diff(at) < width
    if short.any() and not whole:
        keep = np.repeat(~short, np.diff(out))
        size = np.where(short, 0, np.diff(out))
        h, out = h[keep], np.concatenate([[0], np.cumsum(size)])
    return h, out, by_text, short


def _place(ids: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A 64-bit name for (document, line), for the bitmap only."""
    return (mix64(ids.view(U64)) + lines.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)


def later_matches(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, inside: np.ndarray | None = None) -> list[int]:
    """Of sets in order of position, each in order of rarity (level, hash): those that match an earlier one.

    With side, 0 or 1 for each set, sets of one side are compared with each other only where inside says so.
    """
    if not sets:
        return []
    side = [0] * len(sets) if side is None else side.tolist()
    inside = [True] * len(sets) if inside is None else inside.tolist()
    size = [len(s) for s in sets]
    # tokens as small numbers, so that the tokens of one set can be marked in an array
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    small = np.split(flat, np.cumsum(size)[:-1])
    mark = np.full(len(flat), -1, np.int64)
    index: dict[int, list[tuple[int, int]]] = {}
    out = []
    for x, tokens in enumerate(small):
        n = size[x]
        cut = n - least_overlap(n, percent) + 1
        seen: set[int] = set()
        found = marked = False
        head = tokens[:cut].tolist()
        for i, token in enumerate(head):
            if found:
                break
            for y, j in index.get(token, ()):
                if y in seen:
                    continue
                seen.add(y)
                m = size[y]
                if percent * max(n, m) > 100 * min(n, m) or side[x] == side[y] and not inside[x]:
                    continue
                need = pair_overlap(n, m, percent)
                # the first common prefix token: nothing before it is common, at most the shorter rest follows
                if 1 + min(n - i - 1, m - j - 1) < need:
                    continue
                if not marked:
                    mark[tokens], marked = x, True
                if np.count_nonzero(mark[small[y]] == x) >= need:
                    found = True
                    break
        if found:
            out.append(x)
        for i, token in enumerate(head):
            index.setdefault(token, []).append((x, i))
    return out


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, short: bool = False) -> DataFrame:
    """(doc_id, line) of the lines to remove; lines count from 0."""
    small_batches(docs.sparkSession)
    d = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    context = docs.sparkSession.sparkContext

    def survey(batches):
        """Each line's set in short, and whether this task had an equal line before it; at the end, the task's counts of tokens."""
        cells, seen = CellCounts(), Seen()
        for batch in batches:
            for b in slices(batch, "t"):
                h, at, by_text, few = line_windows(b, width, short)
                full = np.flatnonzero(np.diff(at) > 0)
                tokens, own = distinct_flat(h, np.append(at[full], at[-1]))
                cells.add(tokens[np.repeat(~few[full], np.diff(own))])
                s1, s2 = signatures(tokens, own)
                ids, lines = _where(b, by_text, full)
                n = np.diff(own)
                copy, _ = seen.earlier(s1, s2, n, ids, lines)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines, pa.int32()), pa.array(n), pa.array(s1), pa.array(s2), pa.array(copy), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
        k, parts = cells.rows()
        none = [pa.nulls(len(k), kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
        yield pa.RecordBatch.from_arrays([*none, k, parts], names)

    names = ["doc_id", "line", "n", "s1", "s2", "copy", "k", "part"]
    table = saved(d.mapInArrow(lean(survey), "doc_id long, line int, n long, s1 long, s2 long, copy boolean, k int, part binary"))
    order = context.broadcast(rarity(table.filter("k IS NOT NULL")))
    items = table.filter("k IS NULL").drop("k", "part")
    alike = W.partitionBy("s1", "s2", "n").orderBy("doc_id", "line")
    place = F.struct("doc_id", "line")
    ranked = saved(items.filter("NOT copy").drop("copy").withColumn("lead", F.row_number().over(alike) == 1).withColumn("copy", F.first(place).over(alike) != place))
    copies = items.filter("copy").union(ranked.filter("copy").select(items.columns)).select("doc_id", "line")
    first = ranked.filter("lead").select("s1", "n", "doc_id", "line")

    def postings(batches):
        seen = Seen()
        for batch in batches:
            for b in slices(batch, "t"):
                # only lines of equal words share the token of a short line, and these are one class: it needs no partner
                h, at, by_text, _ = line_windows(b, width)
                full = np.flatnonzero(np.diff(at) > 0)
                tokens, own = distinct_flat(h, np.append(at[full], at[-1]))
                s1, s2 = signatures(tokens, own)
                # a set's prefix is sent once from each task as a rule, so that a line with many copies is not many postings
                again, _ = seen.earlier(s1, s2, np.diff(own), *_where(b, by_text, full))
                keep = ~again
                tokens, own = tokens[np.repeat(keep, np.diff(own))], np.concatenate([[0], np.cumsum(np.diff(own)[keep])])
                cut, ends = prefixes(tokens, own, order.value, percent, PART)
                each = np.diff(ends)
                yield pack(cut, np.repeat(s1[keep], each), np.repeat(np.diff(own), each), order.value.buckets)

    # candidates by the first half of the signature: two classes that share it only make a group larger
    groups = saved(candidate_groups(d.mapInArrow(lean(postings), PACKED), percent, PART))
    known = likely(first, "s1", groups.select("id"))
    classes = saved(known.join(groups, F.col("s1") == F.col("id")).drop("id"))
    places = lambda b: _place(*(np.asarray(b.column(c), np.int64) for c in ("doc_id", "line")))

    def leads(members):
        """Of batches of documents: ids, lines and tokens by line of the lines where members stand, and a few others."""
        wanted = context.broadcast((id_filter(members.select(F.col("doc_id").alias("id"))), id_filter(members.select("doc_id", "line"), places)))

        def lines_of(batches):
            texts, spots = wanted.value
            for batch in batches:
                mine = in_filter(texts, np.asarray(batch.column("d"), np.int64))
                for b in slices(batch.filter(pa.array(mine)), "t"):
                    h, at, by_text, _ = line_windows(b, width)
                    full = np.flatnonzero(np.diff(at) > 0)
                    ids, lines = _where(b, by_text, full)
                    hit = np.flatnonzero(in_filter(spots, _place(ids, lines)))
                    yield ids[hit], lines[hit], [np.unique(h[at[k] : at[k + 1]]) for k in full[hit]]

        return lines_of

    def read(members):
        lines_of = leads(members)

        def sets_of(batches):
            for _, _, sets in lines_of(batches):
                tokens, own = np.concatenate([np.zeros(0, U64), *sets]), np.cumsum([0, *map(len, sets)])
                yield signatures(tokens, own)[0], tokens, own

        return d, sets_of

    classes = refined(classes, "s1", read, percent, FINER_PART, BLOCK_SETS, BLOCK_TOKENS)
    pairs, partitions = blocks(classes, "s1", BLOCK_SETS, BLOCK_TOKENS, percent)

    def sets_of(members):
        lines_of = leads(members)

        def fetch(batches):
            for ids, lines, sets in lines_of(batches):
                by_level = [by_rarity(x, order.value.level) for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lines, pa.int32()), binary_sets(by_level)], ["doc_id", "line", "tokens"])

        return d.mapInArrow(lean(fetch), "doc_id long, line int, tokens binary")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("line", "ascending")])
        # rows that repeat an id and text give a position more than once
        d, k = (np.asarray(rows.column(c)) for c in ("doc_id", "line"))
        once = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])))
        rows = rows.select(["doc_id", "line", "side", "inside", "tokens"]).take(pa.array(once))
        out = later_matches(unpack_sets(rows.column("tokens")), percent, np.asarray(rows.column("side")), np.asarray(rows.column("inside")).astype(bool))
        if rows.nbytes > 1 << 20:
            give_back()
        return rows.select(["doc_id", "line"]).take(pa.array(out, pa.int64()))

    matched = compared(pairs, classes, sets_of, ["doc_id", "line"], partitions, order.value.tokens, compare, "doc_id long, line int")
    out = saved(copies.union(matched).distinct())
    discard(groups, classes, ranked, table)
    return out


def _where(batch: pa.RecordBatch, by_text: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document ids and line numbers of lines of a batch."""
    text = np.searchsorted(by_text, lines, "right") - 1
    return np.asarray(batch.column("d"), np.int64)[text], lines - by_text[text]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, short: bool = False) -> DataFrame:
    """docs with the repeated lines taken out of their texts, and n_lines_removed (it replaces a column of that name)."""
    gone = saved(repeated_lines(docs, id_col, text_col, width, percent, short).groupBy(F.col("doc_id").alias("__d")).agg(F.collect_list("line").alias("__gone")))
    base = docs.drop("n_lines_removed")
    # only texts that may lose lines are shuffled to meet their lines' numbers
    hit = docs.sparkSession.sparkContext.broadcast(id_filter(gone.select(F.col("__d").alias("id"))))

    @F.arrow_udf("boolean")
    def maybe(ids: pa.Array) -> pa.Array:
        return pa.array(in_filter(hit.value, np.asarray(ids.fill_null(0), np.int64)))

    base = base.withColumn("__maybe", maybe(F.col(id_col).cast("long")))
    same = base.filter(~F.col("__maybe")).drop("__maybe").withColumn("n_lines_removed", F.lit(0).cast("long"))
    some = base.filter("__maybe").drop("__maybe").join(gone.hint("merge"), F.col(id_col).cast("long") == F.col("__d"), "left").drop("__d")

    def cut(batches):
        for b in batches:
            texts, n = b.column(text_col).to_pylist(), []
            for k, lines in enumerate(b.column("__gone").to_pylist()):
                n.append(len(lines or ()))
                if lines and texts[k] is not None:
                    lines = set(lines)
                    texts[k] = "\n".join(x for j, x in enumerate(texts[k].split("\n")) if j not in lines)
            new = {text_col: pa.array(texts, b.column(text_col).type), "n_lines_removed": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names)

    names = same.columns
    return same.unionByName(some.mapInArrow(lean(cut), same.schema))
