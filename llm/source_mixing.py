"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Each source has a weight and a target: all words are shared out by weight, no source is asked for over ``limit`` times its own
words, and what it cannot give is shared out anew among the others (water filling).  A source's documents, in a fixed random
order, are repeated in whole passes until the target is met; the last pass stops at the word that meets it, so the words taken
from a source are its target, rounded down.

Time runs from 0 to 1.  A source's share of its target that is due at time t is ``1 + ramp * (2 t - 1)``; its integral
``(1 - ramp) t + ramp t^2`` is inverted at each copy's place among the source's words, which gives the copy's training position.
The curriculum is the copies in order of position.

Sums along a source are taken in two levels (blocks by a hash of the id, then within a block), so a source of any size is spread
over all tasks.  Only one row for each (source, block) is summed by source, and one row for each source overall.

Copies of equal positions, which only documents of different sources have, stand in any order.

Edge cases: a null text has 0 words, as an empty one; such documents are never taken; a null source is a source of its own, last in
order; repeated rows are documents of their own; ties in the order go by id, then size; an empty table gives an empty result; the
operator's own columns replace columns of the input with the same names, other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import saved

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """Words of a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], ramps: tuple[float, ...], limit: float) -> DataFrame:
    """From one row for each source (key, source_size): weight, ramp and target."""
    n = len(weights)
    turn = (F.row_number().over(W.orderBy("key")) - 1) % n
    pick = lambda values: F.element_at(F.array(*map(F.lit, map(float, values))), (F.col("turn") + 1).cast("int"))
    t = sizes.withColumn("turn", turn).withColumn("weight", pick(weights)).withColumn("ramp", pick(ramps))
    t = t.withColumn("most", F.col("source_size") * F.lit(float(limit)))
    # sources in the order in which they reach their limits: the level that the k-th one and all later ones would get rises up to
    # the first source that stays under its limit and falls after it
    up = W.orderBy(F.col("most") / F.col("weight"), "key")
    t = t.withColumn("sum_most", F.sum("most").over(up.rowsBetween(W.unboundedPreceding, -1))).withColumn("sum_weight", F.sum("weight").over(up.rowsBetween(W.currentRow, W.unboundedFollowing)))
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce("sum_most", F.lit(0.0))) / F.col("sum_weight")
    t = t.withColumn("level", F.when(level * F.col("weight") <= F.col("most"), level))
    return t.withColumn("target", F.least("most", F.col("weight") * F.max("level").over(everything))).select("key", "source_size", "weight", "ramp", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[float, ...] = (1, 2, 3), ramps: tuple[float, ...] = (-0.5, 0.0, 0.5), limit: float = 3.0) -> DataFrame:
    """Adds source_size, target, taken (words) and copies, an array of (words, position) in order, to every row.

    docs is read twice: once for the sums, once for the result.
    """
    rows = docs.count()
    blocks = 1 << max(6, min(16, (rows // 2000).bit_length()))
    own = ("source_size", "target", "taken", "copies")
    d = docs.drop(*own).withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t"))).withColumn("__h", F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    d = d.withColumn("__block", F.shiftright(F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"), 17 - blocks.bit_length()))
    sums = saved(d.groupBy(F.col("__key").alias("key"), F.col("__block").alias("block")).agg(F.sum(size_col).alias("n")))
    by_source = targets(sums.groupBy("key").agg(F.sum("n").alias("source_size")), weights, ramps, limit)
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("key").orderBy("block")) - F.col("n")).drop("n").join(by_source, "key")
    within = W.partitionBy("__key", "__block").orderBy("__h", id_col, size_col).rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("__upto", F.sum(size_col).over(within)).join(before, (F.col("__key") == F.col("key")) & (F.col("__block") == F.col("block")))
    size, all_, start = F.col(size_col), F.col("source_size"), F.col("before") + F.col("__upto") - F.col(size_col)
    asked = F.floor("target").cast("long")
    passes = F.when(all_ > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0).cast("int")
    part = F.when(all_ > 0, F.least(F.greatest(asked - passes * all_ - start, F.lit(0)), size)).otherwise(0).cast("long")
    d = d.withColumn("__passes", passes).withColumn("__part", part).withColumn("__start", start)
    d = d.withColumn("taken", F.col("__passes") * size + F.col("__part"))

    def copy(p: Column) -> Column:
        n = F.when(p < F.col("__passes"), size).otherwise(F.col("__part"))
        due = F.least((p * all_ + F.col("__start") + n / 2) / F.col("target"), F.lit(1.0))
        g = F.col("ramp")
        at = F.when(g == 0, due).otherwise((F.sqrt((1 - g) * (1 - g) + 4 * g * due) - (1 - g)) / (2 * g))
        return F.struct(n.cast("long").alias("words"), at.alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0), F.col("__passes")), copy), lambda c: c["words"] > 0)
    d = d.withColumn("copies", F.when(F.col("taken") > 0, copies).otherwise(F.array().cast("array<struct<words:bigint,position:double>>")))
    return d.drop("__key", "__h", "__block", "__upto", "__passes", "__part", "__start", "key", "block", "before", "weight", "ramp")


def curriculum(mixed: DataFrame, size_col: str = "size", partitions: int | None = None) -> DataFrame:
    """One row for each copy taken, in training order: a last pass's cut document is there if at least half of it is taken.

    Positions are close to even over [0, 1], so ranges of equal width deal them out: range-sorting needs no sample of the rows.
    """
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = mixed.withColumn("__copy", F.explode("copies")).filter(F.col("__copy.words") * 2 >= F.col(size_col)).withColumn("position", F.col("__copy.position")).drop("__copy", "copies")
    return whole.repartitionById(n, F.least(F.floor(F.col("position") * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("position")


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each document, range-sorted by the position of its first copy (documents that are not taken come last).

    Adds n_copies and the positions of the first and the last copy, null for none.
    """
    n = partitions or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = lambda k: F.try_element_at("copies", F.lit(k))["position"]
    out = mixed.withColumn("n_copies", F.size("copies").cast("long")).withColumn("first_position", place(1)).withColumn("last_position", place(-1)).drop("copies")
    return out.repartitionById(n, F.least(F.floor(F.coalesce("first_position", F.lit(1.0)) * n), F.lit(n - 1)).cast("int")).sortWithinPartitions(F.col("first_position").asc_nulls_last())


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY key),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY encode(key)) - 1) % 3 + 1 AS DOUBLE) AS weight, ([-0.5::DOUBLE, 0::DOUBLE, 0.5::DOUBLE])[(row_number() OVER (ORDER BY encode(key)) - 1) % 3 + 1] AS g, source_size * 3.0::DOUBLE AS most FROM s),
u AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, encode(key) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sum_most,
         sum(weight) OVER (ORDER BY most / weight, encode(key) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sum_weight,
         CAST(sum(source_size) OVER () AS DOUBLE) AS everything FROM w),
v AS (SELECT *, CASE WHEN (everything - sum_most) / sum_weight * weight <= most THEN (everything - sum_most) / sum_weight END AS level FROM u),
t AS (SELECT key, source_size, g, least(most, weight * max(level) OVER ()) AS target FROM v),
c AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.g, CAST(floor(target) AS BIGINT) AS asked,
         CAST(sum(d.size) OVER (PARTITION BY d.key ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM d JOIN t USING (key)),
p AS (SELECT *, CASE WHEN source_size > 0 THEN asked // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN greatest(0, least(size, asked % source_size - start)) ELSE 0 END AS part FROM c),
-- the first copy is in pass 0, the last in the cut pass if that takes a word of it; a copy's place is its middle word
q AS (SELECT *, passes * size + part AS taken, CASE WHEN size = 0 THEN 0 ELSE passes + CAST(part > 0 AS BIGINT) END AS n_copies,
         CASE WHEN passes > 0 THEN size ELSE part END AS first_words, CASE WHEN part > 0 THEN passes ELSE passes - 1 END AS last_pass, CASE WHEN part > 0 THEN part ELSE size END AS last_words FROM p),
r AS (SELECT *, least((start + CAST(first_words AS DOUBLE) / 2) / target, 1.0::DOUBLE) AS due_first, least((last_pass * source_size + start + CAST(last_words AS DOUBLE) / 2) / target, 1.0::DOUBLE) AS due_last FROM q)
SELECT doc_id, size, source_size, target, taken, n_copies,
  CASE WHEN n_copies > 0 THEN CASE WHEN g = 0 THEN due_first ELSE (sqrt((1 - g) * (1 - g) + 4 * g * due_first) - (1 - g)) / (2 * g) END END AS first_position,
  CASE WHEN n_copies > 0 THEN CASE WHEN g = 0 THEN due_last ELSE (sqrt((1 - g) * (1 - g) + 4 * g * due_last) - (1 - g)) / (2 * g) END END AS last_position
FROM r
"""
