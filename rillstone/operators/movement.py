"""Where values come from, how many move at once, what leaves a full cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut

#: Transfers at most that a worker sends, and receives, at a time.
LANES = 4


def transfer_sources(needs: DataFrame, replicas: DataFrame) -> DataFrame:
    """(value, destination, source): for each value that its destination lacks, the first worker that has it."""
    have = replicas.select("value", F.col("worker").alias("destination"))
    lacking = needs.join(have, ["value", "destination"], "left_anti")
    return lacking.join(replicas.groupBy("value").agg(F.min("worker").alias("source")), "value")


def admitted(transfers: DataFrame, lanes: int = LANES) -> DataFrame:
    """Transfers (id, source, destination) with admitted, as if taken one by one in order of id: each goes if both its sides have a lane left.

    One that does not go uses no lane.  Rounds settle many at once: a transfer among the first `lanes` of those on both its sides that
    have gone or are open goes; one with a side on which `lanes` earlier ones have gone does not.  The first open one is always settled.
    """
    gone = None
    left = cut(transfers.select("id", "source", "destination", F.lit(None).cast("boolean").alias("admitted")))
    while True:
        before = lambda side: W.partitionBy(side).orderBy("id").rowsBetween(W.unboundedPreceding, -1)
        went = lambda side: F.coalesce(F.sum(F.col("admitted").cast("int")).over(before(side)), F.lit(0))
        ahead = lambda side: F.count("*").over(before(side))
        now = left.withColumn("full", F.greatest(went("source"), went("destination")) >= lanes).withColumn("late", F.greatest(ahead("source"), ahead("destination")) >= lanes)
        settled = F.when(F.col("admitted").isNotNull(), F.col("admitted")).when(F.col("full"), F.lit(False)).when(~F.col("late"), F.lit(True))
        now = cut(now.withColumn("admitted", settled).drop("full", "late"))
        # those that do not go are out of the way of all others
        refused = now.filter("admitted = false")
        gone = refused if gone is None else gone.union(refused)
        left = now.filter("admitted IS NULL OR admitted")
        if left.filter("admitted IS NULL").isEmpty():
            return gone.union(left)


def content_groups(frame: DataFrame, column: str, id_col: str) -> DataFrame:
    """(digest, first, copies): rows with equal content."""
    return frame.groupBy(F.sha2(F.col(column), 256).alias("digest")).agg(F.min(id_col).alias("first"), F.count("*").alias("copies"))


def evicted(cache: DataFrame, room: int) -> DataFrame:
    """Entries (pool, id, last_used, bytes, pinned) to drop, least recently used first, until the rest fits; pinned ones stay."""
    w = W.partitionBy("pool").orderBy(F.col("pinned").desc(), F.col("last_used").desc(), F.col("id").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cache.withColumn("kept_bytes", F.sum("bytes").over(w)).filter((F.col("kept_bytes") > room) & ~F.col("pinned"))


def transfer_states(events: DataFrame) -> DataFrame:
    """(id, state) of each transfer after its events (id, seq, kind), by the furthest step; failure and completion are final, first of them wins."""
    steps = ["prepare", "ready", "requested", "accepted", "started"]
    order = F.array(*map(F.lit, steps))
    final = F.when(F.col("kind").isin("completed", "failed"), F.struct("seq", "kind"))
    per = events.groupBy("id").agg(F.min(final).alias("final"), F.max(F.array_position(order, F.col("kind"))).alias("step"))
    return per.select("id", F.coalesce(F.col("final.kind"), F.element_at(order, F.greatest(F.col("step"), F.lit(1)).cast("int"))).alias("state"))
