"""Task graphs as DataFrames: tasks(id, ...), edges(source, target, ...), values(...).

Fixpoints loop on the driver over frontiers; each round is a job whose rows stay on the executors and are written to the shared
checkpoint folder, so that no round's plan grows.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.  Only a local session (tests) gets one of its own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="rounds-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(frame: DataFrame) -> DataFrame:
    """frame without its lineage, kept in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def sources(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks that depend on nothing."""
    return tasks.join(edges, tasks["id"] == edges["target"], "left_anti")


def sinks(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """Tasks on which nothing depends."""
    return tasks.join(edges, tasks["id"] == edges["source"], "left_anti")


def levels(tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 for sources, else one more than the highest level of a parent.  A cycle raises.

    Tasks of one parent hang on an anchor, a task of none or several: doubling finds it and the steps from it in as many rounds as the
    longest chain has binary digits.  Longest paths between anchors are then followed, a round for each anchor on the longest one.
    """
    pairs = cut(edges.select("source", "target").distinct())
    parents = pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("up"))
    found = tasks.select("id").distinct().join(parents, "id", "left")
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    now = cut(found.select("id", F.when(one, F.col("up")).otherwise(F.col("id")).alias("anchor"), one.cast("long").alias("steps"), (~one).alias("done")))
    longest = now.count()
    rounds = 0
    while not now.filter("NOT done").isEmpty():
        if 1 << rounds > longest:
            raise ValueError("the graph has a cycle")
        up = now.select(F.col("id").alias("anchor"), F.col("anchor").alias("higher"), F.col("steps").alias("more"), F.col("done").alias("up_done"))
        open_ = now.filter("NOT done").join(up, "anchor").select("id", F.col("higher").alias("anchor"), (F.col("steps") + F.col("more")).alias("steps"), F.col("up_done").alias("done"))
        now, rounds = cut(now.filter("done").union(open_)), rounds + 1
    # edges into anchors, between anchors; their weights are the steps of the path
    several = parents.filter("n > 1").select(F.col("id").alias("target"))
    ways = pairs.join(several, "target", "left_semi").join(now.select(F.col("id").alias("source"), "anchor", "steps"), "source")
    ways = cut(ways.groupBy(F.col("anchor").alias("source"), "target").agg((F.max("steps") + 1).alias("steps")))
    at = cut(now.filter("id = anchor").select("id", F.lit(0).cast("long").alias("level")))
    anchors, front, k = at.count(), at, 0
    while not (front := cut(front.join(ways, front["id"] == ways["source"]).groupBy(F.col("target").alias("id")).agg(F.max(F.col("level") + F.col("steps")).alias("level")))).isEmpty():
        k += 1
        if k > anchors:
            raise ValueError("the graph has a cycle")
        known = at.withColumnRenamed("level", "was")
        front = cut(front.join(known, "id").filter("level > was").select("id", "level"))
        at = cut(at.union(front).groupBy("id").agg(F.max("level").alias("level")))
    return now.join(at.select(F.col("id").alias("anchor"), "level"), "anchor").select("id", (F.col("level") + F.col("steps")).alias("level"))


def closure(edges: DataFrame) -> DataFrame:
    """(source, target) for every path; cycles are allowed.  Paths double in length each round, and only new ones are extended."""
    found = fresh = cut(edges.select("source", "target").distinct())
    while not fresh.isEmpty():
        on = found.select(F.col("source").alias("mid"), F.col("target").alias("end"))
        longer = fresh.join(on, fresh["target"] == on["mid"]).select("source", F.col("end").alias("target")).distinct()
        fresh = cut(longer.join(found, ["source", "target"], "left_anti"))
        found = cut(found.union(fresh))
    return found


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(path): a shortest path, the first in the order of names; no row if there is none."""
    pairs = edges.select("source", "target").distinct()
    frontier = cut(edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>"))
    seen = frontier.select("node")
    while True:
        hit = frontier.filter(F.col("node") == end).select("path")
        if not hit.isEmpty() or frontier.isEmpty():
            return hit
        step = frontier.join(pairs, frontier["node"] == pairs["source"]).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        frontier = cut(step.groupBy("node").agg(F.min("path").alias("path")).join(seen, "node", "left_anti"))
        seen = cut(seen.union(frontier.select("node")))


def ready(tasks: DataFrame, edges: DataFrame, completed: DataFrame) -> DataFrame:
    """Tasks not completed whose parents all are."""
    open_parents = edges.join(completed, edges["source"] == completed["id"], "left_anti")
    return tasks.join(completed, "id", "left_anti").join(open_parents, tasks["id"] == open_parents["target"], "left_anti")


def completion_errors(tasks: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """From completions (seq, id): those that repeat an earlier one (duplicate), come before a parent's (early) or name no task (unknown)."""
    first = events.groupBy("id").agg(F.min("seq").alias("first"))
    parents = edges.join(first.withColumnRenamed("id", "source"), "source", "left").groupBy(F.col("target").alias("id")).agg(F.max(F.coalesce("first", F.lit(2**62))).alias("parents"))
    e = events.join(first, "id").join(parents, "id", "left").join(tasks.select("id", F.lit(True).alias("known")), "id", "left")
    kind = F.when(F.col("known").isNull(), "unknown").when(F.col("seq") > F.col("first"), "duplicate").when(F.col("parents") > F.col("seq"), "early")
    return e.withColumn("error", kind).filter("error IS NOT NULL").select("seq", "id", "error")


def violations(tasks: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """(rule, subject) for every broken rule of a graph: repeated ids, dangling ends, loops, missing producers and readers."""
    ids = tasks.select("id")
    dup = lambda frame, key, rule: frame.groupBy(key).count().filter("count > 1").select(F.lit(rule).alias("rule"), F.col(key).alias("subject"))
    miss = lambda frame, key, rule: frame.join(ids, frame[key] == ids["id"], "left_anti").select(F.lit(rule).alias("rule"), F.col(key).alias("subject")).distinct()
    pair = edges.withColumn("pair", F.concat_ws("->", "source", "target"))
    read = tasks.select("id", F.explode("inputs").alias("value"))
    unknown = read.join(values, read["value"] == values["value_id"], "left_anti").select(F.lit("unknown_input").alias("rule"), "value").distinct()
    loops = edges.filter("source = target").select(F.lit("loop").alias("rule"), F.col("source").alias("subject")).distinct()
    parts = [dup(tasks, "id", "repeated_task"), dup(pair, "pair", "repeated_edge"), dup(values, "value_id", "repeated_value"), miss(edges, "source", "dangling_source"), miss(edges, "target", "dangling_target"), miss(values, "producer", "missing_producer"), loops, unknown]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def required_values(tasks: DataFrame, values: DataFrame) -> DataFrame:
    """(id, value_id, producer) for the inputs of each task."""
    read = tasks.select("id", F.explode("inputs").alias("value_id"))
    return read.join(values.select("value_id", "producer"), "value_id").select("id", "value_id", "producer")


def parallel_counts(tasks: DataFrame, paths: DataFrame) -> DataFrame:
    """(id, beside): with how many others each certain task that may run anywhere can run at a time, having no path either way.

    Counts need no pairs: of all such tasks, those on a path from or to it do not fit.
    """
    free = tasks.filter("certainty = 'certain' AND placement = 'isolated'").select("id")
    both = paths.select(F.col("source").alias("id"), F.col("target").alias("other")).union(paths.select(F.col("target").alias("id"), F.col("source").alias("other"))).filter("id <> other").distinct()
    on_path = both.join(free, "id", "left_semi").join(free.withColumnRenamed("id", "other"), "other", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
    every = free.agg(F.count("*").alias("every"))
    return free.join(on_path, "id", "left").join(F.broadcast(every)).select("id", (F.col("every") - 1 - F.coalesce("n", F.lit(0))).alias("beside"))


def parallel_with(tasks: DataFrame, paths: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b): for the tasks asked for (id), a few, the others that can run at the same time."""
    free = tasks.filter("certainty = 'certain' AND placement = 'isolated'").select("id")
    wanted = asked.join(free, "id", "left_semi").agg(F.collect_set("id").alias("ids"))
    pairs = free.withColumnRenamed("id", "b").join(F.broadcast(wanted)).select(F.explode("ids").alias("a"), "b").filter("a <> b")
    both = paths.select(F.col("source").alias("a"), F.col("target").alias("b")).union(paths.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    return pairs.join(both, ["a", "b"], "left_anti")


def latest_bindings(bindings: DataFrame) -> DataFrame:
    """(name, value_id): the last binding of each name."""
    return bindings.groupBy("name").agg(F.max_by("value_id", "ord").alias("value_id"))


def ancestor_bindings(paths: DataFrame, values: DataFrame) -> DataFrame:
    """(task, name, value_id): of each name, the newest version that an ancestor of the task made."""
    made = paths.join(values, paths["source"] == values["producer"])
    return made.groupBy(F.col("target").alias("task"), "name").agg(F.max_by("value_id", "version").alias("value_id"))


def alias_roots(values: DataFrame) -> DataFrame:
    """(value_id, root): aliases followed while the object stays the same, by pointer doubling."""
    step = values.select("value_id", "alias_of", "object_id")
    up = values.select(F.col("value_id").alias("alias_of"), F.col("object_id").alias("up_object"))
    now = cut(step.join(up, "alias_of", "left").select("value_id", F.when(F.col("up_object") == F.col("object_id"), F.col("alias_of")).otherwise(F.col("value_id")).alias("root")))
    while True:
        nxt = now.select(F.col("value_id").alias("root"), F.col("root").alias("higher"))
        moved = cut(now.join(nxt, "root", "left").select("value_id", "root", F.coalesce("higher", "root").alias("higher")))
        if moved.filter("root <> higher").isEmpty():
            return moved.select("value_id", "root")
        now = moved.select("value_id", F.col("higher").alias("root"))


def write_hazards(versions: DataFrame) -> DataFrame:
    """From accesses (ord, task, name, kind in read | write): (source, target, hazard) RAW, WAR and WAW edges of each name.

    A read depends on the write before it, a write on the write before it and on the reads since.
    """
    w = W.partitionBy("name").orderBy("ord")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    v = versions.withColumn("last_write", F.last(F.when(F.col("kind") == "write", F.col("task")), True).over(before))
    v = v.withColumn("epoch", F.coalesce(F.sum((F.col("kind") == "write").cast("long")).over(before), F.lit(0)))
    raw = v.filter("kind = 'read' AND last_write IS NOT NULL").select(F.col("last_write").alias("source"), F.col("task").alias("target"), F.lit("RAW").alias("hazard"))
    waw = v.filter("kind = 'write' AND last_write IS NOT NULL").select(F.col("last_write").alias("source"), F.col("task").alias("target"), F.lit("WAW").alias("hazard"))
    reads = v.filter("kind = 'read'").select("name", "epoch", F.col("task").alias("source"))
    writes = v.filter("kind = 'write'").select("name", "epoch", F.col("task").alias("target"))
    war = reads.join(writes, ["name", "epoch"]).select("source", "target", F.lit("WAR").alias("hazard"))
    return raw.union(waw).union(war).filter("source <> target").distinct()


def frontier_edges(tasks: DataFrame, edges: DataFrame, barrier: str) -> DataFrame:
    """Edges that a barrier after all tasks needs: from the current sinks only."""
    return sinks(tasks, edges).select(F.col("id").alias("source"), F.lit(barrier).alias("target"))


def widths(level: DataFrame) -> DataFrame:
    return level.groupBy("level").agg(F.count("*").alias("width"))


def plan_digest(edges: DataFrame) -> DataFrame:
    """(digest) of a graph's edges, whatever their order: of sorted edges by bucket (the first three digits of their own digests), then of the 4096 buckets'."""
    text = edges.select(F.concat_ws(">", "source", "target").alias("edge"))
    by = text.groupBy(F.substring(F.sha2("edge", 256), 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("edge")), ";"), 256).alias("digest"))
    return by.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "digest"))), ";"), 256).alias("digest"))


def numbered(frame: DataFrame, keys: list, column: str) -> DataFrame:
    """Adds the place, from 1, of each row in the order of keys: rows are sorted in ranges, and only one count for each range is summed up."""
    ranges = cut(frame.repartitionByRange(*keys).sortWithinPartitions(*keys))
    at = F.monotonically_increasing_id()
    rows = ranges.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).drop("__n")
    return rows.join(F.broadcast(before), "__part").withColumn(column, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
