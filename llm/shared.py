"""Spark helpers of the operators: saved stages, bounded batches, samples of training rows, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker: operators on texts and vectors hold a few of them at a time.
BATCH_BYTES = 1 << 20
#: Bytes of a row group of a table that Python workers write.
ROW_GROUP_BYTES = 8 << 20
#: Values of a label whose counts are sent to all tasks.
MOST_LABELS = 10_000
#: Edges that one task labels at the end of connected components.
LAST_EDGES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session (tests) gets one of its own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="saved-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: rows may hold long texts, so their number says little."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", spark.conf.get(key).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, whose worker gives freed memory back at the end: workers live on between stages."""

    def trimmed(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return trimmed


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def saved(df: DataFrame, in_python: bool = False) -> DataFrame:
    """The rows of df, written once as a table in the shared folder: it cuts the lineage and outlives lost executors.

    The shuffle files that led to the table are removed once it is written.  With in_python, the tasks' Python workers write it where the
    shared folder is a local path on all machines: Hadoop starts two chmod processes there for each file, if it lacks its native library,
    and a process that starts holds its executor's memory once more for an instant.
    """
    spark = df.sparkSession
    path, key = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    local = _local_path(spark, path) if in_python else None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        _write(df, local) if local else df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def saved_in_python(df: DataFrame) -> DataFrame:
    """For operators that run Python workers anyway, and for tables of plain columns."""
    return saved(df, in_python=True)


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path on a local (or mounted) file system; None on any other."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return hadoop.toUri().getPath() if system.getUri().getScheme() == "file" else None


def _write(df: DataFrame, folder: str) -> None:
    """Writes df as Parquet files, by the Python workers.  Only files of tasks that count get into the folder, whatever was tried again."""
    parts = f"{folder}.parts"

    def write(batches: Iterator) -> Iterator:
        name, file, waiting, some = f"part-{uuid.uuid4().hex}.parquet", None, [], 0
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                some += b.nbytes
            if some >= ROW_GROUP_BYTES:
                file = file or pq.ParquetWriter(f"{parts}/{name}", b.schema)
                file.write_table(pa.Table.from_batches(waiting))
                waiting, some = [], 0
        if waiting:
            file = file or pq.ParquetWriter(f"{parts}/{name}", waiting[0].schema)
            file.write_table(pa.Table.from_batches(waiting))
        if file:
            file.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    os.makedirs(parts)
    try:
        names = [r[0] for r in df.mapInArrow(lean(write), "name string").collect()]
        os.makedirs(folder)
        for name in names:
            os.rename(f"{parts}/{name}", f"{folder}/{name}")
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables.  Only for those on which nothing depends any more but what is itself saved."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._saved_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hashed_rows(df: DataFrame, key: str, id_col: str, rows: int) -> DataFrame:
    """(id, key, h) of about `rows` rows, seldom more, for each value of key that is not null: those whose hash h of the id is low enough.

    A value's count sets its limit, so nothing is ranked.  Counts are sent to all tasks if there are at most MOST_LABELS of them, so that
    no row moves but those of the sample; else they are joined.
    """
    known = df.select(id_col, key).filter(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    counts = known.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    few = counts.limit(MOST_LABELS + 1).collect()
    if len(few) <= MOST_LABELS:
        counts = F.broadcast(df.sparkSession.createDataFrame(few, counts.schema))
    unit = F.pmod(F.xxhash64(id_col), F.lit(1 << 31)) / float(1 << 31)
    limit = max(1.0, rows - 2 * rows**0.5)
    return known.join(counts, F.col(key) == F.col("__key")).filter(unit * F.col("__n") <= limit).select(id_col, key, F.xxhash64(id_col).alias("h")).distinct()


def _labels(batches: Iterator) -> Iterator:
    """(u, to) of the nodes of a few edges (u, v): the smallest node that each is connected with."""
    edges = [np.stack([np.asarray(b.column(c), np.int64) for c in ("u", "v")]) for b in batches]
    nodes, at = np.unique(np.concatenate([*edges, np.zeros((2, 0), np.int64)], axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["u", "to"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component being the smallest node of its component.

    Each round moves every node to the neighbour that comes first in a random order and contracts the edges, which leaves a
    constant fraction of the nodes; once at most LAST_EDGES are left, one task labels what they connect; the moves are then followed
    back.  Nodes of any degree are aggregated with partial sums or met in plain joins of two saved tables, which Spark splits where a key
    is skewed.  Loops (a, a) are allowed and give single nodes.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    now = saved_in_python(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct())
    nodes = saved_in_python(now.select("u").union(now.select("v")).distinct())
    moves, now_table = [], now
    now = now.filter("u <> v")
    while (left := now.count()) > LAST_EDGES:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least(rank("u"), rank("v"))).alias("m")).select("u", F.col("m.v").alias("to"))
        least = saved_in_python(least)
        moves.append(least)
        moved = now.join(least.withColumnRenamed("to", "tu"), "u").select("tu", "v")
        now = moved.join(least.select(F.col("u").alias("v"), F.col("to").alias("tv")), "v").filter("tu <> tv").select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct()
        now, done = saved_in_python(now), now_table
        discard(done)
        now_table = now
    if left:
        moves.append(saved_in_python(now.coalesce(1).mapInArrow(_labels, "u long, to long")))
    discard(now_table)
    root = None
    for least in reversed(moves):
        if root is None:
            root = least.select("u", F.col("to").alias("root"))
        else:
            up = root.select(F.col("u").alias("to"), "root")
            root = least.join(up, "to", "left").select("u", F.coalesce("root", "to").alias("root"))
    if root is None:
        return nodes.select(F.col("u").alias("node"), F.col("u").alias("component"))
    # written apart, so that Spark can split the join of a root with very many nodes
    labelled = saved_in_python(nodes.join(root, "u", "left").select("u", F.coalesce("root", "u").alias("root")))
    name = saved_in_python(labelled.groupBy("root").agg(F.min("u").alias("component")).filter("root <> component"))
    discard(nodes, *moves)
    return labelled.join(name, "root", "left").select(F.col("u").alias("node"), F.coalesce("component", "root").alias("component"))
