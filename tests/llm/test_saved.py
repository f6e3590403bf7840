"""Tables that Python workers write: equal rows, no processes that hold an executor's memory once more, nothing of tasks that do not count."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from llm import line_dedup, shared

LINES = [(k, f"one line of {k % 7} words that others have too\nand a line of its own {k} {k * k} {k**3} here") for k in range(40)]


def started(spark, folder, run):
    """The names of the programs that the JVM, which is also the executor here, starts while run() works."""
    jvm = spark.sparkContext._jvm
    log, path = jvm.jdk.jfr.Recording(), jvm.java.io.File(f"{folder}/events.jfr").toPath()
    log.enable("jdk.ProcessStart")
    log.start()
    try:
        run()
    finally:
        log.stop()
    log.dump(path)
    return [os.path.basename(e.getString("command").split()[0]) for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(path)]


def test_line_dedup_starts_no_process_for_its_tables(spark, tmp_path):
    docs = spark.createDataFrame(LINES, "doc_id long, text string")
    found = []
    assert "chmod" not in started(spark, tmp_path, lambda: found.append(line_dedup.repeated_lines(docs)))
    got = {tuple(r) for r in found[0].collect()}
    assert got >= {(k, 0) for k in range(7, 40)} and not got & {(k, 0) for k in range(7)}


@pytest.mark.parametrize("group", [1, 1 << 20])
def test_tables_written_by_workers_hold_all_rows(spark, monkeypatch, group):
    monkeypatch.setattr(shared, "ROW_GROUP_BYTES", group)
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string").cast("binary")).alias("b"), F.struct((F.col("id") % 2 == 0).alias("x"), F.lit(None).cast("int").alias("y")).alias("s"), F.array("id", F.lit(None).cast("long")).alias("a"))
    table = shared.saved_in_python(rows)
    assert table.schema.simpleString() == rows.schema.simpleString() and sorted(table.collect()) == sorted(rows.collect())
    assert shared.saved_in_python(rows.filter("id < 0")).collect() == []
    shared.discard(table)


def test_tables_leave_out_what_failed_tasks_wrote(spark):
    folder = shared.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))

    def fail(batches):
        yield from batches
        raise ValueError("after all rows")

    with pytest.raises(Exception, match="after all rows"):
        shared.saved_in_python(spark.range(10).mapInArrow(fail, "id long"))
    assert set(os.listdir(folder)) == before
