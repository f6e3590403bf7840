"""The archive of runs: append once, load, keep the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import newest


def new_rows(archived: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to append: of each key not yet archived, one."""
    return incoming.join(archived.select(*keys), keys, "left_anti").dropDuplicates(keys)


def load_run(run: object, runs: DataFrame, tasks: DataFrame, attempts: DataFrame) -> DataFrame:
    """A run with its tasks and their attempts, those without any too."""
    one = runs.filter(F.col("run") == F.lit(run))
    return one.join(tasks, "run", "left").join(attempts, ["run", "task"], "left")


def kept_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The newest runs by time, then name."""
    return newest(runs, keep, [F.col("archived_at").desc(), F.col("run").asc()])


def pruned(child: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of a table of the archive that go when only the kept runs stay."""
    return child.join(kept.select("run"), "run", "left_anti")
