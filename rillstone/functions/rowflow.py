"""Bounded local loops of a row as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .semantics import int_range


def fold_range(stop: Column, start: Column, step: Callable[[Column, Column], Column], first: Column | None = None) -> Column:
    """``acc = start; for i in range(first, stop): acc = step(acc, i)``."""
    return F.aggregate(int_range(F.lit(0).cast("long") if first is None else first, stop), start, step)


def first_where(values: Column, test: Callable[[Column], Column]) -> Column:
    """The value at which ``for v in values: if test(v): break`` stops; null if it never does."""
    return F.get(F.filter(values, test), 0)


def no_break(values: Column, test: Callable[[Column], Column]) -> Column:
    """Whether the loop's ``else`` runs: no value meets the test."""
    return ~F.exists(values, test)


def skip_where(values: Column, test: Callable[[Column], Column]) -> Column:
    """Values left by ``if test(v): continue``."""
    return F.filter(values, lambda v: ~test(v))


def appended(values: Column, make: Callable[[Column], Column]) -> Column:
    """``out = []; for v in values: out.append(make(v))``."""
    return F.transform(values, make)


def is_prime(k: Column) -> Column:
    """Trial division up to the square root, with the loop's break and else, by 2, 3 and the neighbours of multiples of 6."""
    root = F.floor(F.sqrt(F.greatest(k, F.lit(0)).cast("double"))).cast("long")
    divides = lambda d: (d * d <= k) & (k % d == 0)
    wheel = no_break(int_range(F.lit(5).cast("long"), root + 2, 6), lambda d: divides(d) | divides(d + 2))
    return (k >= 2) & ~divides(F.lit(2).cast("long")) & ~divides(F.lit(3).cast("long")) & wheel


def collatz_steps(spark: SparkSession, numbers: DataFrame, column: str) -> DataFrame:
    """``while n != 1`` in SQL: one recursion level for each step, so for loops of at most some hundred steps."""
    return spark.sql(
        f"""WITH RECURSIVE walk(start, n, steps) MAX RECURSION LEVEL 2000 AS (
              SELECT CAST({column} AS BIGINT), CAST({column} AS BIGINT), CAST(0 AS BIGINT) FROM {{numbers}} WHERE {column} >= 1
              UNION ALL
              SELECT start, CASE WHEN n % 2 = 0 THEN CAST(shiftright(n, 1) AS BIGINT) ELSE 3 * n + 1 END, steps + 1 FROM walk WHERE n <> 1)
            SELECT start, max(steps) AS steps FROM walk GROUP BY start""",
        numbers=numbers,
    )


def quadrature(spark: SparkSession, slices: int, steps: int, f: Callable[[Column], Column]) -> DataFrame:
    """Midpoint rule over [0, 1] in slices: (slice, area) of each.  The points are a range over all tasks, summed by slice on the map side."""
    h = 1.0 / (slices * steps)
    points = spark.range(0, slices * steps)
    x = (F.col("id") + 0.5) * h
    return points.groupBy(F.expr(f"id div {steps}").alias("slice")).agg((F.sum(f(x)) * h).alias("area"))
