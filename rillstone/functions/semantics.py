"""Python's scalar and list semantics as Spark columns.

Spark's ``div`` and ``%`` truncate, its ``sequence`` counts down, its indices raise or start at one; these helpers give what a Python
program would compute, and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(b: Column) -> Column:
    """A truth value as the number it equals."""
    return b.cast("long")


def floor_div(a: Column, b: Column) -> Column:
    """``a // b`` of integers: rounds down.  A zero divisor raises, as does an overflow."""
    off = (a % b != 0) & ((a % b < 0) != (b < 0))
    # without the remainder the quotient is exact, so dividing decimals loses nothing
    quotient = ((a - a % b).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("long")
    return quotient - off.cast("long")


def modulo(a: Column, b: Column) -> Column:
    """``a % b``: the sign follows the divisor."""
    r = a % b
    return r + F.when((r != 0) & ((r < 0) != (b < 0)), b).otherwise(F.lit(0))


def true_div(a: Column, b: Column) -> Column:
    """``a / b`` as a double; a zero divisor raises."""
    return a.cast("double") / b.cast("double")


def truthy_number(x: Column) -> Column:
    return x.isNotNull() & (x != 0)


def truthy_text(x: Column) -> Column:
    return x.isNotNull() & (F.length(x) > 0)


def truthy_list(x: Column) -> Column:
    return x.isNotNull() & (F.size(x) > 0)


def between_chain(low: Column, x: Column, high: Column) -> Column:
    """``low <= x < high``, false where NaN takes part."""
    return (low <= x) & (x < high) & ~F.isnan(x.cast("double"))


def int_range(start: Column, stop: Column, step: int = 1) -> Column:
    """``range(start, stop, step)`` as an array; empty where no value is in reach."""
    if step == 0:
        raise ValueError("step must not be zero")
    some = start < stop if step > 0 else start > stop
    last = stop - (1 if step > 0 else -1)
    return F.when(some, F.sequence(start, F.when(some, last).otherwise(start), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def item(a: Column, index: int) -> Column:
    """``a[index]``: counts from 0, or from the end if negative; raises out of bounds."""
    return F.element_at(a, index + 1 if index >= 0 else index)


def star_unpack(a: Column, before: int, after: int) -> tuple[list[Column], Column, list[Column]]:
    """``x, y, *rest, z = a``."""
    rest = F.slice(a, before + 1, F.size(a) - before - after)
    return [item(a, k) for k in range(before)], rest, [item(a, k - after) for k in range(after)]


def list_sum(a: Column, zero: str = "bigint") -> Column:
    """``sum`` of an array; 0 if empty."""
    return F.aggregate(a, F.lit(0).cast(zero), lambda t, x: t + x.cast(zero))


def column_sum(x: Column) -> Column:
    """``sum`` of a column; 0 without rows."""
    return F.coalesce(F.sum(x), F.lit(0).cast("long"))


def last_wins(keys: Column, values: Column) -> Column:
    """A dict from lists of keys and values; of equal keys the last one's value stays, in the place of the first."""
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    unique = F.array_distinct(keys)
    return F.map_from_arrays(unique, F.transform(unique, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def fenced(value: Column, holds: Column, message: str) -> Column:
    """value, once the condition holds; where it does not the job ends, so nothing that depends on the value runs."""
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))
