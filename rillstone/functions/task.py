"""User functions: ``@task`` marks a pure function of its arguments and runs it in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A scalar function as a column function: args in, value out, no state; the Python process serves whole batches."""

    def wrap(f: Callable) -> Callable[..., Column]:
        return F.udf(f, returns, useArrow=True)

    return wrap


def batch_task(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of whole columns as a column function: NumPy arrays in, one array out, one call for each Arrow batch."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def run(*columns: pa.Array) -> pa.Array:
            return pa.array(f(*(c.to_numpy(zero_copy_only=False) for c in columns)))

        # the argument's annotation tells that it takes Arrow arrays
        one = lambda c: run(c)
        one.__annotations__ = {"c": pa.Array, "return": pa.Array}
        return F.arrow_udf(one, returns)

    return wrap


def proved(native: Callable[..., Column], fallback: Callable[..., Column], kinds: tuple[str, ...]) -> Callable[..., Column]:
    """A function without a mark: a column expression where the columns' types are those that it is proved for, else a task.

    frame is the first argument of the result, columns' names the others.
    """

    def call(frame: DataFrame, *columns: str) -> Column:
        known = dict(frame.dtypes)
        args = [F.col(c) for c in columns]
        return native(*args) if all(known[c] in kinds for c in columns) else fallback(*args)

    return call


def checked_task(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """As task, but an exception is a value: struct(value, error_type, error_message)."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def run(*args):
            try:
                return {"value": f(*args), "error_type": None, "error_message": None}
            except Exception as e:  # a task's own exception is its result
                return {"value": None, "error_type": type(e).__name__, "error_message": str(e)}

        return F.udf(run, f"value {returns}, error_type string, error_message string", useArrow=True)

    return wrap


def in_context(frame: DataFrame, make: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A persistent context for each partition: state made once, then handed to every batch in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = make()
        for batch in batches:
            yield step(state, batch)

    return frame.mapInPandas(run, schema)
