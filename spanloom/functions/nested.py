"""Helpers for expressions over nested columns: a line with its spans, a block with its lines.

A parameter that a helper names more than once is to be a column or a variable (of ``let`` or a lambda), not an expression.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` names it (a column would be put in the place of each)."""
    return F.transform(F.array(value), body)[0]


def indexes(array: Column) -> Column:
    """0 to size - 1; empty for an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def picked(array: Column, places: Column) -> Column:
    """Elements at 0-based ``places``."""
    return F.transform(places, lambda i: F.get(array, i))


def starts(array: Column, fresh: Callable[[Column, Column], Column]) -> Column:
    """Places where a run begins: 0, and each i for which ``fresh(element before, element)`` holds."""
    return F.filter(indexes(array), lambda i: (i == 0) | fresh(F.get(array, i - 1), F.get(array, i)))


def runs(array: Column, fresh: Callable[[Column, Column], Column]) -> Column:
    """``array``, any expression, cut into runs."""
    cut = lambda a: let(starts(a, fresh), lambda at: F.transform(at, lambda s, k: F.slice(a, s + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - s)))
    return let(array, cut)


def total(array: Column, value: Callable[[Column], Column]) -> Column:
    """Sum of ``value`` over ``array``, as a double."""
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + value(x))


def befores(array: Column, value: Callable[[Column], Column]) -> Column:
    """For each place, the sum of ``value`` over the elements before it."""
    return F.transform(array, lambda _, i: total(F.slice(array, F.lit(1), i), value))


def least(array: Column, value: Callable[[Column], Column]) -> Column:
    return F.array_min(F.transform(array, value))


def most(array: Column, value: Callable[[Column], Column]) -> Column:
    return F.array_max(F.transform(array, value))


def once(f: Callable[[], Column]) -> Callable[[], Column]:
    """``f``, whose result names columns only, made once a Spark application: a long expression takes thousands of calls to the JVM."""
    made: dict[int, Column] = {}

    @functools.wraps(f)
    def get() -> Column:
        sc = SparkContext._active_spark_context
        if sc is None:  # a remote session
            return f()
        got = made.get(id(sc))
        if got is None:  # two threads may both make it: either result serves
            got = f()
            made.clear()
            made[id(sc)] = got
        return got

    return get


def step(df: DataFrame, keep: tuple[str, ...], **made: Column) -> DataFrame:
    """``keep`` and new columns, each evaluated once: an array of one, exploded, is not put in the place of its name by the optimiser.

    It also keeps expressions shallow: the analyser takes a round for each lambda inside another.
    """
    one = F.explode(F.array(F.struct(*(c.alias(n) for n, c in made.items())))).alias("__made")
    return df.select(*keep, one).select(*keep, *(F.col(f"__made.{n}").alias(n) for n in made))
