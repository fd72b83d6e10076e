"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once.

    A column used several times is copied into the plan each time, and steps that each use their
    input twice double the plan at every step.  A one-element array gives the value a name.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def explode_rows(df: DataFrame, array: Column, name: str, *keep: str) -> DataFrame:
    """One row per array element.

    A plain explode makes the optimizer add a filter on the array below it, and the array is
    then computed twice; the outer form with a filter above it does the same work once.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
