"""Evaluating an expression once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row.

    A column named inside the function of a higher-order function is evaluated
    for every element; bound this way it is a variable there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
