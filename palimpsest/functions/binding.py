"""Binding a value once within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row.

    Lambdas of higher-order functions are interpreted, and what they close over is evaluated anew for each element; a
    lambda's own variable is not.
    """
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))
