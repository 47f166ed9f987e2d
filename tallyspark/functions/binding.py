"""Naming an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it.

    Without it a value that a lambda names is computed anew for each element, and one that
    stands in several branches is copied into each.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
