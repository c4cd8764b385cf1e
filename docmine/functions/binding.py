"""Evaluate an expression once where a lambda needs it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda's outer expressions are
    evaluated for every element, a lambda variable is not."""
    return F.transform(F.array(value), lambda v: body(v))[0]
