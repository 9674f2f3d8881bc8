"""Binding of intermediate values, so that a nested expression is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value of ``value``, which is evaluated once however often the body uses it."""
    return F.transform(F.array(value), body)[0]
