"""Binding of values inside an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once a row; named twice, it would be computed twice."""
    return F.element_at(F.transform(F.array(value), use), 1)
