"""Overlap of arrays that hold no element twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return ratio(common(a, b), F.size(a) + F.size(b) - common(a, b))


def overlap(a: Column, b: Column) -> Column:
    return ratio(common(a, b), F.least(F.size(a), F.size(b)))


def dice(a: Column, b: Column) -> Column:
    return ratio(2 * common(a, b), F.size(a) + F.size(b))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")
