"""Expressions over short walk arrays (signed segment ids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(walk: Column) -> Column:
    return F.transform(F.reverse(walk), lambda v: -v)


def min_rotation(walk: Column) -> Column:
    """Lexicographically smallest rotation (quadratic in the length: short arrays only)."""
    n = F.size(walk)
    twice = F.concat(walk, walk)
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.array_min(F.transform(starts, lambda k: F.slice(twice, k, n)))


def canonical_walk(walk: Column, circular: Column) -> Column:
    """Smallest member of the orbit under reverse complement, and rotation if circular."""
    rc = reverse_complement(walk)
    return F.when(circular, F.least(min_rotation(walk), min_rotation(rc))).otherwise(F.least(walk, rc))


def words(walk: Column, sep: str = "|") -> Column:
    return F.array_join(F.transform(walk, lambda v: v.cast("string")), sep)


def collapse_nulls(walk: Column) -> Column:
    """Drop a NULL that follows a NULL."""
    return F.filter(
        walk, lambda x, i: x.isNotNull() | (i == 0) | F.element_at(walk, F.greatest(i, F.lit(1))).isNotNull()
    )
