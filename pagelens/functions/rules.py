"""Helpers for first-match rules and exclusive quantiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def first_match(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """CASE over rules in order: the value of the first condition that holds; a null condition doesn't hold."""
    out = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def exclusive_quantile(ordered: Column, i: int, q: int) -> Column:
    """The i-th of q cut points of an ascending array by the exclusive method; arrays of two values or more.

    With n values, position i*(n+1)/q counts from 1 and is interpolated; it is held within the first and
    last pair. Null for fewer than two values.
    """
    n = F.size(ordered)
    at = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(i) * (n + 1) / F.lit(q)).cast("int")))
    rest = F.lit(i) * (n + 1) - at * F.lit(q)
    a, b = F.get(ordered, at - 1), F.get(ordered, at)
    return F.when(n >= 2, (a * (F.lit(q) - rest) + b * rest) / F.lit(q))
