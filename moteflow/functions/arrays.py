"""Medians and lines over short arrays inside a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once. A column that is used inside a lambda is otherwise
    inlined there by the optimizer and evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def array_median(a: Column) -> Column:
    """Median of a numeric array without NULLs; NULL when empty."""
    def mid(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return let(F.array_sort(a), mid)


def array_mean(a: Column) -> Column:
    return let(a, lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def theil_sen(points: Column) -> Column:
    """Median slope over all pairs of an array of structs (t, v); meant for a handful of points."""
    i = F.sequence(F.lit(0), F.size(points) - 1)
    pairs = F.flatten(F.transform(i, lambda k: F.transform(
        F.filter(points, lambda p: p["t"] > F.get(points, k)["t"]),
        lambda p: (p["v"] - F.get(points, k)["v"]) / (p["t"] - F.get(points, k)["t"]))))
    return array_median(pairs)
