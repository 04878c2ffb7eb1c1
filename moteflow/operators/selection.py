"""Selections as sets of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame


def change_selection(current: DataFrame, ids: DataFrame, op: str) -> DataFrame:
    """replace / add / remove / toggle / invert; for invert ``ids`` is everything selectable."""
    if op == "replace":
        return ids.distinct()
    if op == "add":
        return current.unionByName(ids).distinct()
    if op == "remove":
        return current.subtract(ids)
    if op == "toggle":
        return current.subtract(ids).unionByName(ids.subtract(current))
    if op == "invert":
        return ids.subtract(current)
    raise ValueError(f"unknown selection change {op!r}")
