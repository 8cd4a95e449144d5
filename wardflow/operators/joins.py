"""Joins that Spark has no word for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str
) -> DataFrame:
    """Equi-join in which NULL keys meet; the left copy of the keys is kept."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same: Column = reduce(
        Column.__and__, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
