"""Sparse entity-attribute-value observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pivot_observations(
    observations: DataFrame, columns: dict[str, tuple[int, str]]
) -> DataFrame:
    """One row per (visit, instant) with one column per observation type.

    ``columns`` maps the new column to (type, value column).  Of several
    readings of one type at one instant the one recorded last is taken.
    Conditional aggregates need a single shuffle and combine on the map side.
    """

    def reading(kind: int, value: str) -> Column:
        of_kind = F.col("visit_observation_type_id") == kind
        return F.max_by(value, F.when(of_kind, F.col("visit_observation_id")))

    return observations.groupBy("hospital_visit_id", "observation_datetime").agg(
        *[reading(*source).alias(name) for name, source in columns.items()]
    )
