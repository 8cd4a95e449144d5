"""Who is in a bed now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def open_stay() -> Column:
    """The bed stay and the hospital stay around it have begun and not ended."""
    return (
        F.col("bed_in").isNotNull()
        & F.col("bed_dc").isNull()
        & F.col("hosp_in").isNotNull()
        & F.col("hosp_dc").isNull()
    )


def beds_in_use(stays: DataFrame, *columns: str) -> DataFrame:
    """The distinct places in use now; a bed shown twice (a ghost) counts once."""
    return stays.where(open_stay()).select(*columns).distinct()


def occupied_now(stays: DataFrame, group: str, counted: str, name: str) -> DataFrame:
    """Distinct beds in use per group; a bed shown twice (a ghost) counts once."""
    return (
        stays.where(open_stay()).groupBy(group).agg(F.countDistinct(counted).alias(name))
    )
