"""Hourly grids and last observation carried forward."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions.times import ago, as_of_time, hour_floor


def grid_bounds(as_of: datetime | str | None, window: str) -> tuple[Column, Column]:
    """First and last hour of the grid, both part of it."""
    return hour_floor(ago(as_of, window)), hour_floor(as_of_time(as_of))


def hour_grid(
    df: DataFrame, as_of: datetime | str | None, window: str, name: str = "obs_dt"
) -> DataFrame:
    """Every row of ``df`` once per hour of the window (no join needed)."""
    first, last = grid_bounds(as_of, window)
    hours = F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))
    return df.withColumn(name, F.explode(hours))


def hold_until_next(
    known: DataFrame, key: str, hour: str, last: Column
) -> DataFrame:
    """Rows for the empty hours after each known hour, up to ``last``.

    ``known`` has one row per (key, hour); a key therefore never has more rows
    than the grid has hours, which bounds the window.
    """
    one = F.expr("INTERVAL 1 HOUR")
    order = Window.partitionBy(key).orderBy(hour)
    until = F.coalesce(F.lead(hour).over(order) - one, last)
    gap = known.withColumns({"_from": F.col(hour) + one, "_until": until})
    return (
        gap.where(F.col("_from") <= F.col("_until"))
        .withColumn(hour, F.explode(F.sequence("_from", "_until", one)))
        .drop("_from", "_until")
    )


def newer(earlier: Column, later: Column) -> Column:
    """One step of carrying forward: the later value unless it is missing."""
    return F.coalesce(later, earlier)


def last_value(value: str, order: str) -> Column:
    """Aggregate: the non-NULL value that comes last by ``order``.

    A fold with map-side combine, independent of the order rows arrive in.
    """
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def last_known(value: Column | str, key: str, hour: str) -> Column:
    """Last non-NULL value at or before the hour (as a window expression)."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(hour))
