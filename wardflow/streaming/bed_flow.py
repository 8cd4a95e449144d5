"""Bed moves per ward and hour, from a table or from a stream of moves.

The pipelines are batch and are rebuilt for a new as-of time.  This is the part of
the ward census that can also be kept up to date while moves arrive: its hourly
changes add up to the running sums of the batch census.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardflow.operators.intervals import interval_events


def bed_moves(stays: DataFrame, locations: DataFrame) -> DataFrame:
    """(ward, ts, census) of begun and ended bed stays; ``stays`` may be a stream.

    ``locations`` has ``location_id`` and ``ward``.
    """
    ends = stays.select(
        "location_id",
        F.col("admission_time").alias("bed_in"),
        F.col("discharge_time").alias("bed_dc"),
    ).join(locations.select("location_id", "ward"), "location_id")
    return interval_events(ends, ["ward"]).where(F.col("ts").isNotNull()).drop("event")


def hourly_flow(moves: DataFrame, late: str = "2 hours") -> DataFrame:
    """Arrivals, departures and net change per ward and hour.

    In a stream an hour is final once moves ``late`` after it have been seen; moves
    that arrive even later are dropped, so state is kept for open hours only.
    A watermark needs a time with a zone: run streams in a session set to UTC.
    """
    if moves.isStreaming:
        moves = moves.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    entered = F.when(F.col("census") == 1, 1).otherwise(0)
    return (
        moves.groupBy(F.window("ts", "1 hour").alias("hour"), "ward")
        .agg(
            F.sum(entered).alias("arrivals"),
            F.sum(1 - entered).alias("departures"),
            F.sum("census").alias("net_change"),
        )
        .withColumn("hour", F.col("hour.start").cast("timestamp_ntz"))
    )


def start_hourly_flow(
    moves: DataFrame, path: str, checkpoint: str, late: str = "2 hours"
) -> StreamingQuery:
    """Append final hours to parquet at ``path`` until the source has no more rows."""
    return (
        hourly_flow(moves, late)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
