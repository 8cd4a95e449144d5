"""Occupancy that is kept current: by refreshing dates, and by following a stream."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardflow.functions.text import part
from wardflow.functions.times import ago
from wardflow.plans.incremental import read_occupancy, refresh_occupancy
from wardflow.sources.ehr import EhrTables
from wardflow.sources.scratch import new_folder
from wardflow.streaming.bed_flow import bed_moves
from wardflow.streaming.occupancy_stream import MOVE, current_occupancy, start_occupancy

AsOf = datetime | str | None


def known_at(t: EhrTables, as_of: AsOf, window: str) -> EhrTables:
    """The tables as they stood some time before: later bed stays aren't there, later discharges are open."""
    then = ago(as_of, window)
    stays = t.location_visit.where(F.col("admission_time").isNull() | (F.col("admission_time") <= then))
    stays = stays.withColumn("discharge_time", F.when(F.col("discharge_time") <= then, F.col("discharge_time")))
    return EhrTables(t.spark, lambda name: stays if name == "location_visit" else t.read(name))


def occupancy_by_date(t: EhrTables, as_of: AsOf, window: str = "2 DAYS") -> DataFrame:
    """The table by date, built as of some days before and then refreshed, read back."""
    path = new_folder(t.spark, "occupancy")
    refresh_occupancy(known_at(t, as_of, window), path, f"{as_of} - {window}")
    refresh_occupancy(t, path, as_of)
    return read_occupancy(t.spark, path)


def followed_occupancy(t: EhrTables, late: str = "2 HOURS") -> DataFrame:
    """All bed moves as a stream of two batches; those of every seventh place come a batch late.

    Instants of each ward with the occupancy before them, late moves put right.
    """
    spark, folder = t.spark, new_folder(t.spark, "followed")
    wards = t.location.select("location_id", part(F.col("location_string"), 1).alias("ward"))
    of_late_place = F.coalesce(F.col("location_id") % 7 == 0, F.lit(False))
    nobody = spark.createDataFrame([], "ward string, occupied long")
    for batch, stays in enumerate((t.location_visit.where(~of_late_place), t.location_visit.where(of_late_place))):
        bed_moves(stays, wards).select("ward", "ts", "census").write.mode("append").parquet(f"{folder}/moves")
        # the stream takes what has arrived since it last ran
        stream = spark.readStream.schema(MOVE).parquet(f"{folder}/moves")
        start_occupancy(stream, nobody, f"{folder}/state", f"{folder}/checkpoint", late).awaitTermination()
    return current_occupancy(spark, f"{folder}/state", batch)
