"""Occupancy kept as a table by date, refreshed by replacing the dates that changed.

Each refresh condenses the bed events to one row for each date and ward: how many there are, sums of their
hashes, and the occupancy after the date's last event.  A date whose rows of this kind are as they were has
the same result, so it is left alone.  Only the events of other dates are ordered, summed and written,
each date with the occupancy that follows it; their folders are replaced one by one.

``occupancy_raw`` counts from now backwards, so it changes in all of a ward's rows with each new event.
It isn't stored: it is what is in use now minus the occupancy.

Layout below a path: ``events/day=...``; and for each refresh ``days/run=...`` (the condensed rows),
``wards/run=...`` (beds in use then) and ``runs/run=...`` (as-of time, dates replaced).  ``runs`` is written last: a refresh
that breaks off leaves the one before as the last, whose dates the next one compares with again.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, Window

from wardflow.operators.intervals import interval_events
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.occupied import occupied_now
from wardflow.operators.prefix import with_running_totals
from wardflow.plans.occupancy import bed_stays
from wardflow.sources.ehr import EhrTables
from wardflow.sources.scratch import written

#: The folder of events whose time is open.
OPEN = "open"
EVENT = "hospital_visit_id LONG, location_visit_id LONG, location_string STRING, ward_lag1 STRING, ward STRING, event STRING, census INT, ts TIMESTAMP_NTZ"
DAY = "day STRING, ward STRING, n LONG, low LONG, high LONG, after LONG"
RUN = "run LONG, as_of STRING, days_replaced LONG, days LONG"


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: its number, and how many of the dates it replaced."""

    run: int
    days_replaced: int
    days: int


def _folder(path: str, name: str, run: int | None = None) -> str:
    return f"{path.rstrip('/')}/{name}" + ("" if run is None else f"/run={run}")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """``run, as_of, days_replaced, days`` of all refreshes: how stale the table is, and what each one cost."""
    return spark.read.schema(RUN).option("ignoreMissingFiles", "true").parquet(_folder(path, "runs"))


def _last_run(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(path, "runs"))
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return 0
    return runs(spark, path).agg(F.max("run")).first()[0] or 0


def _events(t: EhrTables, stays: DataFrame) -> DataFrame:
    moved = with_neighbours(stays, "hospital_visit_id", "bed_in", "location_visit_id", {"ward_lag1": ("ward", 1)})
    names = [column.split()[0] for column in EVENT.split(", ")]
    events = interval_events(moved, ["hospital_visit_id", "location_visit_id", "location_string", "ward_lag1", "ward"])
    return events.select(*names, F.coalesce(F.to_date("ts").cast("string"), F.lit(OPEN)).alias("day"))


def _condensed(events: DataFrame, anchors: DataFrame) -> DataFrame:
    """``DAY``: of each date and ward, with the occupancy after its last event; wards without an anchor have none."""
    everything = F.xxhash64(*[c for c in events.columns if c != "day"])
    by_day = events.groupBy("day", "ward").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(everything.bitwiseAND(0xFFFFFFFF)).alias("low"),
        F.sum(F.shiftright(everything, 32)).alias("high"),
        F.sum("census").alias("net"),
    )
    # an open time is later than all others; the window has a row for each date of a ward
    later = Window.partitionBy("ward").orderBy((F.col("day") == OPEN).desc(), F.col("day").desc())
    since = F.sum("net").over(later.rowsBetween(Window.unboundedPreceding, -1))
    return by_day.withColumn("since", F.coalesce(since, F.lit(0))).join(anchors, "ward").select(
        "day", "ward", "n", "low", "high", (F.col("occupied") - F.col("since")).cast("long").alias("after")
    )


def _changed(before: DataFrame, now: DataFrame) -> DataFrame:
    """The dates whose condensed rows differ, in any ward."""
    both = before.withColumn("side", F.lit(-1)).unionByName(now.withColumn("side", F.lit(1)))
    unlike = both.groupBy("day", "ward", "n", "low", "high", "after").agg(F.sum("side").alias("s")).where("s <> 0")
    return unlike.select("day").distinct()


def refresh_occupancy(t: EhrTables, path: str, as_of: datetime | str) -> Refresh:
    """Bring the table at ``path`` to the state of ``t``; the first refresh builds it."""
    spark, last = t.spark, _last_run(t.spark, path)
    run = last + 1
    stays = bed_stays(t)
    events = written(_events(t, stays), "events")
    anchors = occupied_now(stays, "ward", "location_string", "occupied")
    anchors.write.mode("overwrite").parquet(_folder(path, "wards", run))
    anchors = spark.read.schema("ward STRING, occupied LONG").parquet(_folder(path, "wards", run))
    _condensed(events, anchors).write.mode("overwrite").parquet(_folder(path, "days", run))
    now = spark.read.schema(DAY).parquet(_folder(path, "days", run))
    before = spark.read.schema(DAY).parquet(_folder(path, "days", last)) if last else now.limit(0)
    changed = written(_changed(before, now), "changed")
    # of dates that are gone nothing is written; readers pass their folders over
    concerned = events.join(changed, "day", "left_semi").join(now.select("day", "ward", "after"), ["day", "ward"])
    concerned = concerned.withColumn("ward_day", F.struct("ward", "day"))
    summed = with_running_totals(concerned, concerned, "ts", "census", {"in_day": "ward_day"})
    names = [column.split()[0] for column in EVENT.split(", ")]
    found = summed.select(*names, (F.col("after") - F.col("in_day")).alias("occupancy"), "day")
    writer = found.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("day").parquet(_folder(path, "events"))
    done = Refresh(run, changed.count(), now.select("day").distinct().count())
    row = [(run, str(as_of), done.days_replaced, done.days)]
    spark.createDataFrame(row, RUN).write.mode("overwrite").parquet(_folder(path, "runs", run))
    return done


def read_occupancy(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the occupancy pipeline as of the last refresh."""
    run = _last_run(spark, path)
    days = spark.read.schema(DAY).parquet(_folder(path, "days", run)).select("day").distinct()
    wards = spark.read.schema("ward STRING, occupied LONG").parquet(_folder(path, "wards", run))
    events = spark.read.schema(f"{EVENT}, occupancy LONG, day STRING").parquet(_folder(path, "events"))
    return events.join(days, "day", "left_semi").join(wards, "ward").select(
        "hospital_visit_id",
        "location_visit_id",
        "location_string",
        "ward_lag1",
        "ward",
        "event",
        "census",
        "ts",
        (F.col("occupied") - F.col("occupancy")).alias("occupancy_raw"),
        "occupancy",
    )
