"""Hourly oxygen demand per bed."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.oxygen import device_flow, oxygen_demand
from wardflow.functions.text import capture, capture_int, part
from wardflow.functions.times import ago, hour_floor, later_than
from wardflow.operators.asof import asof_join
from wardflow.operators.locf import grid_bounds, hold_until_next
from wardflow.operators.observations import pivot_observations
from wardflow.sources.ehr import EhrTables

AsOf = datetime | str | None

READINGS = {
    "o2_lmin": (fixed.O2_FLOW_TYPE, "value_as_real"),
    "o2_fi": (fixed.O2_FRACTION_TYPE, "value_as_real"),
    "o2_device": (fixed.O2_DEVICE_TYPE, "value_as_text"),
}
# the demand needs the rate of the device only: a number keeps the fold hashed and small
RATES = {**READINGS, "o2_device": (fixed.O2_DEVICE_TYPE, "device_flow")}


def oxygen_observations(t: EhrTables, as_of: AsOf, window: str) -> DataFrame:
    """Flow, fraction and device observations of the window."""
    kinds = [kind for kind, _ in READINGS.values()]
    recent = later_than(t.visit_observation, "observation_datetime", ago(as_of, window))
    return recent.where(F.col("visit_observation_type_id").isin(kinds))


def located_readings(t: EhrTables, observations: DataFrame) -> DataFrame:
    """One row per visit and instant with the location of the bed stay it falls into."""
    rated = observations.withColumn("device_flow", device_flow(F.col("value_as_text")))
    readings = pivot_observations(rated, RATES)
    visits = observations.select("hospital_visit_id").distinct()
    stays = t.location_visit.select(
        "hospital_visit_id", "admission_time", "location_visit_id", "location_id"
    )
    # the history of patients without a reading is dropped before the merge
    concerned = stays.join(visits, "hospital_visit_id", "left_semi")
    return asof_join(
        readings,
        concerned.join(t.location, "location_id"),
        "hospital_visit_id",
        "observation_datetime",
        "admission_time",
        "location_visit_id",
        ["location_string"],
    )


def hourly_demand(t: EhrTables, as_of: AsOf, window: str) -> DataFrame:
    """Mean demand per visit, bed and hour in the wards of interest."""
    ward_prefix = capture(part(F.col("location_string"), 1), fixed.WARD_PREFIX_PATTERN)
    demand = oxygen_demand(F.col("o2_lmin"), F.col("o2_fi"), F.col("o2_device"))
    return (
        located_readings(t, oxygen_observations(t, as_of, window))
        .where(ward_prefix.isin(fixed.O2_WARD_PREFIXES))
        .groupBy(
            "hospital_visit_id",
            "location_string",
            hour_floor(F.col("observation_datetime")).alias("obs_dt"),
        )
        .agg(F.avg(demand).alias("o2_demand"))
    )


def oxygen(t: EhrTables, as_of: AsOf = None, window: str = "7 DAYS") -> DataFrame:
    """Demand per bed for every hour from its first reading on, gaps filled.

    Of several patients in one bed-hour each keeps a row with the own demand;
    the value carried forward is the one of the highest visit id.
    """
    first, last = grid_bounds(as_of, window)
    # with this filter both uses below have the same plan and share one shuffle
    demand = hourly_demand(t, as_of, window).where(
        F.col("location_string").isNotNull() & F.col("obs_dt").between(first, last)
    )
    known = demand.groupBy("location_string", "obs_dt").agg(
        F.max_by("o2_demand", "hospital_visit_id").alias("o2_locf")
    )
    measured = demand.join(known, ["location_string", "obs_dt"])
    filled = hold_until_next(known, "location_string", "obs_dt", last)
    hours = measured.drop("hospital_visit_id").unionByName(filled, allowMissingColumns=True)
    ward = part(F.col("location_string"), 1)
    return hours.select(
        "location_string",
        "obs_dt",
        "o2_demand",
        "o2_locf",
        ward.alias("ward"),
        capture_int(ward, fixed.FLOOR_INDEX_PATTERN).alias("floor_index"),
        capture_int(F.col("location_string"), fixed.BED_INDEX_PATTERN).alias("bed_index"),
    )
