"""One query per operator, over whole tables."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.locations import CRITICAL_CARE_CENSUS
from wardflow.functions.text import capture, capture_int, part
from wardflow.functions.times import age_years, hour_floor, out_of_hours
from wardflow.operators.asof import asof_join
from wardflow.operators.identity import identities_of, with_mrns
from wardflow.operators.intervals import flags_to_long, interval_events
from wardflow.operators.locf import hour_grid, last_known, last_value, newer
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.observations import pivot_observations
from wardflow.operators.occupied import occupied_now
from wardflow.operators.prefix import running_total
from wardflow.plans import census, cohorts, occupancy
from wardflow.plans.catalog import create_views, drop_views
from wardflow.plans.oxygen import READINGS, hourly_demand
from wardflow.plans.snapshots import read_snapshot, write_snapshot
from wardflow.sources.ehr import EhrTables
from wardflow.sources.scratch import scratch_folder
from wardflow.streaming.bed_flow import bed_moves, hourly_flow

AsOf = datetime | str | None


def asof_location(t: EhrTables) -> DataFrame:
    """Every observation with the bed its patient was in."""
    observations = t.visit_observation.select(
        "visit_observation_id", "hospital_visit_id", "observation_datetime"
    )
    stays = t.location_visit.join(t.location, "location_id")
    return asof_join(
        observations,
        stays,
        "hospital_visit_id",
        "observation_datetime",
        "admission_time",
        "location_visit_id",
        ["location_visit_id", "location_string"],
    )


def latest_stay(t: EhrTables) -> DataFrame:
    """The last bed stay of every visit.

    A fold with map-side combine.  Structs are no hash buffers, so it sorts by visit on both sides
    of the shuffle; only narrow columns take part.
    """
    newest = F.max(F.struct("admission_time", "location_visit_id", "location_id"))
    return (
        t.location_visit.where(F.col("admission_time").isNotNull())
        .groupBy("hospital_visit_id")
        .agg(newest.alias("stay"))
        .select("hospital_visit_id", "stay.*")
    )


def _ward_stays(t: EhrTables) -> DataFrame:
    return occupancy.bed_stays(t)


def running_census(t: EhrTables) -> DataFrame:
    """Ward and instant with the running sum of bed moves, newest first."""
    moves = interval_events(_ward_stays(t), ["ward"])
    return running_total(moves, "ward", "ts", F.col("census"))


def occupied_wards(t: EhrTables) -> DataFrame:
    return occupied_now(_ward_stays(t), "ward", "location_string", "n")


def ward_hour_flow(t: EhrTables) -> DataFrame:
    """Arrivals and departures per ward and hour (the batch form of the stream)."""
    wards = t.location.select("location_id", part(F.col("location_string"), 1).alias("ward"))
    return hourly_flow(bed_moves(t.location_visit, wards))


def snapshot(t: EhrTables) -> DataFrame:
    """Occupancy written as a snapshot and read back."""
    df = occupancy.occupancy(t)
    path = f"{scratch_folder(t.spark)}/snapshots/{uuid4().hex}"
    write_snapshot(df, path)
    return read_snapshot(t.spark, path, df.schema)


def unpivot_intervals(t: EhrTables) -> DataFrame:
    stays = t.location_visit.select(
        "location_visit_id",
        F.col("admission_time").alias("bed_in"),
        F.col("discharge_time").alias("bed_dc"),
    )
    return interval_events(stays, ["location_visit_id"])


def unpivot_targets(t: EhrTables) -> DataFrame:
    return flags_to_long(t.all_targets, ["csn"], fixed.TARGETS, "target_name", "target_value")


def lag_lead(t: EhrTables) -> DataFrame:
    """Bed stays with the places one and two moves away."""
    stays = t.location_visit.select(
        "location_visit_id", "hospital_visit_id", "location_id", "admission_time"
    )
    shifted = with_neighbours(
        stays,
        "hospital_visit_id",
        "admission_time",
        "location_visit_id",
        {
            "lag1": ("location_id", 1),
            "lead1": ("location_id", -1),
            "lag2": ("location_id", 2),
            "lead2": ("location_id", -2),
        },
    )
    back_again = F.coalesce(F.col("lag2") == F.col("location_id"), F.lit(False))
    return shifted.withColumn("round_trip", back_again)


def death_rank(t: EhrTables, as_of: AsOf) -> DataFrame:
    """The bed stay that ranks first by distance to death, per patient number."""
    cohort = census.inpatients(t, as_of, "12 MONTHS")
    stays = census.census_stays(t, CRITICAL_CARE_CENSUS)
    return census.death_stays(census.of_cohort(stays, cohort))


def resolve_live_mrn(t: EhrTables) -> DataFrame:
    visits = t.hospital_visit.select("hospital_visit_id", "mrn_id")
    return with_mrns(visits, t.mrn, t.mrn_to_live).select(
        "hospital_visit_id", "original_mrn", "live_mrn"
    )


def distinct_visits(t: EhrTables) -> DataFrame:
    return cohorts.niv_visits(t)


def pivot_obs(t: EhrTables) -> DataFrame:
    kinds = [kind for kind, _ in READINGS.values()]
    readings = t.visit_observation.where(F.col("visit_observation_type_id").isin(kinds))
    return pivot_observations(readings, READINGS)


def avg_hourly(t: EhrTables) -> DataFrame:
    """Mean value per visit, observation type and hour."""
    return t.visit_observation.groupBy(
        "hospital_visit_id",
        "visit_observation_type_id",
        hour_floor(F.col("observation_datetime")).alias("hour"),
    ).agg(F.round(F.avg("value_as_real"), 6).alias("mean_value"))


def grid(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Every place a patient has been in, for every hour of the week."""
    places = t.location_visit.select("location_id").distinct().join(t.location, "location_id")
    return hour_grid(places.select("location_string").distinct(), as_of, "7 DAYS")


def locf(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Highest demand per bed-hour on the grid, gaps filled with the last one."""
    demand = (
        hourly_demand(t, as_of, "7 DAYS")
        .groupBy("location_string", "obs_dt")
        .agg(F.round(F.max("o2_demand"), 6).alias("o2_demand"))
    )
    places = demand.select("location_string").distinct()
    sparse = hour_grid(places, as_of, "7 DAYS").join(
        demand, ["location_string", "obs_dt"], "left"
    )
    return sparse.withColumn("o2_locf", last_known("o2_demand", "location_string", "obs_dt"))


def locf_aggregate(t: EhrTables) -> DataFrame:
    """Last number and last text per visit, and the number with 0 if there is none."""
    order = F.struct("observation_datetime", "visit_observation_id")
    last = t.visit_observation.withColumn("order", order).groupBy("hospital_visit_id").agg(
        last_value("value_as_real", "order").alias("last_real"),
        last_value("value_as_text", "order").alias("last_text"),
    )
    return last.withColumn("real_or_zero", newer(F.lit(0.0), F.col("last_real")))


def regex_capture(t: EhrTables) -> DataFrame:
    place = F.col("location_string")
    return t.location.select(
        "location_id",
        capture(part(place, 1), fixed.WARD_PREFIX_PATTERN).alias("ward_prefix"),
        capture_int(part(place, 1), fixed.FLOOR_INDEX_PATTERN).alias("floor_index"),
        capture_int(place, fixed.BED_INDEX_PATTERN).alias("bed_index"),
    )


def ages(t: EhrTables, as_of: AsOf) -> DataFrame:
    return t.core_demographic.select(
        "core_demographic_id", age_years(F.col("date_of_birth"), as_of).alias("age")
    )


def night_observations(t: EhrTables) -> DataFrame:
    return t.visit_observation.select(
        "visit_observation_id",
        out_of_hours(F.col("observation_datetime")).alias("out_of_hours"),
    )


def row_counts(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Size of the critical-care census."""
    return census.census_cc(t, as_of).agg(F.count("*").alias("n"))


def row_counts_plus(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Size of the general census."""
    return census.census_plus(t, as_of).agg(F.count("*").alias("n"))


def view_stack(t: EhrTables) -> DataFrame:
    """The critical-care list by way of views: ``location`` is created, replaced and read by name.

    The views are dropped at the end; a DataFrame made from a view outlives it.
    """
    prefix = f"stack_{uuid4().hex}_"
    made = [f"{prefix}location"]
    try:
        for _ in range(2):
            create_views(t, names=["location"], prefix=prefix)
        beds = t.spark.table(made[0]).where(F.col("critical_care")).select("location_id")
        visits = t.location_visit.join(beds, "location_id").select("hospital_visit_id")
        visits.distinct().createTempView(f"{prefix}visits")
        made.append(f"{prefix}visits")
        return identities_of(t.spark.table(made[1]), t)
    finally:
        drop_views(t.spark, [*made, f"{prefix}never_made"])


def newest_rows(t: EhrTables, n: int = 3) -> DataFrame:
    """A peek at the newest observations (top-k, never a full sort)."""
    return (
        t.visit_observation.select("visit_observation_id", "observation_datetime")
        .orderBy(F.desc_nulls_first("observation_datetime"), "visit_observation_id")
        .limit(n)
    )
