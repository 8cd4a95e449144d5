"""Admission and discharge events of inpatients with ward and critical-care census."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.locations import (
    CRITICAL_CARE_CENSUS,
    GENERAL_CENSUS,
    ParserRules,
    parse_locations,
    transient,
)
from wardflow.functions.times import ago, out_of_hours
from wardflow.operators.intervals import BED_IN, BED_OUT, interval_events
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.occupied import beds_in_use
from wardflow.operators.prefix import with_running_totals
from wardflow.sources.ehr import EhrTables

AsOf = datetime | str | None

MOVES = {
    "cc_lag1": ("critical_care", 1),
    "cc_lead1": ("critical_care", -1),
    "ward_lag1": ("ward", 1),
    "ward_lead1": ("ward", -1),
    "transient_lag1": ("transient", 1),
    "transient_lead1": ("transient", -1),
    "location_lag2": ("location_id", 2),
    "location_lead2": ("location_id", -2),
}


def inpatients(t: EhrTables, as_of: AsOf, window: str) -> DataFrame:
    """Inpatient stays that are open or ended within the window, with the patient."""
    visits = t.hospital_visit.where(
        (F.col("patient_class") == fixed.INPATIENT_CLASS)
        & (F.col("source_system") == fixed.CENSUS_SOURCE_SYSTEM)
        & F.col("admission_time").isNotNull()
        & (F.col("discharge_time").isNull() | (F.col("discharge_time") > ago(as_of, window)))
    ).select(
        "hospital_visit_id",
        "mrn_id",
        "encounter",
        "patient_class",
        F.col("admission_time").alias("hosp_in"),
        F.col("discharge_time").alias("hosp_dc"),
    )
    person = t.core_demographic.select(
        "mrn_id", "core_demographic_id", "lastname", "firstname", "datetime_of_death"
    )
    return visits.join(person, "mrn_id").join(t.mrn.select("mrn_id", "mrn"), "mrn_id")


def census_stays(t: EhrTables, rules: ParserRules) -> DataFrame:
    """Bed stays in places that count for the census."""
    beds = parse_locations(t.location, rules).where(F.col("census")).drop("ward_raw", "census")
    return t.location_visit.select(
        "location_visit_id",
        "hospital_visit_id",
        "location_id",
        F.col("admission_time").alias("bed_in"),
        F.col("discharge_time").alias("bed_dc"),
    ).join(beds, "location_id")


def of_cohort(stays: DataFrame, cohort: DataFrame) -> DataFrame:
    """Bed stays of the cohort with its columns.

    A visit with very many stays, and a patient number shared by many visits, are skewed keys of
    plain joins, which adaptive execution splits.
    """
    return stays.join(cohort, "hospital_visit_id")


def death_stays(stays: DataFrame) -> DataFrame:
    """Per patient number the bed stay entered closest before death comes first.

    Stays entered after death (negative distance) count as closer; a stay
    without a time comes last.  One aggregate with map-side combine, so a
    number shared by many patients is no hot spot.
    """
    distance = F.col("datetime_of_death") - F.col("bed_in")
    rank = F.struct(
        distance.isNull().alias("unknown"),
        distance.alias("distance"),
        "location_visit_id",
        "core_demographic_id",
        "hospital_visit_id",
    )
    first = (
        stays.where(F.col("datetime_of_death").isNotNull())
        .groupBy("mrn")
        .agg(F.min(rank).alias("first"))
    )
    return first.select(
        "first.hospital_visit_id",
        "first.core_demographic_id",
        F.col("first.location_visit_id").alias("death_stay_id"),
    )


def moves(stays: DataFrame, deaths: DataFrame) -> DataFrame:
    """Bed stays with their neighbours in the visit and the flags derived from them."""
    shifted = with_neighbours(
        stays.withColumn("transient", transient(F.col("bed_type"))),
        "hospital_visit_id",
        "bed_in",
        "location_visit_id",
        MOVES,
    )
    wide = shifted.join(deaths, ["hospital_visit_id", "core_demographic_id"], "left")
    here = F.col("location_id")
    round_trip = lambda near, far: F.coalesce(near & (far == here), F.lit(False))
    in_bed_now = (
        F.col("hosp_dc").isNull()
        & F.col("bed_dc").isNull()
        & F.col("datetime_of_death").isNull()
        & (F.col("bed") != fixed.WAITING_BED)
    )
    died_in_hospital = (F.col("datetime_of_death") > F.col("hosp_in")) & (
        (F.col("datetime_of_death") <= F.col("hosp_dc")) | F.col("hosp_dc").isNull()
    )
    return wide.withColumns(
        {
            "noncensus_in": round_trip(F.col("transient_lag1"), F.col("location_lag2")),
            "noncensus_out": round_trip(F.col("transient_lead1"), F.col("location_lead2")),
            "census_now": F.when(in_bed_now, True),
            "census_now_cc": F.when(in_bed_now & F.col("critical_care"), True),
            "died_here": F.when(
                died_in_hospital & (F.col("location_visit_id") == F.col("death_stay_id")), True
            ),
        }
    )


def changed(before: str, now: str) -> Column:
    """TRUE on a first or different value; unknown when only ``now`` is NULL."""
    return (F.col(before) != F.col(now)) | F.col(before).isNull()


def counter(lag: str, lead: str, now: str, only: Column | None = None) -> Column:
    """+1 on moving in, -1 on moving out, NULL for round trips and moves within."""
    enters = (F.col("event") == BED_IN) & changed(lag, now) & ~F.col("noncensus_in")
    leaves = (
        (F.col("event") == BED_OUT)
        & changed(lead, now)
        & ~F.col("noncensus_out")
        & F.col("ts").isNotNull()
    )
    if only is not None:
        enters, leaves = only & enters, only & leaves
    return F.when(enters, 1).when(leaves, -1)


def census(
    t: EhrTables, as_of: AsOf, window: str, rules: ParserRules, by_critical_care: bool
) -> DataFrame:
    cohort = inpatients(t, as_of, window)
    stays = census_stays(t, rules)
    counted = of_cohort(stays, cohort)
    wide = moves(counted, death_stays(counted))
    kept = [c for c in wide.columns if c not in (BED_IN, BED_OUT)]
    sums = {"ward_sum": "ward"}
    if by_critical_care:
        sums["care_sum"] = "critical_care"
    events = with_running_totals(
        interval_events(wide, kept),
        interval_events(counted, list(sums.values())),
        "ts",
        "census",
        sums,
    )
    # one fold for both anchors: there are no more rows in it than beds
    in_use = beds_in_use(counted, "ward", "critical_care", "bed", "location_string")
    wards = in_use.groupBy("ward").agg(F.countDistinct("bed").alias("occupancy_now"))
    if by_critical_care:
        care = in_use.groupBy("critical_care").agg(F.countDistinct("location_string").alias("cc_now"))
        events = events.join(wards, "ward", "left").join(care, "critical_care", "left")
    else:
        events = events.join(wards, "ward")
    return events.withColumns(
        {
            "bed_death": F.when(F.col("event") == BED_IN, F.col("died_here")),
            "occupancy": F.col("occupancy_now") - F.col("ward_sum"),
            "ward_census": counter("ward_lag1", "ward_lead1", "ward"),
            "out_of_hours": out_of_hours(F.col("ts")),
        }
    )


def census_plus(t: EhrTables, as_of: AsOf = None, window: str = "3 MONTHS") -> DataFrame:
    """Events of the last months for wards that have a bed in use now."""
    return census(t, as_of, window, GENERAL_CENSUS, by_critical_care=False).select(
        "mrn",
        "encounter",
        "lastname",
        "firstname",
        "datetime_of_death",
        "hosp_in",
        "hosp_dc",
        "ts",
        "event",
        "building",
        "location_visit_id",
        "ward",
        "bed",
        "bed_type",
        "ed_zone",
        "ward_lag1",
        "ward_lead1",
        "noncensus_in",
        "noncensus_out",
        "census_now",
        "bed_death",
        "census",
        "occupancy_now",
        "occupancy",
        "ward_census",
        "out_of_hours",
    )


def census_cc(t: EhrTables, as_of: AsOf = None, window: str = "12 MONTHS") -> DataFrame:
    """The same over a year, with critical care counted besides the wards."""
    events = census(t, as_of, window, CRITICAL_CARE_CENSUS, by_critical_care=True)
    in_care = F.col("critical_care")
    return events.select(
        "mrn",
        "core_demographic_id",
        "encounter",
        "hospital_visit_id",
        "patient_class",
        "lastname",
        "firstname",
        "datetime_of_death",
        "hosp_in",
        "hosp_dc",
        "ts",
        "event",
        "building",
        "location_visit_id",
        "ward",
        "bed",
        "bed_type",
        "critical_care",
        "cc_lag1",
        "cc_lead1",
        "ward_lag1",
        "ward_lead1",
        "location_string",
        "location_id",
        "noncensus_in",
        "noncensus_out",
        "census_now_cc",
        "census_now",
        "bed_death",
        "census",
        "occupancy_now",
        "cc_now",
        "occupancy",
        (F.col("cc_now") - F.col("care_sum")).alias("cc_occupancy"),
        counter("cc_lag1", "cc_lead1", "critical_care", only=in_care).alias("cc_census"),
        "ward_census",
        "out_of_hours",
    )
