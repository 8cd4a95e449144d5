"""Everyday questions: who is in a bed, who came in, recent vitals and labs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.text import initials, label_for, part
from wardflow.functions.times import age_years, ago, later_than
from wardflow.operators.identity import with_mrns
from wardflow.sources.ehr import EhrTables

AsOf = datetime | str | None

VISIT_COLUMNS = [
    "hospital_visit_id",
    "encounter",
    "admission_time",
    "arrival_method",
    "presentation_time",
    "discharge_time",
    "discharge_disposition",
]


def current_bed(t: EhrTables, as_of: AsOf = None, window: str = "12 HOURS") -> DataFrame:
    """Open bed stays in resuscitation or majors, by location."""
    place = F.col("location_string")
    beds = t.location.where(
        (part(place, 1) == fixed.EMERGENCY_DEPARTMENT)
        & part(place, 2).rlike(fixed.ED_BED_PATTERN)
    )
    stays = t.location_visit.where(
        (F.col("admission_time") > ago(as_of, window)) & F.col("discharge_time").isNull()
    )
    return (
        stays.join(beds, "location_id")
        .select(
            "location_visit_id",
            "hospital_visit_id",
            "location_id",
            "location_string",
            "admission_time",
            "discharge_time",
        )
        .orderBy(F.asc_nulls_last("location_string"), "location_visit_id")
    )


def _ambulance_emergencies(t: EhrTables, as_of: AsOf, window: str) -> DataFrame:
    return t.hospital_visit.where(
        (F.col("presentation_time") > ago(as_of, window))
        & (F.col("patient_class") == fixed.EMERGENCY_CLASS)
        & (F.col("arrival_method") == fixed.AMBULANCE)
    ).select(*VISIT_COLUMNS, "mrn_id")


def _newest_first(visits: DataFrame, *more: str) -> DataFrame:
    return visits.select(*VISIT_COLUMNS, *more).orderBy(
        F.desc_nulls_first("presentation_time"), "hospital_visit_id"
    )


def hospital_visit_1(t: EhrTables, as_of: AsOf = None, window: str = "12 HOURS") -> DataFrame:
    """Recent emergency visits by ambulance."""
    return _newest_first(_ambulance_emergencies(t, as_of, window))


def hospital_visit_2(t: EhrTables, as_of: AsOf = None, window: str = "12 HOURS") -> DataFrame:
    """The same with the booked and the live hospital number."""
    visits = _ambulance_emergencies(t, as_of, window)
    return _newest_first(
        with_mrns(visits, t.mrn, t.mrn_to_live), "original_mrn", "live_mrn"
    )


def hospital_visit_3(t: EhrTables, as_of: AsOf = None, window: str = "12 HOURS") -> DataFrame:
    """The same with demographics of the booked patient."""
    person = t.core_demographic.select(
        "mrn_id",
        "date_of_birth",
        age_years(F.col("date_of_birth"), as_of).alias("age"),
        "sex",
        "home_postcode",
        initials(F.col("firstname"), F.col("lastname")).alias("initials"),
    )
    visits = _ambulance_emergencies(t, as_of, window).join(person, "mrn_id")
    return _newest_first(
        with_mrns(visits, t.mrn, t.mrn_to_live),
        "original_mrn",
        "live_mrn",
        "date_of_birth",
        "age",
        "sex",
        "home_postcode",
        "initials",
    )


def lactate(t: EhrTables, as_of: AsOf = None, window: str = "3 HOURS") -> DataFrame:
    """Recent blood lactate results with the visit they belong to."""
    recent = later_than(t.lab_result, "result_last_modified_time", ago(as_of, window))
    results = recent.where(F.col("lab_test_definition_id") == fixed.LACTATE_TEST)
    return (
        results.join(t.lab_order, "lab_order_id")
        .select(
            "lab_result_id",
            "hospital_visit_id",
            "result_last_modified_time",
            "value_as_real",
            "units",
            "abnormal_flag",
            "comment",
        )
        .orderBy(F.desc_nulls_first("result_last_modified_time"), "lab_result_id")
    )


def vital_signs(t: EhrTables, as_of: AsOf = None, window: str = "5 MINUTES") -> DataFrame:
    """Recent vital signs under their everyday names."""
    kinds = t.visit_observation_type.select(
        F.col("visit_observation_type").alias("visit_observation_type_id"),
        label_for(F.col("id_in_application"), fixed.VITAL_LABELS).alias("vital"),
    ).where(F.col("vital").isNotNull())
    recent = later_than(t.visit_observation, "observation_datetime", ago(as_of, window))
    return (
        recent.join(kinds, "visit_observation_type_id")
        .select(
            "visit_observation_id",
            "hospital_visit_id",
            "observation_datetime",
            "vital",
            "value_as_real",
            "value_as_text",
            "unit",
        )
        .orderBy(F.desc_nulls_first("observation_datetime"), "visit_observation_id")
    )
