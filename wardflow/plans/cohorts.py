"""Identity lists of patients with something in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.operators.identity import identities_of
from wardflow.plans.reference_data import location, visit_observation_type
from wardflow.sources.ehr import EhrTables


def cc_filter(t: EhrTables) -> DataFrame:
    """Patients ever in a critical-care bed."""
    beds = location(t).where(F.col("critical_care")).select("location_id")
    # visits are made distinct before any identity is looked up
    visits = t.location_visit.join(beds, "location_id").select("hospital_visit_id")
    return identities_of(visits.distinct(), t)


def niv_visits(t: EhrTables) -> DataFrame:
    """Visits with a record of non-invasive ventilation."""
    by_row = F.col("name").isin(fixed.NIV_FLOWSHEET_ROWS)
    by_device = (F.col("name") == fixed.OXYGEN_DELIVERY_ROW) & (
        F.col("value_as_text") == fixed.NIV_DEVICE_TEXT
    )
    kinds = visit_observation_type(t).select(
        F.col("visit_observation_type").alias("visit_observation_type_id"), "name"
    )
    return (
        t.visit_observation.join(kinds, "visit_observation_type_id")
        .where(by_row | by_device)
        .select("hospital_visit_id")
        .distinct()
    )


def niv_filter(t: EhrTables) -> DataFrame:
    """Patients who ever had non-invasive ventilation."""
    return identities_of(niv_visits(t), t)
