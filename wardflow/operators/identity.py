"""Merged patient identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def with_mrns(visits: DataFrame, mrn: DataFrame, mrn_to_live: DataFrame) -> DataFrame:
    """Add the number a visit was booked under and the one valid today."""
    original = mrn.select("mrn_id", F.col("mrn").alias("original_mrn"))
    live = mrn.select(
        F.col("mrn_id").alias("live_mrn_id"), F.col("mrn").alias("live_mrn")
    )
    return (
        visits.join(original, "mrn_id")
        .join(mrn_to_live.select("mrn_id", "live_mrn_id"), "mrn_id")
        .join(live, "live_mrn_id")
    )


def identities_of(visits: DataFrame, tables) -> DataFrame:
    """Distinct identifiers of the patients behind a set of hospital visits.

    A visit without a known patient stays, with NULL identifiers.
    """
    hospital_visit = tables.hospital_visit.select("hospital_visit_id", "encounter", "mrn_id")
    person = tables.core_demographic.select("core_demographic_id", "mrn_id")
    person = person.withColumn("person_mrn_id", F.col("mrn_id"))
    merged = tables.mrn_to_live.select(
        F.col("mrn_id").alias("person_mrn_id"),
        F.col("mrn_id").alias("mrn_id_alt"),
        "live_mrn_id",
    )
    live = tables.mrn.select(
        F.col("mrn_id").alias("live_mrn_id"),
        F.col("mrn_id").alias("live_id"),
        "mrn",
        "nhs_number",
    )
    return (
        visits.join(hospital_visit, "hospital_visit_id", "left")
        .join(person, "mrn_id", "left")
        .join(merged, "person_mrn_id", "left")
        .join(live, "live_mrn_id", "left")
        .select(
            "core_demographic_id",
            F.col("live_id").alias("mrn_id"),
            "mrn_id_alt",
            "mrn",
            "nhs_number",
            "hospital_visit_id",
            "encounter",
        )
        .distinct()
    )
