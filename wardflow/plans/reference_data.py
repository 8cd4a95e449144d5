"""Dictionaries: parsed locations, observation types, audit targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.locations import LOCATION_VIEW, ParserRules, parse_locations
from wardflow.operators.intervals import flags_to_long
from wardflow.sources.ehr import EhrTables


def location(t: EhrTables, rules: ParserRules = LOCATION_VIEW) -> DataFrame:
    return parse_locations(t.location, rules)


def visit_observation_type(t: EhrTables) -> DataFrame:
    """Observation types with the description of their flowsheet row, if any."""
    row = t.flowsheetrowdim.withColumnRenamed("flowsheetrowepicid", "id_in_application")
    return t.visit_observation_type.join(row, "id_in_application", "left").select(
        "visit_observation_type",
        "id_in_application",
        "source_application",
        "name",
        "displayname",
        "abbreviation",
        "valuetype",
        "rowtype",
        "unit",
        "description",
        "iscalculated",
        "_lastupdatedinstant",
    )


def alltargets_long(t: EhrTables) -> DataFrame:
    """Seven target flags per audit entry, one row each, with the bed's grid place."""
    place = t.t03_bed_grid.select(
        F.col("key").alias("bed"), "loc_x", "loc_y", F.col("bed").alias("bed_number")
    )
    # the grid is joined before the rows are multiplied by seven
    entries = t.all_targets.withColumnRenamed("log_dt", "ts").join(place, "bed", "left")
    keep = ["mrn", "csn", "side", "ts", "bay", "bed", "loc_x", "loc_y", "bed_number"]
    long = flags_to_long(entries, keep, fixed.TARGETS, "target_name", "target_value")
    hit = F.when(F.col("target_value"), 1).otherwise(0)
    return long.select(
        "mrn",
        "csn",
        "side",
        "ts",
        "target_name",
        "target_value",
        hit.alias("target01"),
        "bay",
        "bed",
        "loc_x",
        "loc_y",
        "bed_number",
    )
