"""Attributes read out of a ``Department^Ward^Bed`` location string."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.text import first_match, part


@dataclass(frozen=True)
class ParserRules:
    """The three published location parsers differ in these two points only."""

    nhnn_by_prefix: bool = True
    critical_care_default: bool | None = None


LOCATION_VIEW = ParserRules()
GENERAL_CENSUS = ParserRules(nhnn_by_prefix=False)
CRITICAL_CARE_CENSUS = ParserRules(critical_care_default=False)


def parse_locations(locations: DataFrame, rules: ParserRules = LOCATION_VIEW) -> DataFrame:
    """One row per location: identifiers plus eight parsed attributes."""
    text = F.col("location_string")
    department, unit, bed = F.col("ward_raw"), F.col("_unit"), F.col("bed")
    # the string is split once; every rule below reads the parts
    split = locations.select(
        "location_id",
        "location_string",
        part(text, 1).alias("ward_raw"),
        part(text, 2).alias("_unit"),
        part(text, 3).alias("bed"),
    )
    hidden = unit.rlike(fixed.HIDDEN_WARD_PATTERN)
    return split.select(
        "location_id",
        "location_string",
        F.when(department != fixed.NULL_TEXT, department)
        .when(hidden, fixed.HIDDEN_WARD)
        .alias("ward"),
        "bed",
        "ward_raw",
        counts_for_census(bed).alias("census"),
        building_of(text, department, rules).alias("building"),
        F.when(department.rlike(fixed.CRITICAL_CARE_PATTERN) | hidden, True)
        .otherwise(F.lit(rules.critical_care_default).cast("boolean"))
        .alias("critical_care"),
        ed_zone_of(text, department).alias("ed_zone"),
        bed_type_of(text, bed).alias("bed_type"),
    )


def counts_for_census(bed: Column) -> Column:
    return first_match(
        [
            (bed.rlike(fixed.CENSUS_BED_PATTERN), True),
            (bed.isin(fixed.NON_CENSUS_BEDS), False),
        ]
    )


def building_of(text: Column, department: Column, rules: ParserRules) -> Column:
    starts = lambda prefixes: F.left(text, F.lit(len(prefixes[0]))).isin(prefixes)
    tests = [
        (department.rlike(fixed.TOWER_PATTERN), fixed.TOWER),
        (starts(fixed.WMS_PREFIXES), fixed.WMS),
        *[(text.contains(name), name) for name in fixed.BUILDINGS_NAMED_IN_TEXT],
    ]
    if rules.nhnn_by_prefix:
        tests.append((starts(fixed.NHNN_PREFIXES), fixed.NHNN))
    tests += [
        (text.startswith(fixed.EDH), fixed.EDH),
        (text.contains(fixed.EXTERNAL_TEXT), fixed.EXTERNAL),
    ]
    return first_match(tests)


def ed_zone_of(text: Column, department: Column) -> Column:
    zone = first_match((text.contains(key), name) for key, name in fixed.ED_ZONES)
    return F.when(department == fixed.EMERGENCY_DEPARTMENT, zone)


def bed_type_of(text: Column, bed: Column) -> Column:
    return first_match(
        [
            *[(bed.startswith(key), name) for key, name in fixed.BED_TYPE_PREFIXES],
            (text.rlike(fixed.PROCEDURE_PATTERN), fixed.PROCEDURE),
            (text.rlike(fixed.IMAGING_PATTERN), fixed.IMAGING),
        ]
    )


def transient(bed_type: Column) -> Column:
    """TRUE for procedure and imaging areas, otherwise NULL."""
    return F.when(bed_type.isin(fixed.PROCEDURE, fixed.IMAGING), True)
