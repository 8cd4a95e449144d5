"""Scalar rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardflow.functions import locations
from wardflow.functions.text import capture, capture_int, initials, part
from wardflow.functions.times import age_years, hour_floor, out_of_hours, time_slot


def values(spark, rows, schema, expression):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expression).collect()]


def test_parts(spark):
    rows = [("A^B^C",), ("A",), ("",), (None,), ("^^",)]
    assert values(spark, rows, "s string", part(F.col("s"), 3)) == ["C", "", "", None, ""]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("null^T07CV BY^BY5", ("T07CV", True, None, True, "bay")),
        ("null^OTHER^null", (None, False, None, None, None)),
        ("GWB^MCC^DISCHARGE", ("GWB", True, "MCC", None, None)),
        ("EDH^EDH WAIT^WAIT", ("EDH", False, "EDH", None, None)),
        ("ED^OUTSC^TRIAGE 1", ("ED", True, "tower", None, None)),
        ("P^P CHAIR^BD1", ("P", True, None, None, None)),
        ("P^P IR^BD1", ("P", True, None, None, "procedure")),
        ("P^P INR^BD1", ("P", True, None, None, "procedure")),
        ("IR^X^BD1", ("IR", True, None, None, None)),
        ("P^P CT^BD1", ("P", True, None, None, "imaging")),
        ("CT^P^BD1", ("CT", True, None, None, None)),
        ("plain", ("plain", None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_location_rules(spark, text, expected):
    df = spark.createDataFrame([(1, text)], "location_id long, location_string string")
    row = locations.parse_locations(df).first()
    found = (row.ward, row.census, row.building, row.critical_care, row.bed_type)
    assert found == expected


def test_parser_variants(spark):
    df = spark.createDataFrame(
        [(1, "SINQ^SINQ HR^HR1"), (2, "T06^X^SR1")], "location_id long, location_string string"
    ).orderBy("location_id")
    read = lambda rules: [
        (r.building, r.critical_care)
        for r in locations.parse_locations(df, rules).orderBy("location_id").collect()
    ]
    assert read(locations.LOCATION_VIEW) == [("NHNN", True), ("tower", None)]
    assert read(locations.GENERAL_CENSUS) == [(None, True), ("tower", None)]
    assert read(locations.CRITICAL_CARE_CENSUS) == [("NHNN", True), ("tower", False)]


def test_captures(spark):
    rows = [("BY01",), ("BY",), ("X12A",), ("12AB",), ("BY99999999999",), (None,)]
    pattern = r".*?(\d+)\D?$"
    assert values(spark, rows, "s string", capture_int(F.col("s"), pattern)) == [
        1, None, 12, None, None, None,
    ]
    assert values(spark, [("T03",), ("03",)], "s string", capture(F.col("s"), r"^(\D+)\d*")) == [
        "T", None,
    ]


def test_initials(spark):
    rows = [("Ann", "Bee"), (None, "Bee"), ("", "Bee"), (None, None)]
    found = values(spark, rows, "a string, b string", initials(F.col("a"), F.col("b")))
    assert found == ["AB", "B", "B", ""]


@pytest.mark.parametrize(
    "born, today, years",
    [
        ("2000-02-29", "2023-02-28", 22),
        ("2000-02-29", "2023-03-01", 23),
        ("2000-02-29", "2024-02-29", 24),
        ("1990-01-31", "2024-01-31", 34),
        ("1990-02-01", "2024-01-31", 33),
        ("2024-02-01", "2024-01-31", 0),
        (None, "2024-01-31", None),
    ],
)
def test_age(spark, born, today, years):
    born = born and dt.date.fromisoformat(born)
    assert values(spark, [(born,)], "d date", age_years(F.col("d"), today)) == [years]


def test_hours(spark):
    times = [(dt.datetime(2024, 1, 1, h, 59),) for h in (0, 6, 7, 21, 22)] + [(None,)]
    assert values(spark, times, "t timestamp_ntz", out_of_hours(F.col("t"))) == [
        True, True, False, False, True, False,
    ]


def test_times_do_not_depend_on_the_session_zone(spark):
    moments = [dt.datetime(2024, 3, 31, 1, 30), dt.datetime(1969, 12, 31, 23, 59, 59), None]
    rows = [(m,) for m in moments]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/London", "Pacific/Auckland"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert values(spark, rows, "t timestamp_ntz", hour_floor(F.col("t"))) == [
                dt.datetime(2024, 3, 31, 1), dt.datetime(1969, 12, 31, 23), None,
            ]
            slots = values(spark, rows, "t timestamp_ntz", time_slot(F.col("t"), 60))
            assert slots[0] == (moments[0] - dt.datetime(1970, 1, 1)).total_seconds() // 3600 * 60
            assert slots[1:] == [-60, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
