"""Views kept as SQL text in a schema of the catalog, where every session of the catalog can read them.

A view is expanded when it is read: what it selects from may have new rows by then, and Spark pushes the
reader's filters and columns through it.  Views stand on tables, on functions and on one another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import SparkSession

from wardflow.catalog.functions import SCALARS, TABLE_FUNCTIONS, definition
from wardflow.functions import fixed_values as fixed

AsOf = datetime | str | None


@dataclass(frozen=True)
class SqlView:
    """``text`` reads tables as ``{tables}.name``; ``reads`` are the views it stands on."""

    text: str
    reads: tuple[str, ...] = ()


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _identities(visits: str) -> str:
    return f"""SELECT DISTINCT i.core_demographic_id, i.mrn_id, i.mrn_id_alt, i.mrn, i.nhs_number, x.hospital_visit_id, v.encounter
    FROM {visits} x
    LEFT JOIN {{tables}}.hospital_visit v ON v.hospital_visit_id = x.hospital_visit_id
    LEFT JOIN identities i ON i.person_mrn_id = v.mrn_id"""


VIEWS: dict[str, SqlView] = {
    "location": SqlView(
        f"""SELECT location_id, location_string, ward_of(location_string) AS ward, bed, ward_raw,
          counts_for_census(bed) AS census, building_of(location_string) AS building,
          is_critical_care(location_string) AS critical_care, ed_zone_of(location_string) AS ed_zone,
          bed_type_of(location_string) AS bed_type
        FROM (SELECT *, split_part(location_string, '{fixed.SEPARATOR}', 1) AS ward_raw,
          split_part(location_string, '{fixed.SEPARATOR}', 3) AS bed FROM {{tables}}.location)"""
    ),
    # every person with the number booked under and, if known, the identity valid today
    "identities": SqlView(
        """SELECT p.mrn_id AS person_mrn_id, p.core_demographic_id, today.*
        FROM {tables}.core_demographic p
        LEFT JOIN (SELECT m.mrn_id AS mrn_id_alt, n.mrn_id, n.mrn, n.nhs_number FROM {tables}.mrn_to_live m
          LEFT JOIN {tables}.mrn n ON n.mrn_id = m.live_mrn_id) today ON today.mrn_id_alt = p.mrn_id"""
    ),
    "cc_visits": SqlView(
        """SELECT DISTINCT s.hospital_visit_id FROM {tables}.location_visit s
        JOIN location l ON l.location_id = s.location_id WHERE l.critical_care = true""",
        ("location",),
    ),
    "cc_filter": SqlView(_identities("cc_visits"), ("identities", "cc_visits")),
    "visit_observation_type": SqlView(
        """SELECT k.visit_observation_type, k.id_in_application, k.source_application, f.name, f.displayname,
          f.abbreviation, f.valuetype, f.rowtype, f.unit, f.description, f.iscalculated, f._lastupdatedinstant
        FROM {tables}.visit_observation_type k
        LEFT JOIN {tables}.flowsheetrowdim f ON f.flowsheetrowepicid = k.id_in_application"""
    ),
    "niv_visits": SqlView(
        f"""SELECT DISTINCT o.hospital_visit_id FROM {{tables}}.visit_observation o
        JOIN visit_observation_type k ON k.visit_observation_type = o.visit_observation_type_id
        WHERE k.name IN ({_texts(fixed.NIV_FLOWSHEET_ROWS)})
          OR (k.name = '{fixed.OXYGEN_DELIVERY_ROW}' AND o.value_as_text = '{fixed.NIV_DEVICE_TEXT}')""",
        ("visit_observation_type",),
    ),
    "niv_filter": SqlView(_identities("niv_visits"), ("identities", "niv_visits")),
    "last_known_values": SqlView(
        """SELECT hospital_visit_id, last_real, last_text, locf_s(0D, last_real) AS real_or_zero
        FROM (SELECT hospital_visit_id,
            max_by(value_as_real, locf_at(value_as_real, observation_datetime, visit_observation_id)) AS last_real,
            max_by(value_as_text, locf_text_at(value_as_text, observation_datetime, visit_observation_id)) AS last_text
          FROM {tables}.visit_observation GROUP BY hospital_visit_id)"""
    ),
    "bed_hours": SqlView(
        """SELECT place.location_string, hour.obs_dt
        FROM (SELECT DISTINCT l.location_string FROM {tables}.location_visit s
          JOIN {tables}.location l ON l.location_id = s.location_id) place,
        LATERAL hours_of_last(7) hour"""
    ),
    # readings with the place of the bed stay that each falls into: an as-of join by visit and time slot
    "located_readings": SqlView(
        """WITH readings AS (
          SELECT *, time_slot(observation_datetime) AS slot, struct(o2_lmin, o2_fi, o2_device) AS reading
          FROM oxygen_crosstab(7)
          WHERE hospital_visit_id IS NOT NULL AND observation_datetime IS NOT NULL),
        begun AS (
          SELECT s.hospital_visit_id, time_slot(s.admission_time) AS slot, s.admission_time AS at,
            struct(s.admission_time AS since, s.location_visit_id AS id, l.location_string AS place) AS bed
          FROM {tables}.location_visit s
          LEFT SEMI JOIN readings r ON r.hospital_visit_id = s.hospital_visit_id
          JOIN {tables}.location l ON l.location_id = s.location_id
          WHERE s.admission_time IS NOT NULL),
        slots AS (
          SELECT hospital_visit_id, slot, max(bed) AS bed
          FROM (SELECT hospital_visit_id, slot, bed FROM begun UNION ALL SELECT hospital_visit_id, slot, NULL FROM readings)
          GROUP BY hospital_visit_id, slot),
        carried AS (
          SELECT hospital_visit_id, slot, last_value(bed) IGNORE NULLS OVER (PARTITION BY hospital_visit_id ORDER BY slot
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bed
          FROM slots),
        merged AS (
          SELECT hospital_visit_id, slot, CAST(NULL AS TIMESTAMP_NTZ) AS at, 0 AS kind, bed, NULL AS reading
          FROM carried WHERE bed IS NOT NULL
          UNION ALL SELECT hospital_visit_id, slot, at, 1, bed, NULL FROM begun
          UNION ALL SELECT hospital_visit_id, slot, observation_datetime, 2, NULL, reading FROM readings)
        SELECT hospital_visit_id, at AS observation_datetime, reading.o2_lmin, reading.o2_fi, reading.o2_device,
          known.place AS location_string
        FROM (SELECT *, last_value(bed) IGNORE NULLS OVER (PARTITION BY hospital_visit_id, slot
            ORDER BY at NULLS FIRST, kind, bed.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM merged)
        WHERE kind = 2 AND known IS NOT NULL"""
    ),
    "oxygen_demands": SqlView(
        f"""SELECT hospital_visit_id, location_string, hour_floor(observation_datetime) AS obs_dt,
          avg(oxygen_demand(o2_lmin, o2_fi, device_flow(o2_device))) AS o2_demand
        FROM located_readings
        WHERE location_string IS NOT NULL
          AND ward_prefix(split_part(location_string, '{fixed.SEPARATOR}', 1)) IN ({_texts(fixed.O2_WARD_PREFIXES)})
          AND hour_floor(observation_datetime) BETWEEN hour_floor(as_of() - INTERVAL '7' DAY) AND hour_floor(as_of())
        GROUP BY hospital_visit_id, location_string, hour_floor(observation_datetime)""",
        ("located_readings",),
    ),
    "oxygen": SqlView(
        f"""WITH known AS (
          SELECT location_string, obs_dt, max_by(o2_demand, hospital_visit_id) AS o2_locf
          FROM oxygen_demands GROUP BY location_string, obs_dt),
        followed AS (
          SELECT location_string, o2_locf, obs_dt, lead(obs_dt) OVER (PARTITION BY location_string ORDER BY obs_dt) AS next_dt
          FROM known),
        until_next AS (
          SELECT location_string, o2_locf, obs_dt + INTERVAL '1' HOUR AS first_gap,
            coalesce(next_dt - INTERVAL '1' HOUR, hour_floor(as_of())) AS last_gap
          FROM followed),
        filled AS (
          SELECT d.location_string, d.obs_dt, d.o2_demand, k.o2_locf
          FROM oxygen_demands d JOIN known k ON k.location_string = d.location_string AND k.obs_dt = d.obs_dt
          UNION ALL
          SELECT location_string, explode(sequence(first_gap, last_gap, INTERVAL '1' HOUR)), CAST(NULL AS DOUBLE), o2_locf
          FROM until_next WHERE first_gap <= last_gap)
        SELECT location_string, obs_dt, o2_demand, o2_locf, split_part(location_string, '{fixed.SEPARATOR}', 1) AS ward,
          floor_index(split_part(location_string, '{fixed.SEPARATOR}', 1)) AS floor_index,
          bed_index(location_string) AS bed_index
        FROM filled""",
        ("oxygen_demands",),
    ),
}


@contextmanager
def in_schema(spark: SparkSession, schema: str) -> Iterator[None]:
    """Plain names mean ``schema`` inside; table functions can be called by plain names only."""
    before = spark.catalog.currentDatabase()
    spark.sql(f"USE {schema}")
    try:
        yield
    finally:
        spark.sql(f"USE {before}")


def with_dependencies(names: Iterable[str]) -> list[str]:
    """The views and all that they stand on, each after what it reads."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in VIEWS[name].reads:
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return ordered


def readers_of(names: Iterable[str]) -> list[str]:
    """The views and all that stand on them, each before what it reads: the order to drop them in."""
    gone = set(names)
    ordered = with_dependencies(VIEWS)
    for name in ordered:
        if gone.intersection(VIEWS[name].reads):
            gone.add(name)
    return [name for name in reversed(ordered) if name in gone]


def create_functions(spark: SparkSession, schema: str, tables: str, as_of: AsOf = None) -> list[str]:
    """Make all functions in ``schema``; ``as_of()`` is the time that views call now, else the clock's."""
    now = "localtimestamp()" if as_of is None else f"TIMESTAMP_NTZ'{as_of}'"
    with in_schema(spark, schema):
        spark.sql(f"CREATE OR REPLACE FUNCTION {schema}.as_of() RETURNS TIMESTAMP_NTZ RETURN {now}")
        for name in [*SCALARS, *TABLE_FUNCTIONS]:
            spark.sql(definition(schema, name, tables))
    return ["as_of", *SCALARS, *TABLE_FUNCTIONS]


def create_catalog_views(
    spark: SparkSession, schema: str, tables: str, names: Iterable[str] = tuple(VIEWS), replace: bool = True
) -> list[str]:
    """Make views and those they stand on in ``schema``, over the tables of the schema ``tables``.

    Without ``replace`` a view that is there already is an error.
    """
    made = with_dependencies(names)
    word = "CREATE OR REPLACE VIEW" if replace else "CREATE VIEW"
    with in_schema(spark, schema):
        for name in made:
            spark.sql(f"{word} {schema}.{name} AS {VIEWS[name].text.replace('{tables}', tables)}")
    return made


def drop_catalog_views(spark: SparkSession, schema: str, names: Iterable[str] = tuple(VIEWS)) -> list[str]:
    """Drop views, and before them the views that stand on them; what does not exist is passed over."""
    dropped = readers_of(names)
    for name in dropped:
        spark.sql(f"DROP VIEW IF EXISTS {schema}.{name}")
    return dropped


def drop_functions(spark: SparkSession, schema: str) -> None:
    """Drop all functions, those that call others first."""
    for name in [*reversed(TABLE_FUNCTIONS), *reversed(SCALARS), "as_of"]:
        spark.sql(f"DROP FUNCTION IF EXISTS {schema}.{name}")
