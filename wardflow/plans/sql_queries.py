"""Queries that read the catalog's views and functions by SQL, and tables of two generations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from wardflow.catalog.tables import new_schema, publish
from wardflow.catalog.views import create_catalog_views, create_functions, in_schema
from wardflow.plans import occupancy
from wardflow.sources.ehr import EhrTables, columns_of

AsOf = datetime | str | None

#: What the newer generation of the schema calls the times of two of its tables.
NEWER_NAMES = {
    "location_visit": {"admission_time": "admission_datetime", "discharge_time": "discharge_datetime"},
    "hospital_visit": {
        "admission_time": "admission_datetime",
        "presentation_time": "presentation_datetime",
        "discharge_time": "discharge_datetime",
    },
}


def schemas_of(t: EhrTables, as_of: AsOf) -> tuple[str, str]:
    """The schemas of the tables and of the views over them; made once for each ``t`` and time."""
    known = t.schemas.get(as_of)
    if known is None:
        tables, views = new_schema(t.spark, "ehr"), new_schema(t.spark, "views")
        publish(t, tables)
        create_functions(t.spark, views, tables, as_of)
        create_catalog_views(t.spark, views, tables)
        known = t.schemas[as_of] = tables, views
    return known


def view(t: EhrTables, as_of: AsOf, name: str) -> DataFrame:
    """A stored view, read by its name."""
    return t.spark.table(f"{schemas_of(t, as_of)[1]}.{name}")


def crosstab(t: EhrTables, as_of: AsOf) -> DataFrame:
    """The table function for all times, as a query would call it."""
    with in_schema(t.spark, schemas_of(t, as_of)[1]):
        return t.spark.sql("SELECT * FROM oxygen_crosstab(CAST(NULL AS INT))")


def ages_and_places(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Scalar functions in a query over two tables: emergency visits with age, initials and last bed's index."""
    tables, views = schemas_of(t, as_of)
    with in_schema(t.spark, views):
        return t.spark.sql(
            f"""SELECT v.hospital_visit_id, age_years(p.date_of_birth, to_date(as_of())) AS age,
              initials(p.firstname, p.lastname) AS initials, out_of_hours(v.presentation_time) AS out_of_hours,
              bed_index(last.place) AS bed_index
            FROM {tables}.hospital_visit v
            JOIN {tables}.core_demographic p ON p.mrn_id = v.mrn_id
            LEFT JOIN (
              SELECT s.hospital_visit_id, max_by(l.location_string, struct(s.admission_time, s.location_visit_id)) AS place
              FROM {tables}.location_visit s JOIN {tables}.location l ON l.location_id = s.location_id
              WHERE s.admission_time IS NOT NULL GROUP BY s.hospital_visit_id) last
              ON last.hospital_visit_id = v.hospital_visit_id
            WHERE v.patient_class = 'EMERGENCY'"""
        )


def newer_generation(t: EhrTables, as_of: AsOf) -> str:
    """A schema that holds the tables of ``NEWER_NAMES`` only, by their newer columns' names."""
    tables, _ = schemas_of(t, as_of)
    schema = new_schema(t.spark, "ehr_newer")
    for name, names in NEWER_NAMES.items():
        fields = ", ".join(f"{c} AS {names.get(c, c)}" for c in columns_of(name))
        t.spark.sql(f"CREATE VIEW {schema}.{name} AS SELECT {fields} FROM {tables}.{name}")
    return schema


def occupancy_of_generations(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Occupancy over stays of the newer generation and places of the older one."""
    older, newer = schemas_of(t, as_of)[0], newer_generation(t, as_of)
    mixed = EhrTables.from_search_path(t.spark, [newer, older], {newer: NEWER_NAMES})
    return occupancy.occupancy(mixed)


def oxygen(t: EhrTables, as_of: AsOf) -> DataFrame:
    """Hourly oxygen demand by SQL alone: a view on a view on table functions."""
    found = view(t, as_of, "oxygen")
    return found.withColumns({c: F.round(c, 6) for c in ("o2_demand", "o2_locf")})
