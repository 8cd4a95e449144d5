"""The record system's tables, as Spark reads them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "mrn": "mrn_id LONG, mrn STRING, nhs_number STRING",
    "mrn_to_live": "mrn_id LONG, live_mrn_id LONG",
    "core_demographic": (
        "core_demographic_id LONG, mrn_id LONG, firstname STRING, lastname STRING,"
        " sex STRING, home_postcode STRING, date_of_birth DATE,"
        " datetime_of_death TIMESTAMP_NTZ"
    ),
    "hospital_visit": (
        "hospital_visit_id LONG, mrn_id LONG, encounter STRING,"
        " admission_time TIMESTAMP_NTZ, presentation_time TIMESTAMP_NTZ,"
        " discharge_time TIMESTAMP_NTZ, patient_class STRING, arrival_method STRING,"
        " discharge_disposition STRING, source_system STRING"
    ),
    "location": "location_id LONG, location_string STRING",
    "location_visit": (
        "location_visit_id LONG, hospital_visit_id LONG, location_id LONG,"
        " admission_time TIMESTAMP_NTZ, discharge_time TIMESTAMP_NTZ"
    ),
    "visit_observation": (
        "visit_observation_id LONG, hospital_visit_id LONG,"
        " observation_datetime TIMESTAMP_NTZ, visit_observation_type_id LONG,"
        " value_as_real DOUBLE, value_as_text STRING, unit STRING"
    ),
    "visit_observation_type": (
        "visit_observation_type LONG, id_in_application STRING, source_application STRING"
    ),
    "flowsheetrowdim": (
        "flowsheetrowepicid STRING, name STRING, displayname STRING,"
        " abbreviation STRING, valuetype STRING, rowtype STRING, unit STRING,"
        " description STRING, iscalculated STRING,"
        " _lastupdatedinstant TIMESTAMP_NTZ"
    ),
    "lab_order": "lab_order_id LONG, hospital_visit_id LONG",
    "lab_result": (
        "lab_result_id LONG, lab_order_id LONG, lab_test_definition_id LONG,"
        " result_last_modified_time TIMESTAMP_NTZ, value_as_real DOUBLE,"
        " units STRING, abnormal_flag STRING, comment STRING"
    ),
    "all_targets": (
        "mrn STRING, csn STRING, side STRING, log_dt TIMESTAMP_NTZ, bay STRING,"
        " bed STRING, spo2 BOOLEAN, map BOOLEAN, pao2 BOOLEAN, ph BOOLEAN,"
        " hb BOOLEAN, fb BOOLEAN, rass BOOLEAN"
    ),
    "t03_bed_grid": "key STRING, loc_x LONG, loc_y LONG, bed LONG",
}


def columns_of(name: str) -> dict[str, str]:
    """Column -> type of a table."""
    return dict(column.split() for column in SCHEMAS[name].split(", "))


@dataclass
class EhrTables:
    """Named access to the tables: ``tables.location_visit`` is a DataFrame.

    An instance stands for the files it found; make a new one to see new files.
    """

    spark: SparkSession
    read: Callable[[str], DataFrame]
    #: SQL text that selects a table, where it is stored; frames have none
    query: Callable[[str], str] | None = None
    #: schemas that were made of these tables, by the time their views call now
    schemas: dict[object, tuple[str, str]] = field(default_factory=dict)
    _frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self.read(name)
        return self._frames[name]

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str) -> EhrTables:
        """Parquet files or folders ``{directory}/{table}.parquet``.

        A table may be partitioned by the date of a time column, in folders ``{column}_date=...``;
        windows of recent time then read the dates they need.
        """

        def read(name: str) -> DataFrame:
            path = f"{directory.rstrip('/')}/{name}.parquet"
            return spark.read.schema(SCHEMAS[name]).parquet(path)

        def query(name: str) -> str:
            return f"SELECT {', '.join(columns_of(name))} FROM parquet.`{directory.rstrip('/')}/{name}.parquet`"

        return cls(spark, read, query)

    @classmethod
    def from_database(cls, spark: SparkSession, database: str) -> EhrTables:
        """Catalog tables; pick the generation of the schema by database name."""
        return cls.from_search_path(spark, [database])

    @classmethod
    def from_search_path(
        cls,
        spark: SparkSession,
        schemas: Sequence[str],
        renamed: Mapping[str, Mapping[str, Mapping[str, str]]] | None = None,
    ) -> EhrTables:
        """Each table from the first of ``schemas`` that has it: a newer generation before an older one.

        A generation may hold some tables only.  ``renamed`` says where it calls columns otherwise:
        schema -> table -> {our name: its name}.  All columns a table must have are selected by our
        names and types, so pipelines read any mix of generations alike.
        """

        def query(name: str) -> str:
            for schema in schemas:
                if spark.catalog.tableExists(f"{schema}.{name}"):
                    theirs = (renamed or {}).get(schema, {}).get(name, {})
                    fields = (f"CAST({theirs.get(c, c)} AS {kind}) AS {c}" for c, kind in columns_of(name).items())
                    return f"SELECT {', '.join(fields)} FROM {schema}.{name}"
            raise LookupError(f"no table {name} in {', '.join(schemas)}")

        return cls(spark, lambda name: spark.sql(query(name)), query)

    @classmethod
    def from_frames(
        cls, spark: SparkSession, frames: Mapping[str, DataFrame]
    ) -> EhrTables:
        return cls(spark, lambda name: frames[name])
