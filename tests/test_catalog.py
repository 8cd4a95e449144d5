"""Functions and views in the catalog, and tables of two generations of the schema."""

import datetime as dt

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tests.random_ehr import load
from wardflow.catalog import views
from wardflow.catalog.functions import SCALARS, TABLE_FUNCTIONS
from wardflow.catalog.tables import new_schema, publish
from wardflow.plans import sql_queries
from wardflow.plans.catalog import PIPELINES
from wardflow.sources.ehr import SCHEMAS, EhrTables

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, duckdb.connect(), 21)


@pytest.fixture(scope="module")
def schemas(tables):
    return sql_queries.schemas_of(tables, AS_OF)


def test_functions_are_in_the_catalog(spark, schemas):
    there = {r["function"].rsplit(".", 1)[1] for r in spark.sql(f"SHOW USER FUNCTIONS IN {schemas[1]}").collect()}
    assert there == {"as_of", *SCALARS, *TABLE_FUNCTIONS}


def test_scalar_functions(spark, schemas):
    with views.in_schema(spark, schemas[1]):
        row = spark.sql(
            """SELECT locf_s(1D, NULL) AS a, locf_s(1D, 2D) AS b, locf_s(NULL, NULL) AS c,
              age_years(DATE'2000-02-29', DATE'2023-02-28') AS d, age_years(DATE'2024-02-01', DATE'2024-01-31') AS e,
              initials(NULL, 'Bo') AS f, ward_of('null^T07CV BY^BY1') AS g, ward_of('null^OTHER^x') AS h,
              counts_for_census('DISCHARGE') AS i, counts_for_census('POOL') AS j, counts_for_census('?') AS k,
              building_of('EDH^EDH WAIT^WAIT') AS l, building_of('ED^x^y') AS m, bed_index('a^b^BY 12B') AS n,
              floor_index('T07') AS o, bed_index('a^b^999999999999') AS p, oxygen_demand(NULL, 41D, NULL) AS q,
              oxygen_demand(NULL, NULL, device_flow('Tracheostomy')) AS r, out_of_hours(NULL) AS s, as_of() AS t"""
        ).first()
    assert tuple(row) == (
        1.0, 2.0, None, 22.0, -0.0, "B", "T07CV", None, True, False, None, "EDH", "tower", 12, 7, None, 8.0, 12.0, False,
        dt.datetime(2024, 1, 31),
    )


def test_locf_as_an_aggregate_and_over_a_window(spark, schemas):
    rows = [(1, 10, 2.0), (1, 20, None), (1, 30, 5.0), (1, 40, None), (2, 10, None)]
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m)")
    spark.createDataFrame(rows, "k long, m int, v double").withColumn("at", at).createOrReplaceTempView("readings")
    try:
        with views.in_schema(spark, schemas[1]):
            last = spark.sql("SELECT k, max_by(v, locf_at(v, at, m)) FROM readings GROUP BY k").collect()
            known = spark.sql("SELECT m, max_by(v, locf_at(v, at, m)) OVER (PARTITION BY k ORDER BY m) FROM readings WHERE k = 1").collect()
    finally:
        spark.catalog.dropTempView("readings")
    assert sorted(map(tuple, last)) == [(1, 5.0), (2, None)]
    assert sorted(map(tuple, known)) == [(10, 2.0), (20, 2.0), (30, 5.0), (40, 5.0)]


def test_series_has_both_ends(spark, schemas):
    with views.in_schema(spark, schemas[1]):
        week = spark.sql("SELECT * FROM hours_of_last(7)").collect()
        hours = spark.sql("SELECT * FROM hours_between(TIMESTAMP_NTZ'2024-01-01 22:30:00', TIMESTAMP_NTZ'2024-01-02 00:30:00')").collect()
    assert len(week) == 169 and len(hours) == 3


def test_another_session_reads_stacked_views(spark, tables, schemas):
    other = spark.newSession()
    assert other.catalog.currentDatabase() == "default"
    for name in ("cc_filter", "niv_filter", "visit_observation_type", "location"):
        assert spark_rows(other.table(f"{schemas[1]}.{name}")) == spark_rows(PIPELINES[name](tables, AS_OF))


def test_views_run_no_python_and_no_single_task(spark, schemas):
    for name in views.VIEWS:
        plan = spark.table(f"{schemas[1]}.{name}")._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "NestedLoop", "Cartesian", "SinglePartition")), name


def test_a_view_sees_new_rows(spark):
    tables, flow = new_schema(spark, "ehr"), new_schema(spark, "views")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.saveAsTable(f"{tables}.{name}")
    views.create_functions(spark, flow, tables)
    views.create_catalog_views(spark, flow, tables, ["location"])
    assert spark.table(f"{flow}.location").count() == 0
    spark.createDataFrame([(1, "T03^x^BY1")], SCHEMAS["location"]).write.insertInto(f"{tables}.location")
    assert spark.table(f"{flow}.location").select("building").first()[0] == "tower"


def test_views_are_dropped_after_their_readers(spark, tables, schemas):
    flow = new_schema(spark, "views")
    views.create_functions(spark, flow, schemas[0], AS_OF)
    assert views.create_catalog_views(spark, flow, schemas[0], ["cc_filter"]) == ["identities", "location", "cc_visits", "cc_filter"]
    there = lambda: {v.name for v in spark.catalog.listTables(flow)}
    assert there() == {"identities", "location", "cc_visits", "cc_filter"}
    with pytest.raises(AnalysisException):
        views.create_catalog_views(spark, flow, schemas[0], ["location"], replace=False)
    views.create_catalog_views(spark, flow, schemas[0], ["location"])
    assert views.drop_catalog_views(spark, flow, ["cc_visits", "niv_filter"]) == ["niv_filter", "cc_filter", "cc_visits"]
    assert there() == {"identities", "location"}
    views.drop_catalog_views(spark, flow)
    views.drop_functions(spark, flow)
    assert not there() and not spark.sql(f"SHOW USER FUNCTIONS IN {flow}").count()


def test_the_first_schema_that_has_a_table_counts(spark, tables, schemas):
    newer = new_schema(spark, "newer")
    spark.sql(f"CREATE VIEW {newer}.location AS SELECT location_id AS place_id, 'X^Y^Z' AS location_string FROM {schemas[0]}.location")
    t = EhrTables.from_search_path(spark, [newer, schemas[0]], {newer: {"location": {"location_id": "place_id"}}})
    assert {r["location_string"] for r in t.location.collect()} == {"X^Y^Z"}
    assert t.location.columns == ["location_id", "location_string"]
    assert spark_rows(t.mrn) == spark_rows(tables.mrn)
    with pytest.raises(LookupError):
        EhrTables.from_search_path(spark, [newer]).mrn  # noqa: B018


def test_stored_tables_are_read_in_place(spark, tables, tmp_path):
    for name in ("location", "location_visit"):
        tables.read(name).write.parquet(str(tmp_path / f"{name}.parquet"))
    schema = new_schema(spark, "ehr")
    publish(EhrTables.from_directory(spark, str(tmp_path)), schema, ["location", "location_visit"])
    assert all(v.tableType == "VIEW" for v in spark.catalog.listTables(schema))
    assert spark_rows(spark.table(f"{schema}.location_visit")) == spark_rows(tables.location_visit)
