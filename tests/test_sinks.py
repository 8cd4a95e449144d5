"""Views, snapshots, table sources and the scratch folder."""

import duckdb
import pytest
from pyspark.errors import AnalysisException

from tests.compare import spark_rows
from tests.random_ehr import load
from wardflow.plans.catalog import PIPELINES, create_views, drop_views
from wardflow.plans.snapshots import read_snapshot, refresh_snapshot, write_snapshot
from wardflow.sources.ehr import SCHEMAS, EhrTables
from wardflow.sources.scratch import scratch_folder

AS_OF = "2024-01-31 00:00:00"


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, duckdb.connect(), 11)


def test_views(spark, tables):
    names = create_views(tables, AS_OF, ["location", "cc_filter"], prefix="flow_")
    assert names == ["flow_location", "flow_cc_filter"]
    direct = PIPELINES["location"](tables, AS_OF)
    assert spark_rows(spark.table("flow_location")) == spark_rows(direct)
    with pytest.raises(AnalysisException):
        create_views(tables, AS_OF, ["location"], replace=False, prefix="flow_")
    create_views(tables, AS_OF, ["location"], prefix="flow_")
    drop_views(spark, [*names, "flow_never_made"])
    assert not any(v.name.startswith("flow_") for v in spark.catalog.listTables())


def test_snapshot(spark, tables, tmp_path):
    df = PIPELINES["occupancy"](tables, AS_OF)
    path = str(tmp_path / "occupancy")
    for _ in range(2):
        write_snapshot(df, path)
        assert spark_rows(read_snapshot(spark, path, df.schema)) == spark_rows(df)


def test_refresh_is_repeatable(spark, tables, tmp_path):
    df = PIPELINES["census_plus"](tables, AS_OF)
    paths = {
        refresh_snapshot(tables, "census_plus", str(tmp_path), AS_OF) for _ in range(2)
    }
    assert [p.rsplit("/", 2)[1:] for p in paths] == [["census_plus", "as_of=2024-01-31T000000"]]
    assert spark_rows(read_snapshot(spark, paths.pop(), df.schema)) == spark_rows(df)


def test_directory_and_database_sources(spark, tables, tmp_path):
    spark.sql(f"CREATE DATABASE older LOCATION '{tmp_path}/older'")
    try:
        for name in SCHEMAS:
            frame = tables.read(name)
            frame.write.parquet(str(tmp_path / f"{name}.parquet"))
            frame.write.format("parquet").saveAsTable(f"older.{name}")
        expected = spark_rows(PIPELINES["census_cc"](tables, AS_OF))
        for source in (
            EhrTables.from_directory(spark, str(tmp_path)),
            EhrTables.from_database(spark, "older"),
        ):
            assert spark_rows(PIPELINES["census_cc"](source, AS_OF)) == expected
    finally:
        spark.sql("DROP DATABASE older CASCADE")


def test_unknown_table(tables):
    with pytest.raises(AttributeError):
        tables.no_such_table  # noqa: B018


def test_scratch_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert scratch_folder(spark).startswith(configured)


def test_now_is_the_default(tables):
    assert PIPELINES["hospital_visit_1"](tables, None).count() == 0
