"""What the plans must and must not contain."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tests.compare import spark_rows
from tests.conftest import data_dir
from wardflow.catalog.tables import new_schema, store
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.prefix import with_running_totals
from wardflow.plans.catalog import PIPELINES
from wardflow.sources.bridge import bridge
from wardflow.sources.ehr import SCHEMAS, EhrTables

AS_OF = "2024-01-31 00:00:00"
# a single number and a top-k end in one task
ONE_ROW = {"row_counts", "row_counts_plus"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(contract._on_tables()))
def test_no_cross_join_and_no_single_task(spark, name):
    plan = plan_of(contract.queries()[name](spark, data_dir("0.001")))
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "Python" not in plan
    if name not in ONE_ROW:
        assert "SinglePartition" not in plan


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stored")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return EhrTables.from_directory(spark, str(folder))


def pushed(plan, table):
    return " ".join(
        re.findall(rf"{table}\.parquet.*?PushedFilters: (\[.*?\]), ReadSchema", plan)
    )


@pytest.mark.parametrize(
    "name, table, filters",
    [
        ("current_bed", "location_visit", ["GreaterThan(admission_time", "IsNull(discharge_time"]),
        ("hospital_visit_3", "hospital_visit", ["GreaterThan(presentation_time", "EqualTo(arrival"]),
        ("lactate", "lab_result", ["GreaterThan(result_last", "EqualTo(lab_test_definition_id"]),
        ("vital_signs", "visit_observation", ["GreaterThan(observation_datetime"]),
        ("census_cc", "hospital_visit", ["EqualTo(patient_class", "GreaterThan(discharge_time"]),
        ("oxygen", "visit_observation", ["GreaterThan(observation_datetime", "In(visit_obs"]),
    ],
)
def test_filters_reach_the_scan(spark, stored, name, table, filters):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        scans = pushed(plan_of(PIPELINES[name](stored, AS_OF)), table)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert scans
    for text in filters:
        assert text in scans


def test_columns_are_pruned(spark, stored):
    plan = plan_of(PIPELINES["cc_filter"](stored, AS_OF))
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan)
    assert any(s == "hospital_visit_id:bigint,location_id:bigint" for s in schemas)


@pytest.mark.parametrize("name", ["asof_join", "lag_lead", "oxygen", "census_plus", "census_cc", "occupancy", "running_census"])
def test_one_path_for_every_key(spark, stored, name):
    """No job runs before the plan is there, and no list of keys is part of it."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", name)
    try:
        plan = plan_of(contract._on_tables()[name](stored))
        assert not tracker.getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    lists = re.findall(r"hospital_visit_id#\d+L? (?:IN|INSET) ", plan)
    assert not lists
    # ordered work on visits and wards is cut by time slot
    assert re.search(r"Exchange hashpartitioning\([^\n]*_slot", plan)


@pytest.mark.parametrize("name", ["oxygen", "vital_signs"])
def test_recent_windows_read_their_dates(spark, tmp_path, name):
    for table, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    spark.sql(
        "SELECT 1L AS visit_observation_id, 1L AS hospital_visit_id, timestamp_ntz'2024-01-30 23:59:00' AS"
        " observation_datetime, 1L AS visit_observation_type_id, 1D AS value_as_real, '' AS value_as_text, '' AS unit,"
        " explode(array(date'2024-01-01', date'2024-01-30')) AS observation_datetime_date"
    ).write.mode("overwrite").partitionBy("observation_datetime_date").parquet(f"{tmp_path}/visit_observation.parquet")
    tables = EhrTables.from_directory(spark, str(tmp_path))
    df = PIPELINES[name](tables, AS_OF)
    assert re.search(r"PartitionFilters: \[[^\]]*observation_datetime_date", plan_of(df))
    assert set(df.columns) == set(PIPELINES[name](EhrTables.from_frames(spark, {
        t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()
    }), AS_OF).columns)


@contextmanager
def settings(spark, **values):
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_in_buckets_need_no_exchange_by_visit(spark):
    source = bridge(spark, data_dir("0.001"))
    schema = new_schema(spark, "bucketed")
    store(source, schema, 4)
    stored_tables = EhrTables.from_database(spark, schema)
    with settings(spark, autoBroadcastJoinThreshold="1k", adaptive__enabled="false"):
        # the places are few; all else is too large to broadcast here
        frames = {name: stored_tables.read(name) for name in SCHEMAS}
        frames["location"] = F.broadcast(frames["location"])
        tables = EhrTables.from_frames(spark, frames)
        by_visit = r"Exchange hashpartitioning\(hospital_visit_id"
        assert re.search(by_visit, plan_of(PIPELINES["occupancy"](source, AS_OF)))
        assert not re.search(by_visit, plan_of(PIPELINES["occupancy"](tables, AS_OF)))
    assert spark_rows(PIPELINES["occupancy"](stored_tables, AS_OF)) == spark_rows(PIPELINES["occupancy"](source, AS_OF))


@pytest.mark.parametrize("name", ["census_cc", "census_plus"])
def test_the_cohort_filters_the_scan_of_stays(spark, tmp_path, name):
    """Spark's runtime filter: stays of visits outside the horizon are dropped before they are shuffled."""
    source = bridge(spark, data_dir("0.001"))
    for table in SCHEMAS:
        source.read(table).write.parquet(str(tmp_path / f"{table}.parquet"))
    tables = EhrTables.from_directory(spark, str(tmp_path))
    with settings(
        spark,
        autoBroadcastJoinThreshold="-1",
        optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
        optimizer__runtime__bloomFilter__creationSideThreshold="1g",
    ):
        plan = plan_of(PIPELINES[name](tables, AS_OF))
    assert re.search(r"might_contain\([^\n]*hospital_visit_id", plan)


def test_rows_of_one_instant_are_dealt_to_several_tasks(spark):
    """Half of all moves at one instant: the instant is one row of totals, and its rows a join that Spark splits."""
    n = 40_000
    moves = spark.range(0, n, 1, 64).select(
        F.lit("W").alias("ward"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, IF(id % 2 = 0, 0, id))").alias("ts"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("census"),
        F.sha2(F.col("id").cast("string"), 256).alias("payload"),
    )
    small = {
        "autoBroadcastJoinThreshold": "-1",
        "adaptive__advisoryPartitionSizeInBytes": "160k",
        "adaptive__skewJoin__skewedPartitionThresholdInBytes": "160k",
        "adaptive__skewJoin__skewedPartitionFactor": "1.5",
        "adaptive__coalescePartitions__enabled": "false",
    }
    with settings(spark, **small):
        found = with_running_totals(moves, moves, "ts", "census", {"running": "ward"})
        held = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("payload").alias("n"), F.max("running").alias("m")).collect()
    counts = sorted(r["n"] for r in held)
    assert sum(counts) == n and counts[-1] <= 2 * n / len(counts) and len(counts) > 8
    assert max(r["m"] for r in held) == moves.agg(F.sum("census")).first()[0]


def test_neighbours_are_found_in_one_pass(spark):
    """The rows aren't read once for the inner and once for the outer ones: in a union either half of a stage
    gets half of its tasks, so that a task holds twice the rows, sorted twice."""
    stays = spark.range(100).selectExpr("id", "id % 5 AS visit", "timestamp_ntz'2024-01-01 00:00:00' AS ts")
    plan = plan_of(with_neighbours(stays, "visit", "ts", "id", {"before": ("id", 1)}))
    assert "Union" not in plan
    assert plan.count("Range (") == 1
