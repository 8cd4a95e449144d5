"""What must hold on any data, checked on the smallest test tables."""

import pytest
from pyspark.sql import Window, functions as F

from tests.conftest import data_dir
from wardflow.plans.catalog import PIPELINES
from wardflow.sources.bridge import AS_OF, bridge


@pytest.fixture(scope="module")
def tables(spark):
    return bridge(spark, data_dir("0.001"))


def test_open_stays_see_the_count_of_now(tables):
    df = PIPELINES["occupancy"](tables, AS_OF).where("ts IS NULL AND event = 'bed_dc'")
    assert df.count() > 0
    assert df.where("occupancy_raw <> 0").count() == 0


def test_oldest_event_has_the_sum_of_all(tables):
    df = PIPELINES["occupancy"](tables, AS_OF)
    total = df.groupBy("ward").agg(F.sum("census").alias("total"))
    oldest = F.row_number().over(Window.partitionBy("ward").orderBy(F.asc_nulls_last("ts")))
    first = df.withColumn("n", oldest).where("n = 1")
    assert first.join(total, "ward").where("total <> occupancy_raw").count() == 0


def test_census_has_two_events_per_stay(tables):
    df = PIPELINES["census_cc"](tables, AS_OF)
    per_stay = df.groupBy("location_visit_id").agg(
        F.count("*").alias("n"), F.count_distinct("event").alias("kinds")
    )
    assert per_stay.where("n <> 2 OR kinds <> 2").count() == 0


def test_one_death_per_patient(tables):
    deaths = PIPELINES["census_cc"](tables, AS_OF).where("bed_death")
    assert deaths.count() == deaths.select("mrn").distinct().count()
    assert deaths.where("event <> 'bed_in' OR datetime_of_death <= hosp_in").count() == 0


def test_every_bed_is_filled_to_the_end(tables):
    df = PIPELINES["oxygen"](tables, AS_OF)
    spans = df.groupBy("location_string").agg(
        F.min("obs_dt").alias("first"),
        F.max("obs_dt").alias("last"),
        F.count_distinct("obs_dt").alias("n"),
    )
    hours = (F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(
        F.col("first").cast("timestamp"))) / 3600 + 1
    end = F.lit(AS_OF).cast("timestamp_ntz")
    assert spans.count() > 0
    assert spans.where((F.col("last") != end) | (F.col("n") != hours)).count() == 0
    assert df.where("o2_locf IS NULL OR o2_locf < 0").count() == 0
