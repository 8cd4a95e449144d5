"""The occupancy table that is refreshed by date equals one that is built anew."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from tests.random_ehr import load
from wardflow.plans import incremental
from wardflow.plans.occupancy import occupancy
from wardflow.sources.ehr import EhrTables

AS_OF = "2024-01-31 00:00:00"


def changed_tables(t, **frames):
    return EhrTables(t.spark, lambda name: frames[name] if name in frames else t.read(name))


def files(path):
    """Folder of a date -> its files."""
    return {d: sorted(os.listdir(f"{path}/events/{d}")) for d in os.listdir(f"{path}/events") if d.startswith("day=")}


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, duckdb.connect(), 31)


def check(spark, t, path, as_of=AS_OF):
    done = incremental.refresh_occupancy(t, path, as_of)
    assert spark_rows(incremental.read_occupancy(spark, path)) == spark_rows(occupancy(t))
    return done


def test_refreshes(spark, tables, tmp_path):
    path = str(tmp_path / "occupancy")
    first = check(spark, tables, path)
    assert first.days_replaced == first.days > 5
    built = files(path)
    # nothing changed: nothing is written
    assert check(spark, tables, path).days_replaced == 0
    assert files(path) == built
    # one bed stay in the past, from one date into the next: what lies before and after is left alone
    stays = tables.location_visit
    some = (
        stays.join(tables.location, "location_id")
        .where("location_string LIKE '%^BY%' AND hospital_visit_id IS NOT NULL AND admission_time IS NOT NULL")
        .join(occupancy(tables).select("ward", "location_visit_id").distinct(), "location_visit_id")
        .orderBy("admission_time", "location_visit_id")
        .select(*stays.columns)
        .first()
    )
    late = spark.createDataFrame(
        [(999_999, some["hospital_visit_id"], some["location_id"], some["admission_time"], some["admission_time"])], stays.schema
    )
    more = changed_tables(tables, location_visit=stays.unionByName(late))
    done = check(spark, more, path)
    assert 0 < done.days_replaced < done.days
    now = files(path)
    assert sum(now[d] != built.get(d) for d in now) == done.days_replaced
    # and gone again
    back = check(spark, tables, path, "2024-02-01 00:00:00")
    assert back.days_replaced == done.days_replaced
    log = incremental.runs(spark, path).orderBy("run").collect()
    assert [(r["run"], r["days_replaced"]) for r in log] == [(1, first.days), (2, 0), (3, done.days_replaced), (4, back.days_replaced)]
    assert log[-1]["as_of"] == "2024-02-01 00:00:00"


def test_other_changes(spark, tables, tmp_path):
    path = str(tmp_path / "occupancy")
    check(spark, tables, path)
    stays = tables.location_visit
    # all discharges undone: beds in use now change, dates vanish
    check(spark, changed_tables(tables, location_visit=stays.withColumn("discharge_time", F.lit(None).cast("timestamp_ntz"))), path)
    # another name for a place, the same times
    renamed = tables.location.withColumn("location_string", F.regexp_replace("location_string", "BY", "BX"))
    check(spark, changed_tables(tables, location=renamed), path)
    check(spark, changed_tables(tables, location_visit=stays.limit(0)), path)
    check(spark, tables, path)


def test_a_refresh_that_broke_off_is_made_up_for(spark, tables, tmp_path, monkeypatch):
    path = str(tmp_path / "occupancy")
    check(spark, tables, path)
    fewer = changed_tables(tables, location_visit=tables.location_visit.where("location_visit_id % 3 > 0"))
    with monkeypatch.context() as patch:
        patch.setattr(incremental, "Refresh", None)
        with pytest.raises(TypeError):
            incremental.refresh_occupancy(fewer, path, AS_OF)
    assert check(spark, fewer, path).run == 2
