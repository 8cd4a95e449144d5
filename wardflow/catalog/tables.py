"""The record system's tables in schemas of the catalog."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import SparkSession

from wardflow.sources.ehr import SCHEMAS, EhrTables
from wardflow.sources.scratch import scratch_folder


def publish(t: EhrTables, schema: str, names: Iterable[str] = tuple(SCHEMAS)) -> list[str]:
    """Make tables known in ``schema``: stored ones as views that read them in place, frames as copies."""
    made = list(names)
    for name in made:
        if t.query is not None:
            t.spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} AS {t.query(name)}")
        else:
            t.read(name).write.mode("overwrite").saveAsTable(f"{schema}.{name}")
    return made


#: Tables that are joined and ordered by the visit they belong to.
BY_VISIT = ("hospital_visit", "location_visit", "visit_observation", "lab_order")


def store(t: EhrTables, schema: str, buckets: int, names: Iterable[str] = tuple(SCHEMAS)) -> list[str]:
    """Copy tables into ``schema``, those of ``BY_VISIT`` in buckets by visit, a file for each.

    Joins by visit, and windows over a visit, then take rows as they lie: no exchange.  A bucket is read by
    one task, so choose enough of them; a placeholder visit with very many rows is better left in tables without.
    """
    made = list(names)
    for name in made:
        frame, key = t.read(name), "hospital_visit_id"
        if name in BY_VISIT:
            writer = frame.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        else:
            writer = frame.write
        writer.mode("overwrite").saveAsTable(f"{schema}.{name}")
    return made


def new_schema(spark: SparkSession, label: str) -> str:
    """A schema of this application in the scratch folder; it is dropped when the driver's Python ends."""
    schema = f"{label}_{uuid4().hex[:12]}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{scratch_folder(spark)}/{schema}'")
    atexit.register(_drop, spark, schema)
    return schema


def _drop(spark: SparkSession, schema: str) -> None:
    with contextlib.suppress(Exception):
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
