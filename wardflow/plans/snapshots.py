"""Results written as tables, to be rebuilt for any as-of time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.plans.catalog import PIPELINES
from wardflow.sources.ehr import EhrTables


def write_snapshot(df: DataFrame, path: str, partition_by: str = "ward") -> None:
    """Replace the snapshot at ``path``, one folder per ward; without that column, undivided.

    The folder is named by a copy of the column: a folder name cannot tell an empty
    text from a missing one.
    The rebalance hint brings the rows of a ward together, splits the shuffle
    partitions of large wards and merges those of small ones, so neither one
    task per ward nor one file per task and ward is the outcome.
    """
    if partition_by not in df.columns:
        df.write.mode("overwrite").parquet(path)
        return
    folder = f"{partition_by}_folder"
    name = F.coalesce(F.nullif(F.col(partition_by), F.lit("")), F.lit("none"))
    df.withColumn(folder, name).hint("rebalance", folder).write.mode(
        "overwrite"
    ).partitionBy(folder).parquet(path)


def read_snapshot(spark: SparkSession, path: str, schema) -> DataFrame:
    """The snapshot with the column types it was written with."""
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def refresh_snapshot(
    t: EhrTables, name: str, root: str, as_of: datetime | str, partition_by: str = "ward"
) -> str:
    """Rebuild one pipeline for a given time; running it again gives the same folder."""
    path = f"{root.rstrip('/')}/{name}/as_of={str(as_of).replace(' ', 'T').replace(':', '')}"
    write_snapshot(PIPELINES[name](t, as_of), path, partition_by)
    return path
