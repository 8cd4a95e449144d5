"""Written intermediate tables in the folder the cluster names for them."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    Without that setting it lies below the warehouse, which all executors share too.
    The folder is removed when the driver's Python ends.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    path = f"{folder.rstrip('/')}/wardflow-{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_remove, spark.sparkContext, path)
    return path


def _remove(context, path: str) -> None:
    """What can't be removed stays until the folder's owner removes it."""
    with contextlib.suppress(Exception):
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a scratch folder of its own, for ``written`` and ``discarded``."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discarded(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder whose tables nothing will read again."""
    _remove(spark.sparkContext, folder)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as parquet to a new scratch folder, then read: cuts the lineage."""
    path = f"{folder or scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(spark: SparkSession, name: str, origin: str, build) -> DataFrame:
    """``build()`` written as parquet on first use in this application, then read."""
    digest = hashlib.sha256(origin.encode()).hexdigest()[:16]
    path = f"{scratch_folder(spark)}/{digest}/{name}.parquet"
    if path not in _written:
        build().write.mode("overwrite").parquet(path)
        _written.add(path)
    return spark.read.parquet(path)


_written: set[str] = set()
_folders: set[str] = set()
