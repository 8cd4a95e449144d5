import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def data_dir(sf):
    return f"/root/testdata/sf{sf}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("wardflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """sf directory -> DuckDB connection with the test tables as views."""
    import duckdb

    open_connections = {}

    def connect(directory):
        if directory not in open_connections:
            connection = duckdb.connect()
            for name in TABLES:
                connection.execute(
                    f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'"
                )
            open_connections[directory] = connection
        return open_connections[directory]

    return connect
