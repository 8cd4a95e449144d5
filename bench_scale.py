"""Wall seconds of the time-ordered operators on made bed stays with one hot visit; prints one JSON line.

BENCH_ROWS is the number of stays (20 million), BENCH_CPUS the local cores.  The stays begin over a year,
in microseconds, in 104 wards; a third of them are of one visit.  'one window' is what each operator replaces.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bench import session
from wardflow.operators.asof import asof_join
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.prefix import with_running_totals

YEAR = 365 * 86_400


def stays(spark: SparkSession, rows: int) -> DataFrame:
    seconds = F.col("draw") * YEAR
    return (
        spark.range(rows, numPartitions=64)
        .withColumns({"draw": F.rand(7), "owner": F.rand(8)})
        .select(
            F.col("id").alias("location_visit_id"),
            F.when(F.col("owner") < 1 / 3, -1).otherwise((F.col("owner") * rows / 6).cast("long")).alias("hospital_visit_id"),
            F.concat(F.lit("W"), F.col("id") % 104).alias("ward"),
            (F.col("id") % 9 == 0).alias("critical_care"),
            (F.lit("2023-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).alias("ts"),
            F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("census"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"),
        )
    )


def main() -> None:
    rows = int(os.environ.get("BENCH_ROWS", "20000000"))
    scratch = tempfile.TemporaryDirectory(prefix="scale-")
    spark = session(os.environ.get("BENCH_CPUS", "8"), scratch.name)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    path = f"{scratch.name}/stays.parquet"
    stays(spark, rows).write.parquet(path)
    table = spark.read.parquet(path)
    sums = {"ward_sum": "ward", "care_sum": "critical_care"}
    order = lambda key: Window.partitionBy(key).orderBy("ts", "location_visit_id")
    backwards = lambda key: Window.partitionBy(key).orderBy(F.desc("ts"))
    asked = table.where("location_visit_id % 4 = 0").select("hospital_visit_id", F.col("ts").alias("at"), "payload")
    runs = {
        "running sums, one window each": lambda: table.withColumns({n: F.sum("census").over(backwards(g)) for n, g in sums.items()}),
        "running sums, by slot and joined": lambda: with_running_totals(table, table, "ts", "census", sums),
        "neighbours, one window": lambda: table.withColumn("before", F.lag("ward").over(order("hospital_visit_id"))),
        "neighbours, by cell": lambda: with_neighbours(table, "hospital_visit_id", "ts", "location_visit_id", {"before": ("ward", 1)}),
        "as-of join, by slot": lambda: asof_join(asked, table.drop("payload"), "hospital_visit_id", "at", "ts", "location_visit_id", ["ward"]),
    }
    found = {}
    for name, run in runs.items():
        if sys.argv[1:] and not any(word in name for word in sys.argv[1:]):
            continue
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - start, 1)
        print(name, found[name], file=sys.stderr, flush=True)
    print(json.dumps({"rows": rows, "seconds": found}))
    spark.stop()
    scratch.cleanup()


if __name__ == "__main__":
    main()
