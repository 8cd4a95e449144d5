"""Ward occupancy kept up to date while bed moves arrive, with late moves set aside and put right.

The state of the stream is keyed by ward and kept in tables: the occupancy up to a horizon, behind
which results are final, and the moves after it, which wait.  The horizon follows the latest move at a
given distance.  A micro-batch appends the final instants of each ward with the occupancy before them, in the
time-slot operators of the batch pipelines, so a ward with a third of all moves is no single task.  A move that
arrives behind the horizon changes nothing that is final: it goes to a table of late moves.  Readers get the
final instants as they were given out, or all of them put right: wards with late moves are summed anew.

Every table of a micro-batch is a folder named by its number and replaced if it is run again, and it reads
those of the one before only, so that a restart repeats the same work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wardflow.operators.joins import null_safe_join
from wardflow.operators.prefix import running_total
from wardflow.sources.scratch import discarded

MOVE = "ward STRING, ts TIMESTAMP_NTZ, census INT"
INSTANT = "ward STRING, ts TIMESTAMP_NTZ, net LONG, occupancy LONG"
BALANCE = "ward STRING, balance LONG"
CLOCK = "horizon TIMESTAMP_NTZ"


def occupancy_before(moves: DataFrame, balance: DataFrame) -> DataFrame:
    """``INSTANT``: each ward's moves by instant, with the occupancy before them.

    ``balance`` has ``ward, balance``, the occupancy before the first move; a ward that isn't in it
    begins with 0.
    """
    net = F.sum("census").cast("long").alias("net")
    instants = moves.groupBy("ward", "ts").agg(net)
    all_moves = moves.groupBy("ward").agg(F.sum("census").cast("long").alias("all"))
    # the sum of what comes at or after an instant, taken from all, is what came before
    later = running_total(moves, "ward", "ts", F.col("census"), "later")
    found = null_safe_join(instants, later, ["ward", "ts"], "inner")
    found = null_safe_join(found, all_moves, ["ward"], "inner")
    found = null_safe_join(found, balance, ["ward"], "left")
    before = F.coalesce("balance", F.lit(0)) + F.col("all") - F.col("later")
    return found.select("ward", "ts", "net", before.cast("long").alias("occupancy"))


class _Folder:
    """The tables of a stream's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def of(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(self.of(name, batch))

    def read(self, name: str, batch: int, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.of(name, batch))

    def all(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").select(*(c.split()[0] for c in schema.split(", ")))


def _advance(folder: _Folder, moves: DataFrame, batch: int, late: str) -> None:
    """One micro-batch: what becomes final, what waits, what is late, and the state after it."""
    folder.write(moves.select("ward", "ts", "census"), "incoming", batch)
    incoming = folder.read("incoming", batch, MOVE)
    horizon = folder.read("clock", batch - 1, CLOCK).first()[0]
    newest = incoming.agg((F.max("ts") - F.expr(f"INTERVAL {late}")).alias("t")).first()["t"]
    new_horizon = max((x for x in (horizon, newest) if x is not None), default=None)
    in_time = F.lit(horizon is None) | (F.col("ts") >= F.lit(horizon).cast("timestamp_ntz"))
    folder.write(incoming.where(~in_time), "late", batch)
    waiting = folder.read("waiting", batch - 1, MOVE).unionByName(incoming.where(in_time))
    is_final = F.col("ts") < F.lit(new_horizon).cast("timestamp_ntz")
    balance = folder.read("balance", batch - 1, BALANCE)
    folder.write(occupancy_before(waiting.where(is_final), balance), "final", batch)
    folder.write(waiting.where(F.coalesce(~is_final, F.lit(True))), "waiting", batch)
    net = folder.read("final", batch, INSTANT).groupBy("ward").agg(F.sum("net").alias("balance"))
    after = balance.unionByName(net).groupBy("ward").agg(F.sum("balance").cast("long").alias("balance"))
    folder.write(after, "balance", batch)
    folder.write(folder.spark.createDataFrame([(new_horizon,)], CLOCK), "clock", batch)
    for name in ("incoming",):
        discarded(folder.spark, folder.of(name, batch))


def start_occupancy(
    moves: DataFrame, anchors: DataFrame, path: str, checkpoint: str, late: str = "2 HOURS", trigger: dict | None = None
) -> StreamingQuery:
    """Follow a stream of ``ward, ts, census`` from ``anchors`` (``ward, occupied``) on, into the folder ``path``.

    Moves up to ``late`` behind the newest one are waited for.  By default the stream ends when its source
    has no more rows.
    """
    spark = moves.sparkSession
    folder = _Folder(spark, path)
    start = anchors.select("ward", F.col("occupied").cast("long").alias("balance"))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder.of("clock", -1))
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        folder.write(start, "balance", -1)
        folder.write(spark.createDataFrame([], MOVE), "waiting", -1)
        folder.write(spark.createDataFrame([(None,)], CLOCK), "clock", -1)
    return (
        moves.writeStream.foreachBatch(lambda df, batch: _advance(folder, df, batch, late))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def final_occupancy(spark: SparkSession, path: str) -> DataFrame:
    """``INSTANT`` of all final instants, as they were given out."""
    return _Folder(spark, path).all("final", INSTANT)


def late_moves(spark: SparkSession, path: str) -> DataFrame:
    return _Folder(spark, path).all("late", MOVE)


def current_occupancy(spark: SparkSession, path: str, last_batch: int) -> DataFrame:
    """All instants so far: those that wait are added, and the wards with late moves are summed anew."""
    folder = _Folder(spark, path)
    final, late = final_occupancy(spark, path), late_moves(spark, path)
    waiting = folder.read("waiting", last_batch, MOVE)
    added = occupancy_before(waiting, folder.read("balance", last_batch, BALANCE))
    touched = late.select(F.col("ward").alias("late_ward")).distinct()
    is_touched = F.col("ward").eqNullSafe(F.col("late_ward"))
    right = final.unionByName(added).join(touched, is_touched, "left_anti")
    again = (
        final.select("ward", "ts", F.col("net").alias("census"))
        .unionByName(late)
        .unionByName(waiting)
        .join(touched, is_touched, "left_semi")
    )
    return right.unionByName(occupancy_before(again, folder.read("balance", -1, BALANCE)))
