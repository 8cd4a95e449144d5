"""The stream gives the batch result for every hour that is final."""

import datetime as dt

from pyspark.sql import functions as F

from tests.compare import spark_rows
from wardflow.sources.ehr import SCHEMAS
from wardflow.streaming.bed_flow import bed_moves, hourly_flow, start_hourly_flow
from wardflow.streaming.occupancy_stream import (
    MOVE,
    current_occupancy,
    final_occupancy,
    late_moves,
    occupancy_before,
    start_occupancy,
)

DAY = dt.datetime(2024, 1, 1)


def minute(n):
    return DAY + dt.timedelta(minutes=n)


def test_stream_equals_batch(spark, tmp_path):
    stays = [
        (i, i % 5, i % 3, minute(17 * i), None if i % 4 == 0 else minute(17 * i + 40))
        for i in range(200)
    ]
    source = str(tmp_path / "stays")
    for start in range(0, 200, 50):
        spark.createDataFrame(
            stays[start : start + 50], SCHEMAS["location_visit"]
        ).coalesce(1).write.mode("append").parquet(source)
    wards = spark.createDataFrame([(0, "A"), (1, "B"), (2, "C")], "location_id long, ward string")
    batch = hourly_flow(bed_moves(spark.read.parquet(source), wards))

    stream = (
        spark.readStream.schema(SCHEMAS["location_visit"])
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(source)
    )
    out = str(tmp_path / "flow")
    query = start_hourly_flow(bed_moves(stream, wards), out, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    final = spark.read.parquet(out)
    last = final.agg(F.max("hour")).first()[0]
    assert last > DAY + dt.timedelta(hours=40)
    assert spark_rows(final) == spark_rows(batch.where(F.col("hour") <= last))
    total = batch.agg(F.sum("net_change")).first()[0]
    assert total == sum(s[4] is None for s in stays)


MOVES = [(ward, minute(7 * i + k), 1 if (i + k) % 3 else -1) for i in range(120) for k, ward in enumerate(["A", "B", None])]


def parts_of_a_stream(spark, folder, parts):
    """One file for each part, in this order."""
    for part in parts:
        spark.createDataFrame(part, MOVE).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(MOVE).option("maxFilesPerTrigger", 1).parquet(folder)


def by_hand(moves, anchors):
    """(ward, ts, net, occupancy before)"""
    out = []
    for ward, ts in sorted({m[:2] for m in moves}, key=str):
        own = [m for m in moves if m[0] == ward]
        out.append((ward, ts, sum(m[2] for m in own if m[1] == ts), anchors.get(ward, 0) + sum(m[2] for m in own if m[1] < ts)))
    return sorted(out, key=str)


def followed(spark, tmp_path, parts, anchors):
    stream = parts_of_a_stream(spark, str(tmp_path / "moves"), parts)
    start = spark.createDataFrame(list(anchors.items()), "ward string, occupied long")
    out = str(tmp_path / "occupancy")
    query = start_occupancy(stream, start, out, str(tmp_path / "checkpoint"))
    assert query.awaitTermination(240) and query.exception() is None
    return out


def rows(df):
    return sorted(map(tuple, df.select("ward", "ts", "net", "occupancy").collect()), key=str)


def test_occupancy_before(spark):
    anchors = {"A": 5, None: 2, "unused": 9}
    balance = spark.createDataFrame(list(anchors.items()), "ward string, balance long")
    moves = MOVES + MOVES[:9] + [("C", minute(3), 1)] * 3
    assert rows(occupancy_before(spark.createDataFrame(moves, MOVE), balance)) == by_hand(moves, anchors)
    assert not rows(occupancy_before(spark.createDataFrame([], MOVE), balance))


def test_stream_in_order_gives_the_batch_occupancy(spark, tmp_path):
    anchors = {"A": 5, "B": 1}
    out = followed(spark, tmp_path, [MOVES[at : at + 90] for at in range(0, 360, 90)], anchors)
    want = by_hand(MOVES, anchors)
    assert not late_moves(spark, out).count()
    assert rows(current_occupancy(spark, out, 3)) == want
    # what is final is final to within the two hours that are waited for
    horizon = max(m[1] for m in MOVES) - dt.timedelta(hours=2)
    assert rows(final_occupancy(spark, out)) == [r for r in want if r[1] < horizon]


def test_late_moves_are_set_aside_and_put_right(spark, tmp_path):
    anchors = {"A": 5, "B": 1}
    held_back = [m for i, m in enumerate(MOVES) if m[0] == "A" and i % 21 == 0]
    on_time = [m for m in MOVES if m not in held_back]
    # the second part comes a little late, which is waited for; what was held back comes last
    parts = [on_time[:150], on_time[160:], on_time[150:160] + held_back]
    out = followed(spark, tmp_path, parts, anchors)
    late = late_moves(spark, out).collect()
    assert held_back[0] in [tuple(r) for r in late]
    assert rows(current_occupancy(spark, out, 2)) == by_hand(MOVES, anchors)
    # wards without late moves were right at once
    wards = {r["ward"] for r in late}
    final = rows(final_occupancy(spark, out))
    assert [r for r in final if r[0] not in wards] == [r for r in by_hand(MOVES, anchors) if r in final and r[0] not in wards]


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    anchors = {"A": 5}
    followed(spark, tmp_path, [MOVES[:150]], anchors)
    out = followed(spark, tmp_path, [MOVES[150:]], {"A": 77})
    assert rows(current_occupancy(spark, out, 1)) == by_hand(MOVES, anchors)


def test_hourly_flow_drops_what_comes_after_the_watermark(spark, tmp_path):
    source = str(tmp_path / "moves")
    late = ("A", minute(1), 1)
    on_time = [m for m in MOVES if m[0] == "A"]
    for part in (on_time[:60], on_time[60:], [late]):
        spark.createDataFrame(part, MOVE).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(MOVE).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "flow")
    start_hourly_flow(stream, out, str(tmp_path / "checkpoint")).awaitTermination(120)
    found = spark.read.parquet(out)
    want = hourly_flow(spark.createDataFrame(on_time, MOVE))
    assert found.count() and spark_rows(found) == spark_rows(want.join(found.select("hour"), "hour", "left_semi").select(found.columns))
