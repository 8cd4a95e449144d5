"""Operators against brute force, on hand-made edge rows and on one hot key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.compare import spark_rows
from wardflow.operators.asof import asof_join
from wardflow.operators.joins import null_safe_join
from wardflow.operators.locf import hold_until_next, hour_grid, last_known
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.observations import pivot_observations
from wardflow.operators.prefix import running_total, with_running_totals
from wardflow.plans.census import death_stays
from wardflow.plans.oxygen import READINGS

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + dt.timedelta(minutes=minutes)


def moves(seed, n=400):
    r = random.Random(seed)
    return [
        (
            r.choice(["A", "A", "A", "B", None]),
            at(r.choice([None, 0, 1, 59, 60, 61, 5000, r.randrange(9000)])),
            r.choice([-1, 0, 1]),
        )
        for _ in range(n)
    ]


def brute_total(rows):
    """Newest first, open times before all others, equal times together."""
    later = lambda other, own: other is None or (own is not None and other >= own)
    return [
        (g, t, sum(v for g2, t2, v in rows if g2 == g and later(t2, t))) for g, t, _ in rows
    ]


@pytest.mark.parametrize("slot", [1, 15, 60, 100_000])
def test_running_totals(spark, slot):
    rows = moves(slot)
    df = spark.createDataFrame(rows, "g string, ts timestamp_ntz, v int")
    expected = brute_total(rows)
    single = running_total(df, "g", "ts", F.col("v"), slot=slot)
    assert {tuple(r) for r in single.collect()} == set(expected)
    both = with_running_totals(
        df.withColumn("h", F.lit(1)),
        df.withColumn("h", F.lit(1)),
        "ts",
        "v",
        {"by_g": "g", "by_h": "h"},
        slot=slot,
    )
    assert sorted(
        ((r.g, r.ts, r.by_g) for r in both.collect()), key=str
    ) == sorted(expected, key=str)
    whole = brute_total([(1, t, v) for _, t, v in rows])
    assert sorted(((1, r.ts, r.by_h) for r in both.collect()), key=str) == sorted(whole, key=str)


def stays(seed, n=300):
    r = random.Random(seed)
    ids = r.sample(range(3_000_000), n)
    return [
        (i, r.choice([7, 7, 8, 9]), at(r.choice([None, 3, r.randrange(500)])), r.randrange(6))
        for i in ids
    ]


STAY = "id long, k long, ts timestamp_ntz, place long"
SHIFTS = {"a": ("place", 1), "b": ("place", -1), "c": ("place", 2), "d": ("place", -2)}


def brute_neighbours(rows):
    """Lag and lead by hand, rows of a key in order of time (none last) and id."""
    out = []
    for key in {s[1] for s in rows}:
        own = sorted((s for s in rows if s[1] == key), key=lambda s: (s[2] is None, s[2] or T0, s[0]))
        place = lambda i: own[i][3] if 0 <= i < len(own) else None
        out += [(*s, place(i - 1), place(i + 1), place(i - 2), place(i + 2)) for i, s in enumerate(own)]
    return out


@pytest.mark.parametrize("slot, block", [(1, 1), (7, 1000), (15, 200_000), (60, 10**6), (100_000, 10**7)])
@pytest.mark.parametrize("keys", [[7, 7, 8, 9, None], [None], list(range(200))])
def test_neighbours_across_cells(spark, slot, block, keys):
    r = random.Random(slot)
    rows = [(i, r.choice(keys), t, p) for i, _, t, p in stays(slot)]
    found = with_neighbours(spark.createDataFrame(rows, STAY), "k", "ts", "id", SHIFTS, slot, block)
    key = lambda row: (row[0], str(row))
    assert sorted((tuple(x) for x in found.collect()), key=key) == sorted(brute_neighbours(rows), key=key)


def test_single_stay_has_no_neighbours(spark):
    df = spark.createDataFrame([(1, 1, at(0), 5)], STAY)
    row = with_neighbours(df, "k", "ts", "id", SHIFTS).first()
    assert (row.a, row.b, row.c, row.d) == (None, None, None, None)


ASOF = dict(key="k", event_time="t", state_time="since", state_id="s", payload=["p"])


@pytest.mark.parametrize("slot", [1, 15, 1000])
def test_asof(spark, slot):
    states = [(1, at(10), 1, "x"), (1, at(20), 3, "tie"), (1, at(20), 2, "y"), (2, at(5), 4, "z"), (None, at(1), 5, "n"), (1, None, 6, "m")]
    times = [(1, 9), (1, 10), (1, 19), (1, 20), (1, 99), (2, 5), (3, 1), (None, 7), (1, None)]
    events = [(i, k, at(m)) for i, (k, m) in enumerate(times)]
    found = asof_join(
        spark.createDataFrame(events, "e long, k long, t timestamp_ntz"),
        spark.createDataFrame(states, "k long, since timestamp_ntz, s long, p string"),
        **ASOF,
        slot=slot,
    )
    expected = {(1, "x"), (2, "x"), (3, "tie"), (4, "tie"), (5, "z")}
    assert {(r.e, r.p) for r in found.collect()} == expected


@pytest.mark.parametrize("slot", [1, 15, 240])
def test_asof_on_a_hot_key(spark, slot):
    r = random.Random(5)
    states = [(r.choice([1, 1, 2]), at(r.randrange(900)), i, r.choice([None, f"p{i}"])) for i in range(150)]
    events = [(i, r.choice([1, 1, 2]), at(r.randrange(900))) for i in range(300)]
    left = spark.createDataFrame(events, "e long, k long, t timestamp_ntz")
    right = spark.createDataFrame(states, "k long, since timestamp_ntz, s long, p string")
    found = {(x.e, x.p) for x in asof_join(left, right, **ASOF, slot=slot).collect()}
    brute = set()
    for e, k, t in events:
        earlier = [(s[1], s[2], s[3]) for s in states if s[0] == k and s[1] <= t]
        if earlier:
            brute.add((e, max(earlier, key=lambda s: s[:2])[2]))
    assert found == brute


def test_pivot_takes_the_last_reading(spark):
    flow, fraction, device = (kind for kind, _ in READINGS.values())
    rows = [
        (1, 1, at(0), flow, 2.0, None),
        (2, 1, at(0), flow, 3.0, None),
        (3, 1, at(1), device, None, "Nasal cannula"),
        (4, 1, at(2), fraction, 0.0, None),
        (5, 2, at(2), flow, 4.0, None),
        (6, 2, at(2), flow, None, None),
    ]
    df = spark.createDataFrame(
        rows,
        "visit_observation_id long, hospital_visit_id long, observation_datetime timestamp_ntz,"
        " visit_observation_type_id long, value_as_real double, value_as_text string",
    )
    found = {tuple(r) for r in pivot_observations(df, READINGS).collect()}
    assert found == {
        (1, at(0), 3.0, None, None),
        (1, at(1), None, None, "Nasal cannula"),
        (1, at(2), None, 0.0, None),
        (2, at(2), None, None, None),
    }


def test_grid_and_carry_forward_agree(spark):
    now = "2024-01-08 00:00:00"
    known = spark.createDataFrame(
        [("b", at(60 * 3), 0.0), ("b", at(60 * 7), 5.0), ("c", at(60 * 24 * 7), 1.0)],
        "k string, h timestamp_ntz, v double",
    )
    grid = hour_grid(known.select("k").distinct(), now, "7 DAYS", "h")
    assert grid.count() == 2 * 169
    on_grid = grid.join(known, ["k", "h"], "left").withColumn("v", last_known("v", "k", "h"))
    last = F.lit(now).cast("timestamp_ntz")
    held = known.unionByName(hold_until_next(known, "k", "h", last))
    assert spark_rows(on_grid.where("v is not null")) == spark_rows(held)
    kept = on_grid.join(known.withColumnRenamed("v", "own"), ["k", "h"])
    assert kept.where("own <> v").count() == 0


def test_death_stay(spark):
    schema = (
        "mrn string, datetime_of_death timestamp_ntz, bed_in timestamp_ntz,"
        " location_visit_id long, core_demographic_id long, hospital_visit_id long"
    )
    rows = [
        ("two stays", at(100), at(10), 1, 1, 1),
        ("two stays", at(100), at(90), 2, 1, 1),
        ("after death", at(100), at(90), 3, 2, 2),
        ("after death", at(100), at(110), 4, 2, 2),
        ("living", None, at(10), 5, 3, 3),
        ("tie", at(100), at(50), 7, 4, 4),
        ("tie", at(100), at(50), 6, 4, 4),
        ("no time", at(100), None, 8, 5, 5),
        ("no time", at(100), at(200), 9, 5, 5),
    ]
    found = {r.death_stay_id for r in death_stays(spark.createDataFrame(rows, schema)).collect()}
    assert found == {2, 4, 6, 9}


def test_null_safe_join(spark):
    left = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 30)], "k string, y int")
    found = {(r.x, r.y) for r in null_safe_join(left, right, ["k"], "left").collect()}
    assert found == {(1, 10), (2, None), (3, 30)}
