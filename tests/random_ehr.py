"""Small record-system tables full of awkward rows."""

import datetime as dt
import random

from wardflow.functions import fixed_values as fixed
from wardflow.sources.ehr import SCHEMAS, EhrTables

NOW = dt.datetime(2024, 1, 31)
PLACES = [
    "T03^T03 BY01^BY01-1",
    "T03^T03 BY02^BY02-10",
    "T06C^T06C SR^SR07",
    "ED^ED RESUS^RESUS 2",
    "ED^ED MAJORS^MAJ 3",
    "ED^ED UTC^UTC",
    "ED^RAT PAEDS^RAT 1",
    "EDH^EDH WAIT^WAIT",
    "null^T07CV BY^BY5",
    "T08^T07CV BY^BY6",
    "null^OTHER^null",
    "null^NICU^PD14",
    "WSCC^WSCC CB^CB7",
    "WMS^THEATRE SURGERY^BD8",
    "P03^P03 ENDO^BD8",
    "P03^P03 INR^BD9",
    "P03^P03 CHAIR^BD9",
    "IR^IR^BD1",
    "T01^T01 MRI^NU9",
    "T01^T01 CT^NU1",
    "SINQ^SINQ HR^HR10",
    "MINQ^MINQ HR^HR11A",
    "GWB^MCC CHAIR^CH11",
    "GWB^MCC^DISCHARGE",
    "NHNN^XR SCANNER^POOL",
    "HS15^HS15 BY^BY12A",
    "HS^HS BY^BY00012",
    "T^T BY^BY99999999999",
    "PX1Y22^P BY^BY3",
    "ED^OUTSC TRIAGE^TRIAGE 1",
    "THP3^THP3 THR^BD2",
    "no separators",
    "one^separator",
    "^^",
    "",
    None,
]


def _pick(r, values, missing=0.0):
    return None if r.random() < missing else r.choice(values)


def _time(r, days, missing=0.0):
    """Coarse times, so that ties are frequent."""
    if r.random() < missing:
        return None
    slots = 6 if r.random() < 0.25 else days * 48
    return NOW - dt.timedelta(minutes=30 * r.randrange(slots))


def tables(seed):
    r = random.Random(seed)
    people, visits, stays, observations = 40, 70, 330, 330
    hot = r.randrange(visits)

    def visit():
        return hot if r.random() < 0.34 else _pick(r, range(visits + 4), 0.04)

    rows = {
        "mrn": [
            (i, _pick(r, [f"M{i}", "M0"]), _pick(r, [f"N{i}"], 0.2)) for i in range(people)
        ],
        "mrn_to_live": [
            (i, r.choice([i, r.randrange(people + 2)])) for i in range(people) if r.random() < 0.9
        ],
        "core_demographic": [
            (
                1000 + i,
                i,
                _pick(r, ["Ann", "Bo", ""], 0.3),
                _pick(r, ["Cy", "Di"], 0.2),
                _pick(r, ["F", "M"], 0.1),
                _pick(r, ["NW1"], 0.3),
                _pick(
                    r,
                    [
                        dt.date(2000, 2, 29),
                        dt.date(1999, 1, 31),
                        dt.date(1999, 2, 1),
                        dt.date(1999, 1, 30),
                        dt.date(2024, 1, 31),
                        dt.date(1930, 12, 31),
                    ],
                    0.1,
                ),
                _time(r, 20, 0.5),
            )
            for i in range(people)
            if r.random() < 0.95
        ],
        "hospital_visit": [
            (
                i,
                _pick(r, range(people + 1), 0.05),
                f"E{i}",
                _time(r, 30, 0.1),
                _time(r, 2, 0.1),
                _time(r, 200, 0.7),
                _pick(r, ["EMERGENCY", "INPATIENT", "INPATIENT", "INPATIENT"], 0.03),
                _pick(r, ["Ambulance", "Walk-in"], 0.1),
                _pick(r, ["Home"], 0.5),
                _pick(r, ["EPIC", "EPIC", "EPIC", "WinPath"], 0.05),
            )
            for i in range(visits)
        ],
        "location": list(enumerate(PLACES)),
        "location_visit": [
            (
                i,
                visit(),
                _pick(r, range(len(PLACES) + 2), 0.03),
                _time(r, 9, 0.06),
                _time(r, 9, 0.5),
            )
            for i in r.sample(range(5_000_000), stays)
        ],
        "visit_observation_type": [
            (2281790312, "250026", "EPIC"),
            (2281789816, "301550", "EPIC"),
            (2281790343, "3040109304", "EPIC"),
            (1, "10", "EPIC"),
            (2, "8", None),
            (3, "9999", "EPIC"),
            (4, None, "EPIC"),
            (5, "6466", "EPIC"),
        ],
        "flowsheetrowdim": [
            (code, name, "shown", "short", None, None, None, None, None, None)
            for code, name in [
                ("3040109304", "R OXYGEN DELIVERY METHOD"),
                ("301550", fixed.NIV_FLOWSHEET_ROWS[1]),
                ("10", "PULSE OXIMETRY"),
                ("10", "PULSE OXIMETRY AGAIN"),
                (None, fixed.NIV_FLOWSHEET_ROWS[1]),
            ]
        ],
        "visit_observation": [
            (
                i,
                visit(),
                _time(r, 9, 0.03),
                _pick(r, [2281790312, 2281789816, 2281790343, 1, 2, 3, 4, 5, 99], 0.03),
                _pick(r, [0.0, 2.5, 21.0, 30.0, 50.0, 61.0], 0.3),
                _pick(
                    r,
                    [
                        "High-flow nasal cannula (HFNC)",
                        "CPAP/Bi-PAP mask",
                        "Endotracheal tube",
                        "Nasal cannula",
                        "Room air",
                    ],
                    0.3,
                ),
                _pick(r, ["L/min"], 0.5),
            )
            for i in range(observations)
        ],
        "lab_order": [(i, visit()) for i in range(60)],
        "lab_result": [
            (
                i,
                _pick(r, range(64), 0.05),
                _pick(r, [141462274, 1], 0.1),
                _time(r, 1, 0.1),
                _pick(r, [0.5, 4.0], 0.2),
                "mmol/L",
                _pick(r, ["H"], 0.5),
                None,
            )
            for i in range(120)
        ],
        "all_targets": [
            (
                f"M{i % 7}",
                f"C{i}",
                _pick(r, ["N", "S"], 0.1),
                _time(r, 3, 0.1),
                "BY01",
                _pick(r, [f"B{k}" for k in range(6)], 0.1),
                *[_pick(r, [True, False], 0.3) for _ in range(7)],
            )
            for i in range(30)
        ],
        "t03_bed_grid": [("B1", 1, 1, 1), ("B2", 2, 1, 2), ("B2", 3, 1, 2), (None, 9, 9, 9)],
    }
    return rows


def load(spark, duck, seed):
    """The same rows as Spark tables and in a DuckDB connection."""
    return from_rows(spark, duck, tables(seed))


def from_rows(spark, duck, rows_by_table):
    frames = {}
    for name, schema in SCHEMAS.items():
        frames[name] = spark.createDataFrame(rows_by_table.get(name, []), schema)
        duck.register(f"arrow_{name}", frames[name].toArrow())
        duck.execute(f"CREATE TABLE {name} AS SELECT * FROM arrow_{name}")
    return EhrTables.from_frames(spark, frames)
