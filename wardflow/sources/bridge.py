"""The record system's tables derived from the synthetic test tables.

Every row of the source tables is used.  The one table that needs ordering,
``location_visit``, is written once per application; the others are plain
projections that Spark folds into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.operators.neighbours import with_neighbours
from wardflow.sources.ehr import EhrTables, columns_of
from wardflow.sources.scratch import written_once

AS_OF = "2024-01-31 00:00:00"
_NOW = f"TIMESTAMP_NTZ'{AS_OF}'"
_HOURS = "INTERVAL '1' HOUR"
_DAYS = "INTERVAL '1' DAY"

# table -> (test table, {column: expression})
PROJECTIONS: dict[str, tuple[str, dict[str, str]]] = {
    "mrn": (
        "customer",
        {
            "mrn_id": "c_custkey",
            "mrn": "c_name",
            "nhs_number": "CASE WHEN c_custkey % 13 <> 0 THEN concat('NHS', c_custkey) END",
        },
    ),
    "mrn_to_live": (
        "customer",
        {
            "mrn_id": "c_custkey",
            "live_mrn_id": "CASE WHEN c_custkey % 10 = 9 THEN c_custkey - 1 ELSE c_custkey END",
        },
    ),
    "core_demographic": (
        "customer",
        {
            "core_demographic_id": "c_custkey + 1000000",
            "mrn_id": "c_custkey",
            "firstname": "CASE WHEN c_custkey % 17 <> 0 THEN c_mktsegment END",
            "lastname": "c_name",
            "sex": "CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END",
            "home_postcode": "c_nationkey",
            "date_of_birth": "DATE'1930-01-15' + CAST(c_custkey * 37 % 30000 AS INT)",
            "datetime_of_death": (
                "CASE WHEN c_custkey % 20 = 0 THEN"
                f" TIMESTAMP_NTZ'2024-01-20 00:00:00' + {_HOURS} * (c_custkey % 240) END"
            ),
        },
    ),
    "hospital_visit": (
        "orders",
        {
            "hospital_visit_id": "o_orderkey",
            "mrn_id": "o_custkey",
            "encounter": "concat('E', o_orderkey)",
            "admission_time": (
                "CASE WHEN o_orderkey % 19 <> 0 THEN"
                f" TIMESTAMP_NTZ'2023-12-31 00:00:00' + {_HOURS} * (o_orderkey % 24) END"
            ),
            "presentation_time": f"{_NOW} - {_HOURS} * (o_orderkey % 72)",
            "discharge_time": (
                f"CASE WHEN o_orderstatus = 'F' THEN {_NOW} - {_DAYS} * (o_orderkey % 500) END"
            ),
            "patient_class": (
                "CASE o_orderpriority WHEN '1-URGENT' THEN 'EMERGENCY'"
                " WHEN '5-LOW' THEN 'OUTPATIENT' ELSE 'INPATIENT' END"
            ),
            "arrival_method": "CASE WHEN o_orderstatus = 'P' THEN 'Ambulance' ELSE 'Walk-in' END",
            "discharge_disposition": "CASE WHEN o_orderstatus = 'F' THEN 'Home' END",
            "source_system": "CASE WHEN o_orderkey % 11 = 0 THEN 'WinPath' ELSE 'EPIC' END",
        },
    ),
    "location": (
        "part",
        {
            "location_id": "p_partkey",
            "location_string": (
                "CASE p_partkey % 16"
                " WHEN 0 THEN concat('T03^T03 BY01^BY01-', p_partkey)"
                " WHEN 1 THEN concat('T06C^T06C SR^SR', p_partkey)"
                " WHEN 2 THEN concat('ED^ED RESUS^RESUS ', p_partkey)"
                " WHEN 3 THEN concat('ED^ED MAJORS^MAJ ', p_partkey)"
                " WHEN 4 THEN 'EDH^EDH WAIT^WAIT'"
                " WHEN 5 THEN concat('null^T07CV BY^BY', p_partkey)"
                " WHEN 6 THEN 'null^OTHER^null'"
                " WHEN 7 THEN concat('WSCC^WSCC CB^CB', p_partkey)"
                " WHEN 8 THEN concat('P03^P03 ENDO^BD', p_partkey)"
                " WHEN 9 THEN concat('T01^T01 MRI^NU', p_partkey)"
                " WHEN 10 THEN concat('SINQ^SINQ HR^HR', p_partkey)"
                " WHEN 11 THEN concat('GWB^MCC CHAIR^CH', p_partkey)"
                " WHEN 12 THEN 'IMG^IMG CT^POOL'"
                " WHEN 13 THEN concat('HS15^HS15 BY^BY', p_partkey, 'A')"
                " WHEN 14 THEN concat('null^NICU^PD', p_partkey)"
                " ELSE concat('ED^OUTSC TRIAGE^TRIAGE ', p_partkey) END"
            ),
        },
    ),
    "visit_observation": (
        "events",
        {
            "visit_observation_id": "event_id",
            "hospital_visit_id": "user_id",
            "observation_datetime": "ts",
            "visit_observation_type_id": (
                f"CASE event_type WHEN 'purchase' THEN {fixed.O2_FLOW_TYPE}"
                f" WHEN 'signup' THEN {fixed.O2_FRACTION_TYPE}"
                f" WHEN 'error' THEN {fixed.O2_DEVICE_TYPE}"
                " WHEN 'view' THEN 1 ELSE 2 END"
            ),
            "value_as_real": "CASE WHEN event_type <> 'error' THEN value END",
            "value_as_text": (
                "CASE WHEN event_type = 'error' THEN CASE event_id % 7"
                " WHEN 0 THEN 'High-flow nasal cannula (HFNC)' WHEN 1 THEN 'CPAP/Bi-PAP mask'"
                " WHEN 2 THEN 'Endotracheal tube' WHEN 3 THEN 'Tracheostomy'"
                " WHEN 4 THEN 'Non-rebreather mask' WHEN 5 THEN 'Nasal cannula'"
                " ELSE 'Room air' END END"
            ),
            "unit": "CASE WHEN event_type = 'purchase' THEN 'L/min' END",
        },
    ),
    "visit_observation_type": (
        "part",
        {
            "visit_observation_type": (
                f"CASE p_partkey WHEN 0 THEN {fixed.O2_FLOW_TYPE}"
                f" WHEN 1 THEN {fixed.O2_FRACTION_TYPE} WHEN 2 THEN {fixed.O2_DEVICE_TYPE}"
                " WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE p_partkey END"
            ),
            "id_in_application": (
                "CASE p_partkey WHEN 0 THEN '250026' WHEN 1 THEN '301550'"
                " WHEN 2 THEN '3040109304' WHEN 3 THEN '10' WHEN 4 THEN '8'"
                " ELSE concat('P', p_partkey) END"
            ),
            "source_application": "CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE 'EPIC' END",
        },
    ),
    "flowsheetrowdim": (
        "part",
        {
            "flowsheetrowepicid": (
                "CASE p_partkey WHEN 1 THEN '301550' WHEN 2 THEN '3040109304' WHEN 3 THEN '10'"
                " ELSE CASE WHEN p_size % 2 = 0 THEN concat('P', p_partkey)"
                " ELSE concat('X', p_partkey) END END"
            ),
            "name": (
                f"CASE p_partkey WHEN 1 THEN '{fixed.NIV_FLOWSHEET_ROWS[1]}'"
                f" WHEN 2 THEN '{fixed.OXYGEN_DELIVERY_ROW}' WHEN 3 THEN 'PULSE OXIMETRY'"
                " ELSE p_name END"
            ),
            "displayname": "p_name",
            "abbreviation": "p_brand",
            "valuetype": "p_type",
            "rowtype": "NULL",
            "unit": "NULL",
            "description": "NULL",
            "iscalculated": "CASE WHEN p_size % 3 = 0 THEN '1' ELSE '0' END",
            "_lastupdatedinstant": "NULL",
        },
    ),
    "lab_order": (
        "orders",
        {"lab_order_id": "o_orderkey", "hospital_visit_id": "o_orderkey"},
    ),
    "lab_result": (
        "events",
        {
            "lab_result_id": "event_id",
            "lab_order_id": "user_id",
            "lab_test_definition_id": (
                f"CASE WHEN event_type = 'error' THEN {fixed.LACTATE_TEST} ELSE 1 END"
            ),
            "result_last_modified_time": "ts",
            "value_as_real": "value",
            "units": "'mmol/L'",
            "abnormal_flag": "CASE WHEN value > 100 THEN 'H' END",
            "comment": "props",
        },
    ),
    "all_targets": (
        "events",
        {
            "mrn": "user_id",
            "csn": "event_id",
            "side": "CASE WHEN user_id % 2 = 0 THEN 'N' ELSE 'S' END",
            "log_dt": "ts",
            "bay": "CASE WHEN user_id % 3 = 0 THEN 'BY01' ELSE 'SR02' END",
            "bed": "concat('B', event_id % 30)",
            "spo2": "value > 10",
            "map": "value > 20",
            "pao2": "CASE WHEN event_id % 4 <> 0 THEN value > 30 END",
            "ph": "value > 40",
            "hb": "value > 50",
            "fb": "value > 60",
            "rass": "CASE WHEN event_id % 9 <> 0 THEN value > 70 END",
        },
    ),
    "t03_bed_grid": (
        "nation",
        {
            "key": "concat('B', n_nationkey)",
            "loc_x": "n_nationkey % 5",
            "loc_y": "n_regionkey",
            "bed": "n_nationkey",
        },
    ),
}


def bridge(spark: SparkSession, sf_dir: str) -> EhrTables:
    """All tables over the test tables in ``sf_dir``; the same object per application."""
    folder = sf_dir.rstrip("/")
    known = (spark.sparkContext.applicationId, folder)
    if known not in _bridges:
        _bridges[known] = _bridge(spark, folder)
    return _bridges[known]


_bridges: dict[tuple[str, str], EhrTables] = {}


def _bridge(spark: SparkSession, folder: str) -> EhrTables:

    def read(name: str) -> DataFrame:
        if name == "location_visit":
            return written_once(spark, name, folder, lambda: _location_visit(spark, folder))
        source, columns = PROJECTIONS[name]
        return _typed(spark.read.parquet(f"{folder}/{source}.parquet"), name, columns)

    def query(name: str) -> str:
        if name == "location_visit":
            files = read(name).inputFiles()[0].rsplit("/", 1)[0]
            return f"SELECT * FROM parquet.`{files}`"
        source, columns = PROJECTIONS[name]
        types = columns_of(name)
        fields = ", ".join(f"CAST({sql} AS {types[c]}) AS {c}" for c, sql in columns.items())
        return f"SELECT {fields} FROM parquet.`{folder}/{source}.parquet`"

    return EhrTables(spark, read, query)


def _typed(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    types = columns_of(name)
    return df.select(
        *[F.expr(sql).cast(types[c]).alias(c) for c, sql in columns.items()]
    )


def _location_visit(spark: SparkSession, folder: str) -> DataFrame:
    """Bed stays from all events, over all places; a stay ends when the next begins."""
    moves = spark.read.parquet(f"{folder}/events.parquet")
    places = spark.read.parquet(f"{folder}/part.parquet").count()
    moves = with_neighbours(moves, "user_id", "ts", "event_id", {"next_ts": ("ts", -1)})
    columns = {
        "location_visit_id": "event_id",
        "hospital_visit_id": "user_id",
        "location_id": (
            f"CASE WHEN event_id % 3 = 0 THEN user_id * 7 ELSE event_id * 5 END % {places}"
        ),
        "admission_time": "ts",
        "discharge_time": "next_ts",
    }
    return _typed(moves, "location_visit", columns)
