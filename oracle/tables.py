"""The record system's tables for DuckDB, as common table expressions."""

from __future__ import annotations

from wardflow.sources.bridge import PROJECTIONS
from wardflow.sources.ehr import SCHEMAS

TYPES = {
    "LONG": "BIGINT",
    "STRING": "VARCHAR",
    "TIMESTAMP_NTZ": "TIMESTAMP",
    "DOUBLE": "DOUBLE",
    "BOOLEAN": "BOOLEAN",
    "DATE": "DATE",
}
NOW = "TIMESTAMP '2024-01-31 00:00:00'"

LOCATION_VISIT = """
    SELECT event_id AS location_visit_id, user_id AS hospital_visit_id,
           CAST(CASE WHEN event_id % 3 = 0 THEN user_id * 7 ELSE event_id * 5 END
                % (SELECT count(*) FROM part) AS BIGINT) AS location_id,
           ts AS admission_time,
           lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS discharge_time
    FROM events"""


def table(name: str) -> str:
    if name == "location_visit":
        return LOCATION_VISIT
    source, columns = PROJECTIONS[name]
    types = dict(field.split() for field in SCHEMAS[name].split(", "))
    fields = ", ".join(
        f'CAST({sql.replace("TIMESTAMP_NTZ", "TIMESTAMP ")} AS {TYPES[types[c]]}) AS "{c}"'
        for c, sql in columns.items()
    )
    return f"SELECT {fields} FROM {source}"


def statement(tables: str, select: str, bridged: bool = True, **steps: str) -> str:
    """WITH the named tables and steps, in order, run ``select``.

    Without the bridge the record system's own tables are read.
    """
    parts = [f"{n} AS MATERIALIZED ({table(n)})" for n in tables.split() if bridged]
    parts += [f"{name} AS ({sql})" for name, sql in steps.items()]
    return f"WITH {', '.join(parts)}\n{select}" if parts else select
