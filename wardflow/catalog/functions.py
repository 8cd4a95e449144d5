"""Functions that are kept in a schema of the catalog, to be called from SQL and from stored views.

All are SQL expressions or SQL queries: Spark puts them into the plan of the caller, so they cost
nothing and no Python runs.  A table function takes the place of a table and may stand beside others
in a join or after LATERAL.  Inside a schema they call one another by their plain names.

``locf``, the aggregate that carries the last known value, is spelled
``max_by(value, locf_at(value, at, id))``: an aggregate with map-side combine, or over a window the
value known so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from wardflow.functions import fixed_values as fixed
from wardflow.functions.times import SLOT_MINUTES


@dataclass(frozen=True)
class SqlFunction:
    """``returns`` is a type, or ``TABLE (...)``; ``body`` an expression or a query."""

    arguments: str
    returns: str
    body: str


def _texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cases(rules) -> str:
    """The value of the first condition that holds, else NULL."""
    return "CASE " + " ".join(f"WHEN {condition} THEN {value}" for condition, value in rules) + " END"


def _part(n: int) -> str:
    return f"split_part(place, '{fixed.SEPARATOR}', {n})"


def _captured(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, r'{pattern}', 1), '')"


_HIDDEN = f"{_part(2)} RLIKE r'{fixed.HIDDEN_WARD_PATTERN}'"

_BUILDING = _cases(
    [
        (f"{_part(1)} RLIKE r'{fixed.TOWER_PATTERN}'", f"'{fixed.TOWER}'"),
        (f"left(place, 2) IN ({_texts(fixed.WMS_PREFIXES)})", f"'{fixed.WMS}'"),
        *[(f"contains(place, '{name}')", f"'{name}'") for name in fixed.BUILDINGS_NAMED_IN_TEXT],
        (f"left(place, 4) IN ({_texts(fixed.NHNN_PREFIXES)})", f"'{fixed.NHNN}'"),
        (f"startswith(place, '{fixed.EDH}')", f"'{fixed.EDH}'"),
        (f"contains(place, '{fixed.EXTERNAL_TEXT}')", f"'{fixed.EXTERNAL}'"),
    ]
)

_BED_TYPE = _cases(
    [
        *[(f"startswith({_part(3)}, '{key}')", f"'{name}'") for key, name in fixed.BED_TYPE_PREFIXES],
        (f"place RLIKE r'{fixed.PROCEDURE_PATTERN}'", f"'{fixed.PROCEDURE}'"),
        (f"place RLIKE r'{fixed.IMAGING_PATTERN}'", f"'{fixed.IMAGING}'"),
    ]
)

_LEAP_SAFE_YEARS = (
    "year({1}) - year({0}) - CASE WHEN month({1}) * 100 + day({1}) < month({0}) * 100 + day({0}) THEN 1 ELSE 0 END"
)

#: Scalar functions, in the order of their dependencies.
SCALARS: dict[str, SqlFunction] = {
    "locf_s": SqlFunction("earlier DOUBLE, later DOUBLE", "DOUBLE", "coalesce(later, earlier)"),
    "locf_at": SqlFunction(
        "value DOUBLE, at TIMESTAMP_NTZ, id BIGINT",
        "STRUCT<at: TIMESTAMP_NTZ, id: BIGINT>",
        "CASE WHEN value IS NOT NULL THEN named_struct('at', at, 'id', id) END",
    ),
    "locf_text_at": SqlFunction(
        "value STRING, at TIMESTAMP_NTZ, id BIGINT",
        "STRUCT<at: TIMESTAMP_NTZ, id: BIGINT>",
        "CASE WHEN value IS NOT NULL THEN named_struct('at', at, 'id', id) END",
    ),
    "hour_floor": SqlFunction(
        "at TIMESTAMP_NTZ", "TIMESTAMP_NTZ", "CAST(to_date(at) AS TIMESTAMP_NTZ) + make_dt_interval(0, hour(at))"
    ),
    "time_slot": SqlFunction(
        "at TIMESTAMP_NTZ",
        "BIGINT",
        f"(unix_date(to_date(at)) * 1440L + hour(at) * 60 + minute(at)) DIV {SLOT_MINUTES}",
    ),
    "out_of_hours": SqlFunction(
        "at TIMESTAMP_NTZ",
        "BOOLEAN",
        f"coalesce(hour(at) >= {fixed.OUT_OF_HOURS_FROM} OR hour(at) < {fixed.OUT_OF_HOURS_UNTIL}, false)",
    ),
    "age_years": SqlFunction(
        "born DATE, today DATE",
        "DOUBLE",
        f"CASE WHEN born <= today THEN {_LEAP_SAFE_YEARS.format('born', 'today')}"
        f" WHEN born > today THEN -({_LEAP_SAFE_YEARS.format('today', 'born')}) END",
    ),
    "initials": SqlFunction("first STRING, last STRING", "STRING", "concat_ws('', left(first, 1), left(last, 1))"),
    "ward_of": SqlFunction(
        "place STRING",
        "STRING",
        _cases([(f"{_part(1)} <> '{fixed.NULL_TEXT}'", _part(1)), (_HIDDEN, f"'{fixed.HIDDEN_WARD}'")]),
    ),
    "counts_for_census": SqlFunction(
        "bed STRING",
        "BOOLEAN",
        _cases([(f"bed RLIKE r'{fixed.CENSUS_BED_PATTERN}'", "true"), (f"bed IN ({_texts(fixed.NON_CENSUS_BEDS)})", "false")]),
    ),
    "building_of": SqlFunction("place STRING", "STRING", _BUILDING),
    "is_critical_care": SqlFunction(
        "place STRING",
        "BOOLEAN",
        f"CASE WHEN {_part(1)} RLIKE r'{fixed.CRITICAL_CARE_PATTERN}' OR {_HIDDEN} THEN true END",
    ),
    "ed_zone_of": SqlFunction(
        "place STRING",
        "STRING",
        f"CASE WHEN {_part(1)} = '{fixed.EMERGENCY_DEPARTMENT}' THEN "
        + _cases([(f"contains(place, '{key}')", f"'{zone}'") for key, zone in fixed.ED_ZONES])
        + " END",
    ),
    "bed_type_of": SqlFunction("place STRING", "STRING", _BED_TYPE),
    "ward_prefix": SqlFunction("ward STRING", "STRING", _captured("ward", fixed.WARD_PREFIX_PATTERN)),
    "floor_index": SqlFunction("ward STRING", "INT", f"try_cast({_captured('ward', fixed.FLOOR_INDEX_PATTERN)} AS INT)"),
    "bed_index": SqlFunction("place STRING", "INT", f"try_cast({_captured('place', fixed.BED_INDEX_PATTERN)} AS INT)"),
    "device_flow": SqlFunction(
        "device STRING", "DOUBLE", _cases([(f"device = '{name}'", f"{rate}D") for name, rate in fixed.O2_DEVICE_FLOW])
    ),
    "oxygen_demand": SqlFunction(
        "flow DOUBLE, fraction DOUBLE, by_device DOUBLE",
        "DOUBLE",
        "coalesce(flow, by_device, "
        + _cases([(f"fraction > {limit}D", f"{rate}D") for limit, rate in fixed.O2_FRACTION_FLOW])
        + ", 0D)",
    ),
}

_OXYGEN_KINDS = (fixed.O2_FLOW_TYPE, fixed.O2_FRACTION_TYPE, fixed.O2_DEVICE_TYPE)


def _reading(value: str, kind: int) -> str:
    """Of several readings of one kind at one instant the one recorded last."""
    return f"max_by({value}, visit_observation_id) FILTER (WHERE visit_observation_type_id = {kind})"


#: Table functions, in the order of their dependencies; ``{tables}`` is the schema of the tables.
TABLE_FUNCTIONS: dict[str, SqlFunction] = {
    # a series of hours, both ends part of it
    "hours_between": SqlFunction(
        "first_hour TIMESTAMP_NTZ, last_hour TIMESTAMP_NTZ",
        "TABLE (obs_dt TIMESTAMP_NTZ)",
        "SELECT explode(sequence(hours_between.first_hour, hours_between.last_hour, INTERVAL '1' HOUR))",
    ),
    # the hours from some days ago until now; a table function can't be given what a function returns
    "hours_of_last": SqlFunction(
        "days INT",
        "TABLE (obs_dt TIMESTAMP_NTZ)",
        "SELECT explode(hours) FROM (SELECT sequence("
        "hour_floor(as_of() - make_dt_interval(hours_of_last.days)), hour_floor(as_of()), INTERVAL '1' HOUR) AS hours)",
    ),
    # the crosstab: kinds of readings side by side, a row for each visit and instant of some days or, with NULL, ever
    "oxygen_crosstab": SqlFunction(
        "days INT",
        "TABLE (hospital_visit_id BIGINT, observation_datetime TIMESTAMP_NTZ, o2_lmin DOUBLE, o2_fi DOUBLE, o2_device STRING)",
        f"""SELECT hospital_visit_id, observation_datetime,
          {_reading('value_as_real', fixed.O2_FLOW_TYPE)}, {_reading('value_as_real', fixed.O2_FRACTION_TYPE)},
          {_reading('value_as_text', fixed.O2_DEVICE_TYPE)}
        FROM {{tables}}.visit_observation
        WHERE visit_observation_type_id IN ({', '.join(map(str, _OXYGEN_KINDS))})
          AND (oxygen_crosstab.days IS NULL OR observation_datetime > as_of() - make_dt_interval(oxygen_crosstab.days))
        GROUP BY hospital_visit_id, observation_datetime""",
    ),
}


def definition(schema: str, name: str, tables: str) -> str:
    """The statement that makes a function in ``schema`` over the tables of the schema ``tables``."""
    f = SCALARS.get(name) or TABLE_FUNCTIONS[name]
    body = f.body.replace("{tables}", tables)
    return f"CREATE OR REPLACE FUNCTION {schema}.{name}({f.arguments}) RETURNS {f.returns} RETURN {body}"
