"""For every registered query an independent SQL statement over the test tables."""

from __future__ import annotations

from functools import partial

from oracle.tables import NOW, statement as any_statement
from wardflow.functions import fixed_values as fixed


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _cases(subject: str, labels) -> str:
    whens = " ".join(f"WHEN '{key}' THEN '{label}'" for key, label in labels)
    return f"CASE {subject} {whens} END"


def _contains(labels) -> str:
    return " ".join(
        f"WHEN contains(location_string, '{key}') THEN '{label}'" for key, label in labels
    )


# -- locations -------------------------------------------------------------------

def parsed(nhnn_by_prefix: bool, critical_care_default: str) -> str:
    """Same rules without look-around, which DuckDB's regex engine lacks."""
    nhnn = "WHEN left(location_string, 4) IN ('SINQ', 'MINQ') THEN 'NHNN'"
    return f"""
    SELECT location_id, location_string,
      CASE WHEN p1 <> 'null' THEN p1 WHEN starts_with(p2, 'T07CV') THEN 'T07CV' END AS ward,
      p3 AS bed, p1 AS ward_raw,
      CASE WHEN regexp_matches(p3, 'BY|CB|CH|SR|HR|BD|NU|PD|MAJ|RAT|SDEC|RESUS|TRIAGE')
           THEN true WHEN p3 IN ({_list(fixed.NON_CENSUS_BEDS)}) THEN false END AS census,
      CASE WHEN regexp_matches(p1, '^(T0|T1|THP3|ED($|[^H]))') THEN 'tower'
           WHEN left(location_string, 2) IN ('WM', 'WS') THEN 'WMS'
           {_contains([(n, n) for n in fixed.BUILDINGS_NAMED_IN_TEXT])}
           {nhnn if nhnn_by_prefix else ''}
           WHEN starts_with(location_string, 'EDH') THEN 'EDH'
           {_contains([('OUTSC', 'EXTERNAL')])} END AS building,
      CASE WHEN regexp_matches(p1, '^(T03|WSCC|SINQ|MINQ|P03CV|T07CV)')
             OR starts_with(p2, 'T07CV') THEN true ELSE {critical_care_default} END
        AS critical_care,
      CASE WHEN p1 = 'ED' THEN CASE {_contains(fixed.ED_ZONES)} END END AS ed_zone,
      CASE WHEN left(p3, 2) IN ('BY', 'CB') THEN 'bay'
           WHEN left(p3, 2) = 'SR' THEN 'sideroom' WHEN left(p3, 2) = 'CH' THEN 'chair'
           WHEN regexp_matches(location_string, 'SURGERY|THR|PROC|ENDO|TREAT|ANGI')
             OR regexp_matches(location_string,
                  '(^.{{1,2}}|[^C]..|C[^H].|CH[^A])IN?R\\^') THEN 'procedure'
           WHEN regexp_matches(location_string, 'XR|MRI|SCANNER|.CT\\^') THEN 'imaging'
      END AS bed_type
    FROM (SELECT *, split_part(location_string, '^', 1) AS p1,
                 split_part(location_string, '^', 2) AS p2,
                 split_part(location_string, '^', 3) AS p3 FROM location)"""


VIEW_RULES = parsed(True, "CAST(NULL AS BOOLEAN)")
PLUS_RULES = parsed(False, "CAST(NULL AS BOOLEAN)")
CARE_RULES = parsed(True, "false")

# -- visits ----------------------------------------------------------------------

VISIT = """v.hospital_visit_id, v.encounter, v.admission_time, v.arrival_method,
    v.presentation_time, v.discharge_time, v.discharge_disposition"""
EMERGENCIES = f"""v.presentation_time > {NOW} - INTERVAL 12 HOUR
    AND v.patient_class = 'EMERGENCY' AND v.arrival_method = 'Ambulance'"""
#: For every number a patient was booked under, the number and the identity that is valid today.
NUMBERS = """(SELECT k.mrn_id, old.mrn AS original_mrn, now.mrn AS live_mrn
    FROM mrn_to_live k, mrn old, mrn now WHERE old.mrn_id = k.mrn_id AND now.mrn_id = k.live_mrn_id)"""
VISITS_WITH_NUMBERS = f"hospital_visit v JOIN {NUMBERS} USING (mrn_id)"

#: The persons with what is known of their identity today, if anything is.
PERSONS = """(SELECT c.mrn_id AS booked_id, c.core_demographic_id, known.*
    FROM core_demographic c LEFT JOIN (
      SELECT k.mrn_id AS mrn_id_alt, i.mrn_id, i.mrn, i.nhs_number
      FROM mrn_to_live k LEFT JOIN mrn i ON i.mrn_id = k.live_mrn_id) known ON known.mrn_id_alt = c.mrn_id)"""


def identities(visits: str) -> str:
    return f"""SELECT DISTINCT core_demographic_id, who.mrn_id, mrn_id_alt, mrn, nhs_number, hospital_visit_id, encounter
    FROM {visits} LEFT JOIN (SELECT hospital_visit_id, encounter, mrn_id AS visit_mrn_id FROM hospital_visit) USING (hospital_visit_id)
    LEFT JOIN {PERSONS} who ON who.booked_id = visit_mrn_id"""


DICTIONARY = """
    SELECT k.visit_observation_type, k.id_in_application, k.source_application,
      f.name, f.displayname, f.abbreviation, f.valuetype, f.rowtype, f.unit,
      f.description, f.iscalculated, f._lastupdatedinstant
    FROM visit_observation_type k
    LEFT JOIN flowsheetrowdim f ON f.flowsheetrowepicid = k.id_in_application"""

NIV_VISITS = f"""
    SELECT DISTINCT o.hospital_visit_id
    FROM visit_observation o
    JOIN dictionary d ON d.visit_observation_type = o.visit_observation_type_id
    WHERE d.name IN ({_list(fixed.NIV_FLOWSHEET_ROWS)})
       OR (d.name = 'R OXYGEN DELIVERY METHOD' AND o.value_as_text = 'CPAP/Bi-PAP mask')"""

TARGETS = " UNION ALL ".join(
    f"SELECT a.*, '{label}' AS target_name, a.{column} AS target_value FROM all_targets a"
    for label, column in fixed.TARGETS
)

VITALS = """
    SELECT o.visit_observation_id, o.hospital_visit_id, o.observation_datetime,
      {labels} AS vital, o.value_as_real, o.value_as_text, o.unit
    FROM visit_observation o
    JOIN visit_observation_type k ON k.visit_observation_type = o.visit_observation_type_id
    WHERE o.observation_datetime > {now} - INTERVAL {window}
      AND k.id_in_application IN ({codes})
    ORDER BY o.observation_datetime DESC NULLS FIRST"""


def vitals(window: str) -> str:
    return VITALS.format(
        labels=_cases("k.id_in_application", fixed.VITAL_LABELS),
        codes=_list(code for code, _ in fixed.VITAL_LABELS),
        now=NOW,
        window=window,
    )


# -- occupancy ---------------------------------------------------------------------

WARD_STAYS = """
    SELECT s.hospital_visit_id, s.location_visit_id, s.location_id,
      s.admission_time AS bed_in, s.discharge_time AS bed_dc,
      v.admission_time AS hosp_in, v.discharge_time AS hosp_dc,
      l.location_string, split_part(l.location_string, '^', 1) AS ward,
      lag(split_part(l.location_string, '^', 1)) OVER (PARTITION BY s.hospital_visit_id
        ORDER BY s.admission_time NULLS LAST, s.location_visit_id) AS ward_lag1
    FROM location_visit s
    JOIN location l USING (location_id)
    JOIN hospital_visit v USING (hospital_visit_id)
    WHERE split_part(l.location_string, '^', 3) <> 'null'"""

OPEN = "bed_in IS NOT NULL AND bed_dc IS NULL AND hosp_in IS NOT NULL AND hosp_dc IS NULL"


def events_of(stays: str) -> str:
    return f"""
    SELECT *, 'bed_in' AS event, bed_in AS ts, 1 AS census FROM {stays}
    UNION ALL
    SELECT *, 'bed_dc', bed_dc, CASE WHEN bed_dc IS NULL THEN 0 ELSE -1 END FROM {stays}"""


def running(group: str) -> str:
    """All rows of the same instant are peers (default frame)."""
    return f"""CAST(sum(census) OVER (PARTITION BY {group} ORDER BY ts DESC NULLS FIRST
      RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)"""


WARDS = "location location_visit hospital_visit"
WARD_STEPS = dict(
    stays=WARD_STAYS,
    moves=events_of("stays"),
    anchors=f"""SELECT ward, count(DISTINCT location_string) AS n FROM stays
        WHERE {OPEN} GROUP BY ward""",
)

# -- census ----------------------------------------------------------------------------


def inpatients(window: str) -> str:
    return f"""
    SELECT v.hospital_visit_id, m.mrn, p.core_demographic_id, p.lastname, p.firstname,
      p.datetime_of_death, v.encounter, v.patient_class,
      v.admission_time AS hosp_in, v.discharge_time AS hosp_dc
    FROM hospital_visit v JOIN core_demographic p USING (mrn_id) JOIN mrn m USING (mrn_id)
    WHERE v.patient_class = 'INPATIENT' AND v.source_system = 'EPIC'
      AND v.admission_time IS NOT NULL
      AND coalesce(v.discharge_time > {NOW} - INTERVAL {window}, true)"""


CENSUS_STAYS = """
    SELECT c.*, s.location_visit_id, s.admission_time AS bed_in, s.discharge_time AS bed_dc,
      l.building, l.ward, l.bed, l.bed_type, l.ed_zone, l.critical_care,
      l.location_string, l.location_id,
      lag(l.critical_care) OVER seq AS cc_lag1, lead(l.critical_care) OVER seq AS cc_lead1,
      lag(l.ward) OVER seq AS ward_lag1, lead(l.ward) OVER seq AS ward_lead1,
      coalesce(lag(l.bed_type) OVER seq IN ('procedure', 'imaging')
        AND lag(l.location_id, 2) OVER seq = l.location_id, false) AS noncensus_in,
      coalesce(lead(l.bed_type) OVER seq IN ('procedure', 'imaging')
        AND lead(l.location_id, 2) OVER seq = l.location_id, false) AS noncensus_out
    FROM location_visit s JOIN cohort c USING (hospital_visit_id)
    JOIN places l ON l.location_id = s.location_id AND l.census
    WINDOW seq AS (PARTITION BY s.hospital_visit_id
      ORDER BY s.admission_time NULLS LAST, s.location_visit_id)"""

CENSUS_MOVES = """
    SELECT *, row_number() OVER (PARTITION BY mrn
      ORDER BY datetime_of_death - bed_in NULLS LAST, datetime_of_death IS NULL,
               location_visit_id,
               CASE event WHEN 'bed_in' THEN 0 ELSE 1 END) AS death_order
    FROM (%s)""" % events_of("stays")

CENSUS_TABLES = "location location_visit hospital_visit core_demographic mrn"

CENSUS_FLAGS = """
      CASE WHEN hosp_dc IS NULL AND bed_dc IS NULL AND datetime_of_death IS NULL
            AND bed <> 'WAIT' THEN true END AS census_now,
      CASE WHEN death_order = 1 AND datetime_of_death > hosp_in
            AND (datetime_of_death <= hosp_dc OR hosp_dc IS NULL) THEN true END AS bed_death,
      CASE WHEN event = 'bed_in' AND NOT noncensus_in
             AND (ward_lag1 IS NULL OR ward_lag1 <> m.ward) THEN 1
           WHEN event = 'bed_dc' AND NOT noncensus_out AND ts IS NOT NULL
             AND (ward_lead1 IS NULL OR ward_lead1 <> m.ward) THEN -1 END AS ward_census,
      coalesce(hour(ts) >= 22 OR hour(ts) < 7, false) AS out_of_hours"""


def census_steps(rules: str, window: str) -> dict[str, str]:
    return dict(
        places=rules,
        cohort=inpatients(window),
        stays=CENSUS_STAYS,
        moves=CENSUS_MOVES,
        anchors=f"""SELECT ward, count(DISTINCT bed) AS occupancy_now FROM stays
            WHERE {OPEN} GROUP BY ward""",
        care_anchors=f"""SELECT critical_care, count(DISTINCT location_string) AS cc_now
            FROM stays WHERE {OPEN} GROUP BY critical_care""",
    )


CENSUS_PLUS = f"""
    SELECT mrn, encounter, lastname, firstname, datetime_of_death, hosp_in, hosp_dc, ts, event,
      building, location_visit_id, m.ward, bed, bed_type, ed_zone, ward_lag1, ward_lead1,
      noncensus_in, noncensus_out, census, occupancy_now,
      occupancy_now - {running('m.ward')} AS occupancy, {CENSUS_FLAGS}
    FROM moves m JOIN anchors a ON a.ward = m.ward"""

CENSUS_CC = f"""
    SELECT mrn, core_demographic_id, encounter, hospital_visit_id, patient_class, lastname,
      firstname, datetime_of_death, hosp_in, hosp_dc, ts, event, building, location_visit_id,
      m.ward, bed, bed_type, m.critical_care, cc_lag1, cc_lead1, ward_lag1, ward_lead1,
      location_string, location_id, noncensus_in, noncensus_out, census,
      occupancy_now, cc_now,
      occupancy_now - {running('m.ward')} AS occupancy,
      cc_now - {running('m.critical_care')} AS cc_occupancy,
      CASE WHEN hosp_dc IS NULL AND bed_dc IS NULL AND datetime_of_death IS NULL
            AND bed <> 'WAIT' AND m.critical_care THEN true END AS census_now_cc,
      CASE WHEN m.critical_care AND event = 'bed_in' AND NOT noncensus_in
             AND (cc_lag1 IS NULL OR cc_lag1 <> m.critical_care) THEN 1
           WHEN m.critical_care AND event = 'bed_dc' AND NOT noncensus_out AND ts IS NOT NULL
             AND (cc_lead1 IS NULL OR cc_lead1 <> m.critical_care) THEN -1 END AS cc_census,
      {CENSUS_FLAGS}
    FROM moves m
    LEFT JOIN anchors a ON a.ward = m.ward
    LEFT JOIN care_anchors c ON c.critical_care = m.critical_care"""
# -- oxygen ------------------------------------------------------------------------------

O2_KINDS = f"({fixed.O2_FLOW_TYPE}, {fixed.O2_FRACTION_TYPE}, {fixed.O2_DEVICE_TYPE})"


def last_reading(kind: int, value: str, name: str) -> str:
    return f"""max(CASE WHEN visit_observation_type_id = {kind} AND newest = 1
        THEN {value} END) AS {name}"""


def pivoted(condition: str) -> str:
    return f"""
    SELECT hospital_visit_id, observation_datetime,
      {last_reading(fixed.O2_FLOW_TYPE, 'value_as_real', 'o2_lmin')},
      {last_reading(fixed.O2_FRACTION_TYPE, 'value_as_real', 'o2_fi')},
      {last_reading(fixed.O2_DEVICE_TYPE, 'value_as_text', 'o2_device')}
    FROM (SELECT *, row_number() OVER (PARTITION BY hospital_visit_id, observation_datetime,
            visit_observation_type_id ORDER BY visit_observation_id DESC) AS newest
          FROM visit_observation
          WHERE visit_observation_type_id IN {O2_KINDS} AND {condition})
    GROUP BY hospital_visit_id, observation_datetime"""


RECENT = f"observation_datetime > {NOW} - INTERVAL 7 DAY"
DEVICE_FLOW = " ".join(
    f"WHEN r.o2_device = '{device}' THEN {flow}" for device, flow in fixed.O2_DEVICE_FLOW
)
#: Where each visit was from which time on; of stays begun at one time that of the largest number.
PLACES_BY_TIME = """(SELECT hospital_visit_id, admission_time AS since, max(location_visit_id) AS stay_id,
        arg_max(struct_pack(place := location_string), location_visit_id).place AS location_string
      FROM location_visit JOIN location USING (location_id)
      WHERE admission_time IS NOT NULL GROUP BY hospital_visit_id, admission_time)"""
HOURLY_STEPS = dict(
    readings=pivoted(RECENT),
    located=f"""
    SELECT r.hospital_visit_id, r.observation_datetime, s.location_string,
      CAST(CASE WHEN r.o2_lmin IS NOT NULL THEN r.o2_lmin {DEVICE_FLOW}
        WHEN r.o2_fi > 60 THEN 11 WHEN r.o2_fi > 40 THEN 8 WHEN r.o2_fi > 21 THEN 5
        ELSE 0 END AS DOUBLE) AS demand
    FROM readings r ASOF JOIN {PLACES_BY_TIME} s
      ON s.hospital_visit_id = r.hospital_visit_id AND s.since <= r.observation_datetime""",
    hourly="""
    SELECT hospital_visit_id, location_string,
      date_trunc('hour', observation_datetime) AS obs_dt, avg(demand) AS o2_demand
    FROM located
    WHERE regexp_extract(split_part(location_string, '^', 1), '^(\\D+)', 1) IN ('T', 'P', 'HS')
    GROUP BY ALL""",
    hours=f"""
    SELECT CAST(h AS TIMESTAMP) AS obs_dt
    FROM generate_series({NOW} - INTERVAL 7 DAY, {NOW}, INTERVAL 1 HOUR) g(h)""",
)
O2_TABLES = "location location_visit visit_observation"
FLOOR = "TRY_CAST(regexp_extract(split_part(location_string, '^', 1), '^\\D+(\\d+)', 1) AS INT)"
BED = "TRY_CAST(regexp_extract(location_string, '(\\d+)\\D?$', 1) AS INT)"

OXYGEN = f"""
    SELECT location_string, obs_dt, round(o2_demand, 6) AS o2_demand,
      round(o2_locf, 6) AS o2_locf, split_part(location_string, '^', 1) AS ward,
      {FLOOR} AS floor_index, {BED} AS bed_index
    FROM (
      SELECT g.location_string, g.obs_dt, h.o2_demand,
        last_value(p.pick IGNORE NULLS) OVER (PARTITION BY g.location_string
          ORDER BY g.obs_dt, h.hospital_visit_id NULLS FIRST
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o2_locf
      FROM (SELECT * FROM (SELECT DISTINCT location_string FROM hourly) CROSS JOIN hours) g
      LEFT JOIN hourly h USING (location_string, obs_dt)
      LEFT JOIN (SELECT location_string, obs_dt, o2_demand AS pick FROM hourly
        QUALIFY row_number() OVER (PARTITION BY location_string, obs_dt
          ORDER BY hospital_visit_id DESC) = 1) p USING (location_string, obs_dt))
    WHERE o2_locf IS NOT NULL"""

STEP_LOCF = """
    SELECT location_string, obs_dt, round(o2_demand, 6) AS o2_demand,
      round(last_value(o2_demand IGNORE NULLS) OVER (PARTITION BY location_string
        ORDER BY obs_dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS o2_locf
    FROM (SELECT * FROM (SELECT DISTINCT location_string FROM hourly) CROSS JOIN hours)
    LEFT JOIN (SELECT location_string, obs_dt, max(o2_demand) AS o2_demand FROM hourly
      GROUP BY ALL) USING (location_string, obs_dt)"""

AGE = f"CAST(date_part('year', age({NOW}, CAST(date_of_birth AS TIMESTAMP))) AS DOUBLE)"


def statements(bridged: bool = True) -> dict[str, str]:
    statement = partial(any_statement, bridged=bridged)
    lag_stays = "PARTITION BY hospital_visit_id ORDER BY admission_time, location_visit_id"
    registered = {
        "current_bed": statement(
            "location location_visit",
            f"""SELECT s.location_visit_id, s.hospital_visit_id, s.location_id,
              l.location_string, s.admission_time, s.discharge_time
            FROM location_visit s JOIN location l USING (location_id)
            WHERE s.admission_time > {NOW} - INTERVAL 12 HOUR AND s.discharge_time IS NULL
              AND split_part(l.location_string, '^', 1) = 'ED'
              AND regexp_matches(split_part(l.location_string, '^', 2), 'RESUS|MAJORS')
            ORDER BY l.location_string""",
        ),
        "hospital_visit_1": statement(
            "hospital_visit", f"SELECT {VISIT} FROM hospital_visit v WHERE {EMERGENCIES}"
        ),
        "hospital_visit_2": statement(
            "hospital_visit mrn mrn_to_live",
            f"""SELECT {VISIT}, original_mrn, live_mrn
            FROM {VISITS_WITH_NUMBERS} WHERE {EMERGENCIES}""",
        ),
        "hospital_visit_3": statement(
            "hospital_visit mrn mrn_to_live core_demographic",
            f"""SELECT {VISIT}, original_mrn, live_mrn,
              p.date_of_birth, {AGE} AS age, p.sex, p.home_postcode,
              concat(left(p.firstname, 1), left(p.lastname, 1)) AS initials
            FROM {VISITS_WITH_NUMBERS} JOIN core_demographic p USING (mrn_id)
            WHERE {EMERGENCIES}""",
        ),
        "lactate": statement(
            "lab_result lab_order",
            f"""SELECT r.lab_result_id, o.hospital_visit_id, r.result_last_modified_time,
              r.value_as_real, r.units, r.abnormal_flag, r.comment
            FROM lab_result r JOIN lab_order o USING (lab_order_id)
            WHERE r.lab_test_definition_id = {fixed.LACTATE_TEST}
              AND r.result_last_modified_time > {NOW} - INTERVAL 3 HOUR""",
        ),
        "vital_signs": statement(
            "visit_observation visit_observation_type", vitals("5 MINUTE")
        ),
        "vital_signs_last_day": statement(
            "visit_observation visit_observation_type", vitals("1 DAY")
        ),
        "visit_observation_type": statement(
            "visit_observation_type flowsheetrowdim", DICTIONARY
        ),
        "location": statement("location", VIEW_RULES),
        "location_census_plus": statement("location", PLUS_RULES),
        "location_census_cc": statement("location", CARE_RULES),
        "cc_filter": statement(
            "location location_visit hospital_visit core_demographic mrn mrn_to_live",
            identities(
                "(SELECT * FROM location_visit SEMI JOIN (SELECT * FROM places"
                " WHERE critical_care) USING (location_id))"
            ),
            places=VIEW_RULES,
        ),
        "niv_filter": statement(
            "visit_observation visit_observation_type flowsheetrowdim hospital_visit"
            " core_demographic mrn mrn_to_live",
            identities("niv"),
            dictionary=DICTIONARY,
            niv=NIV_VISITS,
        ),
        "alltargets_long": statement(
            "all_targets t03_bed_grid",
            """SELECT x.mrn, x.csn, x.side, x.log_dt AS ts, x.target_name, x.target_value,
              CAST(coalesce(x.target_value, false) AS INT) AS target01, x.bay, x.bed,
              g.loc_x, g.loc_y, g.bed AS bed_number
            FROM long x LEFT JOIN t03_bed_grid g ON g.key = x.bed""",
            long=TARGETS,
        ),
        "occupancy": statement(
            WARDS,
            f"""SELECT hospital_visit_id, location_visit_id, location_string, ward_lag1,
              m.ward, event, census, ts, {running('m.ward')} AS occupancy_raw,
              a.n - {running('m.ward')} AS occupancy
            FROM moves m JOIN anchors a ON a.ward = m.ward""",
            **WARD_STEPS,
        ),
        "ward_hour_flow": statement(
            "location location_visit",
            """SELECT date_trunc('hour', ts) AS hour, split_part(location_string, '^', 1) AS ward,
              count(*) FILTER (began) AS arrivals, count(*) FILTER (NOT began) AS departures,
              CAST(sum(CASE WHEN began THEN 1 ELSE -1 END) AS BIGINT) AS net_change
            FROM (SELECT location_id, admission_time AS ts, true AS began FROM location_visit
                  UNION ALL SELECT location_id, discharge_time, false FROM location_visit)
            JOIN location USING (location_id) WHERE ts IS NOT NULL GROUP BY ALL""",
        ),
        "census_plus": statement(
            CENSUS_TABLES, CENSUS_PLUS, **census_steps(PLUS_RULES, "3 MONTH")
        ),
        "census_cc": statement(
            CENSUS_TABLES, CENSUS_CC, **census_steps(CARE_RULES, "12 MONTH")
        ),
        "oxygen": statement(O2_TABLES, OXYGEN, **HOURLY_STEPS),
        # single operators
        "asof_join": statement(
            O2_TABLES,
            f"""SELECT o.visit_observation_id, o.hospital_visit_id, o.observation_datetime,
              s.stay_id AS location_visit_id, s.location_string
            FROM visit_observation o ASOF JOIN {PLACES_BY_TIME} s
              ON s.hospital_visit_id = o.hospital_visit_id AND s.since <= o.observation_datetime""",
        ),
        "latest_stay": statement(
            "location_visit",
            """SELECT hospital_visit_id, admission_time, location_visit_id, location_id
            FROM location_visit WHERE admission_time IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY hospital_visit_id
              ORDER BY admission_time DESC, location_visit_id DESC) = 1""",
        ),
        "running_census": statement(
            WARDS,
            f"SELECT DISTINCT ward, ts, {running('ward')} AS running FROM moves",
            **WARD_STEPS,
        ),
        "occupied_now": statement(WARDS, "SELECT * FROM anchors", **WARD_STEPS),
        "unpivot_intervals": statement(
            "location_visit",
            """SELECT location_visit_id, 'bed_in' AS event, admission_time AS ts, 1 AS census
            FROM location_visit
            UNION ALL
            SELECT location_visit_id, 'bed_dc', discharge_time,
              CASE WHEN discharge_time IS NULL THEN 0 ELSE -1 END FROM location_visit""",
        ),
        "unpivot_targets": statement(
            "all_targets", "SELECT csn, target_name, target_value FROM long", long=TARGETS
        ),
        "lag_lead": statement(
            "location_visit",
            f"""SELECT location_visit_id, hospital_visit_id, location_id, admission_time,
              lag(location_id) OVER w AS lag1, lead(location_id) OVER w AS lead1,
              lag(location_id, 2) OVER w AS lag2, lead(location_id, 2) OVER w AS lead2,
              coalesce(lag(location_id, 2) OVER w = location_id, false) AS round_trip
            FROM location_visit WINDOW w AS ({lag_stays})""",
        ),
        "death_rank": statement(
            CENSUS_TABLES,
            """SELECT hospital_visit_id, core_demographic_id, location_visit_id AS death_stay_id
            FROM moves WHERE death_order = 1 AND datetime_of_death IS NOT NULL""",
            **census_steps(CARE_RULES, "12 MONTH"),
        ),
        "resolve_live_mrn": statement(
            "hospital_visit mrn mrn_to_live",
            f"SELECT hospital_visit_id, original_mrn, live_mrn FROM {VISITS_WITH_NUMBERS}",
        ),
        "distinct_visits": statement(
            "visit_observation visit_observation_type flowsheetrowdim",
            NIV_VISITS,
            dictionary=DICTIONARY,
        ),
        "pivot_obs": statement("visit_observation", pivoted("true")),
        "avg_hourly": statement(
            "visit_observation",
            """SELECT hospital_visit_id, visit_observation_type_id,
              date_trunc('hour', observation_datetime) AS hour,
              round(avg(value_as_real), 6) AS mean_value
            FROM visit_observation GROUP BY ALL""",
        ),
        "hour_grid": statement(
            "location location_visit",
            """SELECT l.location_string, hours.obs_dt
            FROM (SELECT DISTINCT location_string FROM location
                  SEMI JOIN location_visit USING (location_id)) l CROSS JOIN hours""",
            hours=HOURLY_STEPS["hours"],
        ),
        "locf": statement(O2_TABLES, STEP_LOCF, **HOURLY_STEPS),
        "locf_aggregate": statement(
            "visit_observation",
            """SELECT hospital_visit_id, max(n) AS last_real, max(s) AS last_text,
              coalesce(max(n), 0) AS real_or_zero
            FROM (SELECT hospital_visit_id,
                CASE WHEN value_as_real IS NOT NULL AND row_number() OVER (
                  PARTITION BY hospital_visit_id, value_as_real IS NULL ORDER BY
                  observation_datetime DESC NULLS LAST, visit_observation_id DESC) = 1
                  THEN value_as_real END AS n,
                CASE WHEN value_as_text IS NOT NULL AND row_number() OVER (
                  PARTITION BY hospital_visit_id, value_as_text IS NULL ORDER BY
                  observation_datetime DESC NULLS LAST, visit_observation_id DESC) = 1
                  THEN value_as_text END AS s
              FROM visit_observation) GROUP BY hospital_visit_id""",
        ),
        "regex_capture": statement(
            "location",
            f"""SELECT location_id,
              nullif(regexp_extract(split_part(location_string, '^', 1), '^(\\D+)', 1), '')
                AS ward_prefix, {FLOOR} AS floor_index, {BED} AS bed_index FROM location""",
        ),
        "age_years": statement(
            "core_demographic", f"SELECT core_demographic_id, {AGE} AS age FROM core_demographic"
        ),
        "out_of_hours": statement(
            "visit_observation",
            """SELECT visit_observation_id,
              coalesce(hour(observation_datetime) NOT BETWEEN 7 AND 21, false) AS out_of_hours
            FROM visit_observation""",
        ),
        "row_counts": statement(
            CENSUS_TABLES,
            "SELECT count(*) AS n FROM moves",
            **census_steps(CARE_RULES, "12 MONTH"),
        ),
        "row_counts_plus": statement(
            CENSUS_TABLES,
            f"SELECT count(*) AS n FROM ({CENSUS_PLUS})",
            **census_steps(PLUS_RULES, "3 MONTH"),
        ),
        "newest_rows": statement(
            "visit_observation",
            """SELECT visit_observation_id, observation_datetime FROM visit_observation
            ORDER BY observation_datetime DESC NULLS FIRST, visit_observation_id LIMIT 3""",
        ),
    }
    registered["sql_scalars"] = statement(
        "hospital_visit core_demographic location_visit location",
        f"""SELECT v.hospital_visit_id, {AGE} AS age,
          concat(left(p.firstname, 1), left(p.lastname, 1)) AS initials,
          coalesce(hour(v.presentation_time) NOT BETWEEN 7 AND 21, false) AS out_of_hours, {BED} AS bed_index
        FROM hospital_visit v JOIN core_demographic p USING (mrn_id)
        LEFT JOIN (
          SELECT DISTINCT ON (hospital_visit_id) hospital_visit_id, location_string
          FROM location_visit JOIN location USING (location_id) WHERE admission_time IS NOT NULL
          ORDER BY hospital_visit_id, admission_time DESC, location_visit_id DESC) l USING (hospital_visit_id)
        WHERE v.patient_class = 'EMERGENCY'""",
    )
    registered["occupancy_stream"] = statement(
        "location location_visit",
        """SELECT ward, ts, net, coalesce(sum(net) OVER (PARTITION BY ward ORDER BY ts
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS occupancy
        FROM (SELECT split_part(location_string, '^', 1) AS ward, ts, sum(census)::BIGINT AS net
          FROM (SELECT location_id, admission_time AS ts, 1 AS census FROM location_visit
                UNION ALL SELECT location_id, discharge_time, -1 FROM location_visit)
          JOIN location USING (location_id) WHERE ts IS NOT NULL GROUP BY ALL)""",
    )
    registered["occupancy_by_date"] = registered["occupancy"]
    for name in ("cc_filter", "niv_filter", "location", "hour_grid", "oxygen"):
        registered[f"sql_{name}"] = registered[name]
    registered["sql_locf"] = registered["locf_aggregate"]
    registered["sql_crosstab"] = registered["pivot_obs"]
    registered["generations"] = registered["occupancy"]
    registered["snapshot"] = registered["occupancy"]
    registered["view_stack"] = registered["cc_filter"]
    return registered
