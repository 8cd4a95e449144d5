"""Fixed values.

Everything in this module is a value of the hospital's record system (codes,
patterns, labels, rates).  Results are only right if they are equal to it, so
they are kept together here as plain text and the logic refers to them by name.
"""

# --- location strings: "Department^Ward^Bed" ---------------------------------
SEPARATOR = "^"
NULL_TEXT = "null"

# ward hidden behind a 'null' department
HIDDEN_WARD_PATTERN = r"^(T07CV.*)"
HIDDEN_WARD = "T07CV"

# does a stay in this bed count for the census
CENSUS_BED_PATTERN = (
    r"(BY|CB|CH|SR|HR|BD|NU|PD).*$|.*(MAJ|RAT|SDEC|RESUS|TRIAGE).*"
)
NON_CENSUS_BEDS = ["null", "POOL", "WAIT", "NONE", "DISCHARGE", "VIRTUAL"]
WAITING_BED = "WAIT"

# building / physical site, first match wins in this order
TOWER_PATTERN = r"^(T0|T1|THP3|ED(?!H))"
TOWER = "tower"
WMS_PREFIXES = ["WM", "WS"]
WMS = "WMS"
BUILDINGS_NAMED_IN_TEXT = ["MCC", "NICU", "NHNN"]
NHNN_PREFIXES = ["SINQ", "MINQ"]
NHNN = "NHNN"
EDH = "EDH"
EXTERNAL_TEXT = "OUTSC"
EXTERNAL = "EXTERNAL"

# critical care
CRITICAL_CARE_PATTERN = r"^(T03|WSCC|SINQ|MINQ|P03CV|T07CV)"

# emergency department zones, first match wins in this order
EMERGENCY_DEPARTMENT = "ED"
ED_ZONES = [
    ("RESUS", "RESUS"),
    ("MAJ", "MAJORS"),
    ("UTC", "UTC"),
    ("RAT", "RAT"),
    ("SDEC", "SDEC"),
    ("SAA", "SAA"),
    ("TRIAGE", "TRIAGE"),
    ("PAEDS", "PAEDS"),
]

# bed types, first match wins in this order
BED_TYPE_PREFIXES = [
    ("BY", "bay"),
    ("CB", "bay"),
    ("SR", "sideroom"),
    ("CH", "chair"),
]
PROCEDURE_PATTERN = r".*(SURGERY|THR|PROC|ENDO|TREAT|ANGI).*|.+(?<!CHA)IN?R\^.*"
PROCEDURE = "procedure"
IMAGING_PATTERN = r".*XR.*|.*MRI.*|.+CT\^.*|.*SCANNER.*"
IMAGING = "imaging"

# --- visits ------------------------------------------------------------------
EMERGENCY_CLASS = "EMERGENCY"
INPATIENT_CLASS = "INPATIENT"
AMBULANCE = "Ambulance"
CENSUS_SOURCE_SYSTEM = "EPIC"
ED_BED_PATTERN = "(RESUS|MAJORS)"

# --- laboratory --------------------------------------------------------------
LACTATE_TEST = 141462274

# --- vital signs: identifier in the bedside application -> label --------------
VITAL_LABELS = [
    ("10", "SpO2"),
    ("5", "BP"),
    ("3040109304", "Oxygen"),
    ("6", "Temp"),
    ("8", "Pulse"),
    ("9", "Resp"),
    ("6466", "AVPU"),
]

# --- non-invasive ventilation -------------------------------------------------
NIV_FLOWSHEET_ROWS = [
    "R UCLH NIV MODE SETTING",
    "R UCLH NIV DEVICE",
    "R UCLH EPAP/PEEP FOR CPAP",
]
OXYGEN_DELIVERY_ROW = "R OXYGEN DELIVERY METHOD"
NIV_DEVICE_TEXT = "CPAP/Bi-PAP mask"

# --- oxygen -------------------------------------------------------------------
O2_FLOW_TYPE = 2281790312
O2_FRACTION_TYPE = 2281789816
O2_DEVICE_TYPE = 2281790343
# litres per minute assumed for a device without a measured flow
O2_DEVICE_FLOW = [
    ("High-flow nasal cannula (HFNC)", 60.0),
    ("CPAP/Bi-PAP mask", 15.0),
    ("Endotracheal tube", 12.0),
    ("Tracheostomy", 12.0),
    ("Non-rebreather mask", 15.0),
    ("Nasal cannula", 2.0),
]
# litres per minute assumed above an inspired-oxygen percentage
O2_FRACTION_FLOW = [(60.0, 11.0), (40.0, 8.0), (21.0, 5.0)]
O2_WARD_PREFIXES = ["T", "P", "HS"]
WARD_PREFIX_PATTERN = r"^(\D+)\d*"
FLOOR_INDEX_PATTERN = r"^\D+(\d+)\D*"
BED_INDEX_PATTERN = r".*?(\d+)\D?$"

# --- audit targets: output label -> source column -------------------------------
# 'pa02' is spelled with a zero in the published output
TARGETS = [
    ("spo2", "spo2"),
    ("map", "map"),
    ("pa02", "pao2"),
    ("ph", "ph"),
    ("hb", "hb"),
    ("fb", "fb"),
    ("rass", "rass"),
]

# --- out of hours: from 22:00 until before 07:00 --------------------------------
OUT_OF_HOURS_FROM = 22
OUT_OF_HOURS_UNTIL = 7
