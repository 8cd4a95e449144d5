"""Ward occupancy over time from bed moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.text import part
from wardflow.operators.intervals import interval_events
from wardflow.operators.neighbours import with_neighbours
from wardflow.operators.occupied import occupied_now
from wardflow.operators.prefix import with_running_totals
from wardflow.sources.ehr import EhrTables


def bed_stays(t: EhrTables) -> DataFrame:
    """Bed stays with their ward and hospital stay."""
    place = F.col("location_string")
    beds = t.location.where(part(place, 3) != fixed.NULL_TEXT).select(
        "location_id", "location_string", part(place, 1).alias("ward")
    )
    stays = t.location_visit.select(
        "location_visit_id",
        "hospital_visit_id",
        "location_id",
        F.col("admission_time").alias("bed_in"),
        F.col("discharge_time").alias("bed_dc"),
    ).join(beds, "location_id")
    visits = t.hospital_visit.select(
        "hospital_visit_id",
        F.col("admission_time").alias("hosp_in"),
        F.col("discharge_time").alias("hosp_dc"),
    )
    return stays.join(visits, "hospital_visit_id")


def occupancy(t: EhrTables) -> DataFrame:
    """One row per bed stay and event with the ward's occupancy at that time.

    The running sum goes back from now, so the count of beds in use now minus
    the sum is the occupancy before the event.  Wards with no bed in use now
    have no anchor and do not appear.
    """
    stays = bed_stays(t)
    anchors = occupied_now(stays, "ward", "location_string", "occupied")
    long = interval_events(
        with_neighbours(
            stays,
            "hospital_visit_id",
            "bed_in",
            "location_visit_id",
            {"ward_lag1": ("ward", 1)},
        ),
        ["hospital_visit_id", "location_visit_id", "location_string", "ward_lag1", "ward"],
    )
    events = with_running_totals(
        long,
        interval_events(stays, ["ward"]),
        "ts",
        "census",
        {"occupancy_raw": "ward"},
    )
    return events.join(anchors, "ward").select(
        "hospital_visit_id",
        "location_visit_id",
        "location_string",
        "ward_lag1",
        "ward",
        "event",
        "census",
        "ts",
        "occupancy_raw",
        (F.col("occupied") - F.col("occupancy_raw")).alias("occupancy"),
    )
