"""Oxygen demand of one set of readings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardflow.functions import fixed_values as fixed
from wardflow.functions.text import first_match, label_for


def device_flow(device: Column) -> Column:
    """Litres per minute assumed for a device, NULL for one without a rate."""
    return label_for(device, fixed.O2_DEVICE_FLOW).cast("double")


def oxygen_demand(flow: Column, fraction: Column, by_device: Column) -> Column:
    """Litres per minute: measured, else by device, else by inspired fraction, else 0."""
    by_fraction = first_match(
        (fraction > limit, F.lit(rate)) for limit, rate in fixed.O2_FRACTION_FLOW
    )
    return F.coalesce(
        flow.cast("double"),
        by_device,
        by_fraction,
        F.lit(0.0),
    )
