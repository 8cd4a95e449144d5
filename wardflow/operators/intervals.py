"""Intervals and flags from wide to long."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BED_IN = "bed_in"
BED_OUT = "bed_dc"


def interval_events(stays: DataFrame, keep: list[str]) -> DataFrame:
    """Two rows (event, ts, census) per bed stay.

    An open stay keeps its end with NULL ts.  ``census`` is +1 for entering a bed,
    -1 for leaving it and 0 while it is still occupied.  The rows are generated
    from an array: unlike an unpivot it keeps what Spark knows about the other
    columns, so equal plans above it are recognised as equal and run once.
    """
    leaving = F.when(F.col(BED_OUT).isNull(), 0).otherwise(-1)
    ends = F.array(
        *[
            F.struct(
                F.lit(event).alias("event"),
                F.col(event).alias("ts"),
                step.alias("census"),
            )
            for event, step in [(BED_IN, F.lit(1)), (BED_OUT, leaving)]
        ]
    )
    return stays.select(*keep, F.inline(ends))


def flags_to_long(
    df: DataFrame, keep: list[str], flags: list[tuple[str, str]], name: str, value: str
) -> DataFrame:
    """One row per (row, flag); ``flags`` are (label, column); NULL flags stay."""
    labelled = df.select(*keep, *[F.col(column).alias(label) for label, column in flags])
    return labelled.unpivot(keep, [label for label, _ in flags], name, value)
