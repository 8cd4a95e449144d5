"""Previous and next rows of the same key, in time order.

A key may hold any share of the rows (a placeholder visit, or all rows without one), so a
window over a key isn't one task's work.  Every key is cut into cells: a time slot, and for
rows without a time a block of ids.  Cells of a key follow one another in the order of its rows.  A
window by cell answers all shifts that stay inside it.  Only the outermost rows of a cell reach into
others, and all rows they reach are outermost rows too; so a second window, by key for the
outermost rows alone and by cell for the others, answers the rest.  What meets by key grows with the calendar
and not with the rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions.times import SLOT_MINUTES, time_slot

# name of the new column -> (column, rows back; negative means rows ahead)
Shifts = Mapping[str, tuple[str, int]]

# ids per cell of the rows without a time, which are ordered by id alone
BLOCK_IDS = 1_000_000


def _shifted(name: str, source: str, offset: int, order) -> Column:
    return (F.lag(source, offset) if offset > 0 else F.lead(source, -offset)).over(order)


def with_neighbours(
    df: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    shifts: Shifts,
    slot: int = SLOT_MINUTES,
    block: int = BLOCK_IDS,
) -> DataFrame:
    """Add shifted columns in the order of (``ts``, ``row_id``), rows without a time last.

    Rows with a NULL key are one key.  A cell holds the rows that one key has in ``slot``
    minutes, or without a time in ``block`` consecutive ids.
    """
    reach = max(abs(offset) for _, offset in shifts.values())
    cells = df.withColumns(
        {
            "_slot": time_slot(F.col(ts), slot),
            "_block": F.when(F.col(ts).isNull(), F.floor(F.col(row_id) / block)),
        }
    )
    inside = Window.partitionBy(key, "_slot", "_block")
    forward = inside.orderBy(F.asc_nulls_last(ts), F.asc(row_id))
    # the rows up to the end of the cell, without a second sort in the other direction
    size = F.count(F.lit(1)).over(inside)
    placed = cells.withColumns(
        {
            "_after": F.row_number().over(forward) - 1,
            "_size": size,
            **{name: _shifted(name, *shift, forward) for name, shift in shifts.items()},
        }
    ).withColumn("_before", F.col("_size") - F.col("_after") - 1)
    is_outer = (F.col("_after") < reach) | (F.col("_before") < reach)
    # the outer rows of a key together, all others by their cell: one pass, and the rows below are read once
    apart = placed.withColumns(
        {
            "_outer": is_outer,
            "_far_slot": F.when(~is_outer, F.col("_slot")),
            "_far_block": F.when(~is_outer, F.col("_block")),
        }
    )
    whole = Window.partitionBy(key, "_outer", "_far_slot", "_far_block").orderBy(F.asc_nulls_last(ts), F.asc(row_id))

    def near_or_far(name: str, source: str, offset: int) -> Column:
        room = F.col("_after") >= offset if offset > 0 else F.col("_before") >= -offset
        return F.when(room, F.col(name)).otherwise(_shifted(name, source, offset, whole)).alias(name)

    return apart.select(*df.columns, *[near_or_far(name, *shift) for name, shift in shifts.items()])
