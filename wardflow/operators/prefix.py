"""Running totals over few, large groups, newest first.

A window partitioned by ward (or by "critical care yes/no") is one task per group.  Here the
calendar is cut into slots of a fixed length.  The total of every slot is folded with map-side
combine; running over the slots of a group gives the carry into each slot; the carry then takes
part as one more row, ahead of the others, in a window partitioned by group and slot.

An open (NULL) time is later than all others.  The rows without a time are peers, so their running
sum is one number per group; they are taken apart for that and never meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardflow.functions.times import SLOT_MINUTES, time_slot
from wardflow.operators.joins import null_safe_join


def slot_carries(rows: DataFrame, group: str) -> DataFrame:
    """(group, _slot, _value): the sum of all ``_value`` in later slots, open times among them.

    The row of the NULL slot holds the sum of the open times themselves.  The window has a row for
    each slot of a group: it grows with the calendar.
    """
    later = (
        Window.partitionBy(group)
        .orderBy(F.desc_nulls_first("_slot"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(group, "_slot").agg(F.sum("_value").alias("_total"))
    carried = F.when(F.col("_slot").isNull(), F.col("_total")).otherwise(F.sum("_total").over(later))
    return totals.select(group, "_slot", carried.alias("_value"), F.lit(True).alias("_carry"))


def running_total(
    df: DataFrame, group: str, ts: str, value: Column, name: str = "running", slot: int = SLOT_MINUTES
) -> DataFrame:
    """One row per (group, ts) with the sum of all values at or after it.

    Rows of the same instant are folded before anything is shuffled, so no window sees more than
    the distinct instants of a slot.
    """
    slotted = df.select(group, time_slot(F.col(ts), slot).alias("_slot"), ts, value.alias("_value"))
    cells = slotted.groupBy(group, "_slot", ts).agg(F.sum("_value").alias("_value"))
    carries = slot_carries(cells, group)
    within = (
        Window.partitionBy("_slot", group)
        .orderBy(F.desc("_carry"), F.desc(ts))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    dated = cells.where(F.col(ts).isNotNull()).withColumn("_carry", F.lit(False))
    summed = (
        dated.unionByName(carries.where(F.col("_slot").isNotNull()), allowMissingColumns=True)
        .withColumn(name, F.sum("_value").over(within))
        .where(~F.col("_carry"))
        .select(group, ts, name)
    )
    open_ = cells.where(F.col(ts).isNull()).select(group, ts, F.col("_value").alias(name))
    return summed.unionByName(open_)


def running_totals(
    moves: DataFrame, ts: str, value: str, groups: dict[str, str], slot: int = SLOT_MINUTES
) -> DataFrame:
    """One row per (groups, ts) with all running sums: for each, what its group has at or after ``ts``.

    ``groups`` maps each new column to the column it is partitioned by.  Moves of the same groups and
    instant are folded before anything is shuffled; one exchange by slot serves all sums.
    """
    keys = list(dict.fromkeys(groups.values()))
    cells = (
        moves.groupBy(*keys, time_slot(F.col(ts), slot).alias("_slot"), ts)
        .agg(F.sum(value).alias("_value"))
    )
    by_slot = cells.groupBy(*keys, "_slot").agg(F.sum("_value").alias("_value"))
    dated = cells.where(F.col(ts).isNotNull())
    stream = dated.withColumns({"_carry": F.lit(False), **{f"_{name}": F.col("_value") for name in groups}})
    for name, group in groups.items():
        carry = slot_carries(by_slot, group).withColumnRenamed("_value", f"_{name}")
        stream = stream.unionByName(carry.where(F.col("_slot").isNotNull()), allowMissingColumns=True)
    # hash(slot) also is a clustering by (ward, slot) and by (critical care, slot)
    stream = stream.repartition("_slot")
    for name, group in groups.items():
        # cells of the same instant are peers: the default frame includes them all
        order = Window.partitionBy("_slot", group).orderBy(F.desc("_carry"), F.desc(ts))
        stream = stream.withColumn(name, F.sum(f"_{name}").over(order))
    # open times: a row for each combination of groups is left by the fold
    open_cells = cells.where(F.col(ts).isNull())
    for name, group in groups.items():
        open_cells = open_cells.withColumn(name, F.sum("_value").over(Window.partitionBy(group)))
    columns = [*keys, ts, *groups]
    return stream.where(~F.col("_carry")).select(*columns).unionByName(open_cells.select(*columns))


def with_running_totals(
    rows: DataFrame,
    moves: DataFrame,
    ts: str,
    value: str,
    groups: dict[str, str],
    slot: int = SLOT_MINUTES,
) -> DataFrame:
    """Add running sums of ``value``, newest first, to wide rows.

    ``moves`` holds the same (groups, ts, value) as ``rows`` from a cheaper source.  The sums are
    found on narrow, folded moves; each wide row is shuffled once, to meet the one row of its groups and
    instant.  An instant that very many rows have (a default time, or an open one) is a skewed key
    of that join, whose rows adaptive execution deals to several tasks.
    """
    totals = running_totals(moves, ts, value, groups, slot)
    return null_safe_join(rows, totals, [*dict.fromkeys(groups.values()), ts], "inner")
