"""As-of join: for every event the latest state at or before its time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wardflow.functions.times import SLOT_MINUTES, time_slot


def asof_join(
    events: DataFrame,
    states: DataFrame,
    key: str,
    event_time: str,
    state_time: str,
    state_id: str,
    payload: list[str],
    slot: int = SLOT_MINUTES,
) -> DataFrame:
    """Events with ``payload`` of their state; events without a state are dropped.

    States with the same time are told apart by the larger ``state_id``; the end of a state is not
    looked at.  Both sides are merged in time order and the state is carried forward, in windows
    by key and time slot, so that a key may hold any share of the rows.  The last state of every
    slot is folded with map-side combine; running over a key's slots gives the state that each slot
    begins with, which takes part as one more row.
    """
    events = events.dropna(subset=[key, event_time])
    states = states.dropna(subset=[key, state_time])
    state = F.struct(F.col(state_time).alias("_since"), F.col(state_id).alias("_id"), *payload)
    known = states.select(
        key, time_slot(F.col(state_time), slot).alias("_slot"), F.col(state_time).alias("_t"), state.alias("_state")
    )
    asked = events.withColumns({"_slot": time_slot(F.col(event_time), slot), "_t": F.col(event_time)})
    by_slot = (
        known.select(key, "_slot", "_state")
        .unionByName(asked.select(key, "_slot"), allowMissingColumns=True)
        .groupBy(key, "_slot")
        .agg(F.max("_state").alias("_state"))
    )
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_slot.select(
        key, "_slot", F.last("_state", ignorenulls=True).over(earlier).alias("_state")
    ).where(F.col("_state").isNotNull())
    # at one time the state carried in comes first, then states, then events
    merged = (
        asked.withColumn("_kind", F.lit(2))
        .unionByName(known.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
        .unionByName(carried.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    )
    order = (
        Window.partitionBy(key, "_slot")
        .orderBy(F.asc_nulls_first("_t"), "_kind", "_state._id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        merged.withColumn("_state", F.last("_state", ignorenulls=True).over(order))
        .where((F.col("_kind") == 2) & F.col("_state").isNotNull())
        .select(*events.columns, *[F.col(f"_state.{c}").alias(c) for c in payload])
    )
