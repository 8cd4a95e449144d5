"""The pipelines as views of the session."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from wardflow.plans import bedside, census, cohorts, occupancy, oxygen, reference_data
from wardflow.sources.ehr import EhrTables

AsOf = datetime | str | None

# name -> builder(tables, as_of)
PIPELINES: dict[str, Callable[[EhrTables, AsOf], DataFrame]] = {
    "current_bed": bedside.current_bed,
    "hospital_visit_1": bedside.hospital_visit_1,
    "hospital_visit_2": bedside.hospital_visit_2,
    "hospital_visit_3": bedside.hospital_visit_3,
    "lactate": bedside.lactate,
    "vital_signs": bedside.vital_signs,
    "visit_observation_type": lambda t, _: reference_data.visit_observation_type(t),
    "location": lambda t, _: reference_data.location(t),
    "cc_filter": lambda t, _: cohorts.cc_filter(t),
    "niv_filter": lambda t, _: cohorts.niv_filter(t),
    "alltargets_long": lambda t, _: reference_data.alltargets_long(t),
    "occupancy": lambda t, _: occupancy.occupancy(t),
    "census_plus": census.census_plus,
    "census_cc": census.census_cc,
    "oxygen": oxygen.oxygen,
}


def create_views(
    t: EhrTables,
    as_of: AsOf = None,
    names: Iterable[str] = tuple(PIPELINES),
    replace: bool = True,
    prefix: str = "",
) -> list[str]:
    """Register pipelines as temporary views; they are recomputed at every read."""
    created = []
    for name in names:
        df = PIPELINES[name](t, as_of)
        create = df.createOrReplaceTempView if replace else df.createTempView
        create(f"{prefix}{name}")
        created.append(f"{prefix}{name}")
    return created


def drop_views(spark: SparkSession, names: Iterable[str]) -> None:
    """Drop views; a view that does not exist is passed over."""
    for name in names:
        spark.catalog.dropTempView(name)
