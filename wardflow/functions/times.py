"""Time expressions on TIMESTAMP_NTZ columns, independent of the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wardflow.functions import fixed_values as fixed

# The time slots in which ordered work is cut, for every key and size of table: at 10^12
# rows over ten years about three million rows of all keys together.
SLOT_MINUTES = 15


def as_of_time(as_of: datetime | str | None) -> Column:
    """The moment a pipeline calls "now"; the wall clock when none is given."""
    if as_of is None:
        return F.localtimestamp()
    return F.lit(str(as_of)).cast("timestamp_ntz")


def ago(as_of: datetime | str | None, window: str) -> Column:
    """``window`` is an interval such as ``"12 HOURS"`` or ``"3 MONTHS"``."""
    return as_of_time(as_of) - F.expr(f"INTERVAL {window}")


def later_than(df: DataFrame, column: str, moment: Column) -> DataFrame:
    """The rows whose ``column`` is later; in a table partitioned by its date, only from that date on.

    The date's column is called as ``column`` with ``_date`` at its end.
    """
    recent = df.where(F.col(column) > moment)
    date = f"{column}_date"
    return recent.where(F.col(date) >= F.to_date(moment)) if date in df.columns else recent


def hour_floor(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def time_slot(ts: Column, minutes: int) -> Column:
    """First minute of the ``minutes``-long slot of the wall clock: a coarse, ordered key.

    An open (NULL) time has none.
    """
    days = F.unix_date(F.to_date(ts)).cast("long")
    minute = days * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return minute - F.pmod(minute, F.lit(minutes))


def age_years(born: Column, as_of: datetime | str | None = None) -> Column:
    """Completed calendar years on the as-of day; a leapling ages on 1 March."""
    today = F.to_date(as_of_time(as_of))
    return F.when(born <= today, _full_years(born, today)).when(
        born > today, -_full_years(today, born)
    )


def _full_years(start: Column, end: Column) -> Column:
    day_of_year = lambda d: F.month(d) * 100 + F.day(d)
    before_birthday = F.when(day_of_year(end) < day_of_year(start), 1).otherwise(0)
    return (F.year(end) - F.year(start) - before_birthday).cast("double")


def out_of_hours(ts: Column) -> Column:
    late = F.hour(ts) >= fixed.OUT_OF_HOURS_FROM
    early = F.hour(ts) < fixed.OUT_OF_HOURS_UNTIL
    return F.coalesce(late | early, F.lit(False))
