"""Local dates, calendars and periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traymetrics.functions.numbers import as_col


def as_date(d) -> Column:
    """A date column from a column, a date or YYYY-MM-DD text."""
    return (d if isinstance(d, Column) else F.lit(d)).cast("date")


def local_date(ts, tz) -> Column:
    """F-6: the hall-local calendar date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(as_col(ts), as_col(tz)))


def local_hhmm(ts, tz) -> Column:
    return F.date_format(F.from_utc_timestamp(as_col(ts), as_col(tz)), "HH:mm")


def zoned_to_utc(date, hhmm, tz) -> Column:
    """F-7: hall-local wall time to the UTC instant, by two offset corrections.

    A wall time that exists twice gives its first instant; one that a clock change skips gives the
    instant one hour before the wall time would have been. Needs the session time zone UTC.
    """
    wall = F.to_timestamp(F.concat(F.date_format(as_col(date), "yyyy-MM-dd"), F.lit(" "), as_col(hhmm)), "yyyy-MM-dd HH:mm")
    once = wall + (wall - F.from_utc_timestamp(wall, as_col(tz)))
    return once + (wall - F.from_utc_timestamp(once, as_col(tz)))


def each_day(start, end) -> Column:
    """F-8: inclusive list of dates."""
    return F.sequence(as_col(start).cast("date"), as_col(end).cast("date"), F.expr("INTERVAL 1 DAY"))


def week_start(d) -> Column:
    """Monday of the week."""
    return F.to_date(F.date_trunc("week", as_col(d)))


def month_start(d) -> Column:
    return F.trunc(as_col(d), "MM")


def day_count(start, end) -> Column:
    return F.datediff(as_col(end), as_col(start)) + F.lit(1)


def period_bounds(today: Column) -> list[tuple[str, Column, Column]]:
    """The three headline periods that end today."""
    t = as_date(today)
    return [("today", t, t), ("week", week_start(t), t), ("month", month_start(t), t)]
