"""Calendar rules.

Every report takes an explicit ``as_of`` datetime. Window borders are worked
out from it on the driver, so that filters compare a column with a literal and
can be pushed to the scan.
"""

from __future__ import annotations

import calendar
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def stamp(moment: datetime) -> Column:
    """Timestamp literal read in the session time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def day_literal(moment: datetime | date) -> Column:
    day = moment.date() if isinstance(moment, datetime) else moment
    return F.lit(day.isoformat()).cast("date")


def midnight(moment: datetime) -> datetime:
    return datetime(moment.year, moment.month, moment.day)


def month_start(moment: datetime) -> datetime:
    return datetime(moment.year, moment.month, 1)


def month_end(moment: datetime) -> datetime:
    """Midnight of the last day of the month."""
    return datetime(moment.year, moment.month, calendar.monthrange(moment.year, moment.month)[1])


def days_before(moment: datetime, days: float) -> datetime:
    return moment - timedelta(days=days)


def shift_months(moment: datetime, months: int) -> datetime:
    """Move by whole months, keeping the time of day.

    The last day of a month moves to the last day of the other month
    (28 Feb + 1 = 31 Mar); any other day is kept or cut to the month's length.
    """
    index = moment.year * 12 + moment.month - 1 + months
    year, month = index // 12, index % 12 + 1
    length = calendar.monthrange(year, month)[1]
    at_end = moment.day == calendar.monthrange(moment.year, moment.month)[1]
    return moment.replace(year=year, month=month, day=length if at_end else min(moment.day, length))


def add_months(ts: Column, months: int) -> Column:
    """Column form of :func:`shift_months`."""
    moved = ts + F.make_ym_interval(F.lit(0), F.lit(months))
    to_end = F.datediff(F.last_day(moved), moved)
    snapped = moved + F.make_dt_interval(to_end)
    return F.when(F.to_date(ts) == F.last_day(ts), snapped).otherwise(moved)


def months_since(as_of: datetime, ts: Column) -> Column:
    """Months from ``ts`` to ``as_of``: whole when both fall on the same day of
    the month or both on a month end, else in 31-day fractions."""
    return F.months_between(stamp(as_of), ts, False)


def days_since(as_of: datetime, ts: Column) -> Column:
    """Elapsed days with a fraction."""
    return (F.unix_micros(stamp(as_of)) - F.unix_micros(ts)) / F.lit(float(MICROS_PER_DAY))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def padded_weekday(ts: Column) -> Column:
    """English weekday name, blank-padded to nine characters."""
    return F.rpad(F.date_format(ts, "EEEE"), 9, " ")
