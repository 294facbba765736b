"""Calendar expressions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, functions as F


def utc_today() -> date:
    """Today in UTC, as a literal the scan can prune partitions with."""
    return datetime.now(timezone.utc).date()


def instant(moment: datetime) -> Column:
    """A zone-less timestamp literal, whatever the session zone is."""
    return F.expr(f"TIMESTAMP_NTZ'{moment.replace(tzinfo=None)}'")


def to_day(timestamp: Column) -> Column:
    return F.to_date(timestamp)


def days_between(column: str, start: date, end: date) -> Column:
    """Inclusive range over a date column."""
    return F.expr(f"{column} BETWEEN DATE'{start}' AND DATE'{end}'")


def instants_between(column: str, start: date, end: date) -> Column:
    """Inclusive day range over a timestamp column.

    The same rows as comparing the date part, but the column stays bare, so the
    predicate reaches the Parquet reader and row groups are skipped by statistics.
    """
    after = end + timedelta(days=1)
    return F.expr(f"{column} >= TIMESTAMP_NTZ'{start}' AND {column} < TIMESTAMP_NTZ'{after}'")


def islands(days: Iterable[date]) -> list[tuple[date, date]]:
    """Days as ranges without gaps."""
    found: list[tuple[date, date]] = []
    for day in sorted(days):
        if found and day - found[-1][1] <= timedelta(days=1):
            found[-1] = (found[-1][0], day)
        else:
            found.append((day, day))
    return found


def trunc_period(day: Column, unit: str) -> Column:
    """First date of the day, ISO week (Monday) or month a date lies in."""
    return day if unit == "day" else F.trunc(day, unit)


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def date_range(start: Column, end: Column) -> Column:
    """Every date from start to end inclusive; empty if start is after end."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(
        F.array().cast("array<date>")
    )


def billing_period(day: Column) -> Column:
    """``YYYYMM01-YYYYMM01`` of the month a date lies in."""
    first = month_start(day)
    return F.concat_ws(
        "-", F.date_format(first, "yyyyMMdd"), F.date_format(F.add_months(first, 1), "yyyyMMdd")
    )


def period_start(period: Column) -> Column:
    """First date of a billing period."""
    return F.to_date(F.substring(period, 1, 8), "yyyyMMdd")


def compact_period(start: Column, end: Column) -> Column:
    """Billing period of two ISO instants: their date parts, dashes dropped."""
    def compact(instant: Column) -> Column:
        return F.regexp_replace(F.split_part(instant, F.lit("T"), F.lit(1)), "-", "")

    return F.concat_ws("-", compact(start), compact(end))
