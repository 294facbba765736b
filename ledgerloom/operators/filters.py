"""Row filters shared by the operators."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from ledgerloom.checks import dimensions
from ledgerloom.fixed_values import NON_USAGE_TYPES
from ledgerloom.functions.dates import days_between, instants_between, utc_today


def in_range(summary: DataFrame, start: date, end: date) -> DataFrame:
    """Usage dates from start to end, both inclusive."""
    return summary.filter(days_between("usage_date", start, end))


def since(
    summary: DataFrame, days: int, reference_date: date | None = None, end: date | None = None
) -> DataFrame:
    """Usage dates from ``days`` before the reference date on; open-ended unless ``end``."""
    start = (reference_date or utc_today()) - timedelta(days=days)
    kept = summary.filter(F.col("usage_date") >= F.lit(start))
    return kept.filter(F.col("usage_date") <= F.lit(end)) if end else kept


def from_source(summary: DataFrame, data_source: str | None) -> DataFrame:
    """Rows of one source; no source means the sources are summed."""
    return summary.filter(F.col("data_source") == data_source) if data_source else summary


def for_service(df: DataFrame, service: str) -> DataFrame:
    return df.filter(F.col("product_code") == service)


def for_account(df: DataFrame, account_id: str | None) -> DataFrame:
    return df.filter(F.col("usage_account_id") == account_id) if account_id else df


def for_group_value(summary: DataFrame, group_by: str, value: str | None) -> DataFrame:
    (column,) = dimensions(group_by)
    return summary.filter(F.col(column) == value) if value else summary


def usage_only(line_items: DataFrame) -> DataFrame:
    """Without tax, fees, credits and the like; a NULL type is dropped too."""
    return line_items.filter(~F.col("line_item_type").isin(*NON_USAGE_TYPES))


def in_usage_days(line_items: DataFrame, start: date, end: date) -> DataFrame:
    """Line items whose usage starts on a day from start to end."""
    return line_items.filter(instants_between("usage_start_date", start, end))


def with_resource(line_items: DataFrame) -> DataFrame:
    return line_items.filter(F.col("resource_id").isNotNull() & (F.col("resource_id") != ""))


def in_top(df: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``top``. A limit tells Spark its size, so it is broadcast."""
    return df.join(top.select(key), key, "left_semi")
