"""Argument checks and label maps, all decided before a plan is built."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame

from ledgerloom.fixed_values import API_SOURCE, DEFAULT_THRESHOLD, EXPORT_SOURCE, SENSITIVITY

SUMMARY_DIMENSIONS = ("product_code", "usage_account_id", "region")
DETAIL_DIMENSIONS = ("usage_type", "operation", "resource_id")
GRANULARITIES = {"daily": "day", "weekly": "week", "monthly": "month"}

# What a user calls a grouping or a source, and the columns or tag it means.
GROUP_LABELS = {
    "service": ("product_code",),
    "account": ("usage_account_id",),
    "region": ("region",),
    "service+account": ("product_code", "usage_account_id"),
    "service+region": ("product_code", "region"),
    "account+region": ("usage_account_id", "region"),
}
SOURCE_LABELS = {"cur": EXPORT_SOURCE, "cost-explorer": API_SOURCE, "all": None}


def dimensions(group_by: str | Iterable[str], allowed=SUMMARY_DIMENSIONS) -> list[str]:
    """The grouping columns as a list; anything outside ``allowed`` is an error."""
    columns = [group_by] if isinstance(group_by, str) else list(group_by)
    unknown = [c for c in columns if c not in allowed]
    if unknown or not columns:
        raise ValueError(f"group_by must name columns of {sorted(allowed)}, got {columns}")
    return columns


def group_columns(label: str) -> tuple[str, ...]:
    if label not in GROUP_LABELS:
        raise ValueError(f"unknown grouping {label!r}; use one of {sorted(GROUP_LABELS)}")
    return GROUP_LABELS[label]


def source_tag(label: str) -> str | None:
    if label not in SOURCE_LABELS:
        raise ValueError(f"unknown source {label!r}; use one of {sorted(SOURCE_LABELS)}")
    return SOURCE_LABELS[label]


def ordered_range(start: date, end: date, what: str = "date") -> None:
    if start > end:
        raise ValueError(f"{what}_start ({start}) must be <= {what}_end ({end})")


def granularity_unit(granularity: str) -> str:
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {sorted(GRANULARITIES)}, got {granularity!r}")
    return GRANULARITIES[granularity]


def filter_needs_group(group_by: str | None, filter_value: str | None) -> None:
    if filter_value and not group_by:
        raise ValueError("filter_value requires group_by")


def positive(value: int, what: str) -> int:
    if value < 1:
        raise ValueError(f"{what} must be at least 1, got {value}")
    return value


def sensitivity_threshold(sensitivity: str) -> float:
    """Least absolute z that is flagged; an unknown label means medium."""
    return SENSITIVITY.get(sensitivity, DEFAULT_THRESHOLD)


def threshold_label(threshold: float) -> str:
    """The sensitivity label a configured z threshold stands for."""
    if threshold >= SENSITIVITY["low"]:
        return "low"
    return "medium" if threshold >= SENSITIVITY["medium"] else "high"


def month_period(month: str) -> str:
    """``YYYY-MM`` as the billing period of that month."""
    found = re.fullmatch(r"(\d{4})-(\d{2})", month)
    if not found or not 1 <= int(found[2]) <= 12:
        raise ValueError(f"invalid month {month!r}; use YYYY-MM")
    first = date(int(found[1]), int(found[2]), 1)
    following = date(first.year + first.month // 12, first.month % 12 + 1, 1)
    return f"{first:%Y%m%d}-{following:%Y%m%d}"


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise if ``df`` has no row. Runs a job that stops at the first row found."""
    if df.isEmpty():
        raise ValueError(message)
    return df
