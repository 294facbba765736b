"""Names shown for groups, keys and services."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ledgerloom.fixed_values import SERVICE_CODES


def unknown_label(key: Column) -> Column:
    """A key as shown: NULL and empty become ``unknown``."""
    return F.when(key.isNull() | (key == ""), F.lit("unknown")).otherwise(key)


def group_label(columns: Sequence[str]) -> str:
    return "+".join(columns)


def group_value(columns: Sequence[str]) -> Column:
    """The parts joined by `` / ``; a NULL part reads ``None``, an empty one ``unknown``."""
    parts = [
        F.when(F.col(c).isNull(), F.lit("None"))
        .when(F.col(c) == "", F.lit("unknown"))
        .otherwise(F.col(c))
        for c in columns
    ]
    return F.concat_ws(" / ", *parts)


def service_code(display_name: Column) -> Column:
    """Product code of a billing-API service name; unknown names pass through."""
    pairs = [F.lit(text) for pair in SERVICE_CODES for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), display_name), display_name)
