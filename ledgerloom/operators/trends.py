"""Cost over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.checks import (
    dimensions,
    filter_needs_group,
    granularity_unit,
    ordered_range,
    positive,
)
from ledgerloom.functions.amounts import coalesce_zero, display_round, pct_change
from ledgerloom.functions.dates import trunc_period
from ledgerloom.functions.labels import unknown_label
from ledgerloom.model import SUMMARY_MEASURE
from ledgerloom.operators.filters import for_group_value, from_source, in_range, since
from ledgerloom.operators.totals import group_costs


def total_daily_costs(
    summary: DataFrame,
    *,
    days: int = 14,
    data_source: str | None = None,
    reference_date: date | None = None,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """Total cost per day since ``days`` before the reference date."""
    rows = from_source(since(summary, days, reference_date), data_source)
    return group_costs(rows, ["usage_date"], measure, "total_cost")


def daily_trends(
    summary: DataFrame,
    *,
    days: int = 14,
    group_by: str = "product_code",
    top_n: int = 10,
    data_source: str | None = None,
    reference_date: date | None = None,
    end: date | None = None,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """Daily cost of the top groups with the change from the previous present day.

    One scan: days are folded into one array per group, the top groups are
    picked among those rows, and the change is read off the array. An array is
    as long as the window has days, whatever the number of line items.
    """
    (key,) = dimensions(group_by)
    rows = from_source(since(summary, days, reference_date, end), data_source)
    series = (
        group_costs(rows, [key, "usage_date"], measure)
        .groupBy(F.col(key).alias("group_value"))
        .agg(
            F.sort_array(F.collect_list(F.struct("usage_date", "cost"))).alias("points"),
            F.sum("cost").alias("total"),
        )
    )
    top = series.orderBy(
        F.col("total").desc_nulls_last(), F.col("group_value").asc_nulls_last()
    ).limit(positive(top_n, "top_n"))
    # a NULL group may take a place among the top but is not reported
    points = top.filter(F.col("group_value").isNotNull()).select(
        unknown_label(F.col("group_value")).alias("group_value"),
        F.inline(
            F.transform(
                "points",
                lambda p, i: F.struct(
                    p["usage_date"].alias("usage_date"),
                    p["cost"].alias("total_cost"),
                    F.get("points", i - 1)["cost"].alias("previous"),
                ),
            )
        ),
    )
    change = F.col("total_cost") - F.col("previous")
    return points.select(
        "usage_date",
        "group_value",
        "total_cost",
        change.alias("cost_change"),
        F.when(F.col("previous") > 0, pct_change(change, F.col("previous"))).alias("pct_change"),
    )


def cost_trend(
    summary: DataFrame,
    date_start: date,
    date_end: date,
    *,
    group_by: str | None = None,
    filter_value: str | None = None,
    granularity: str = "daily",
    data_source: str | None = None,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """Cost per day, week or month, optionally per group: (usage_date, group_value, cost)."""
    ordered_range(date_start, date_end)
    unit = granularity_unit(granularity)
    filter_needs_group(group_by, filter_value)
    rows = from_source(in_range(summary, date_start, date_end), data_source)
    group = F.lit(None).cast("string")
    if group_by:
        (key,) = dimensions(group_by)
        rows, group = for_group_value(rows, key, filter_value), F.col(key)
    return (
        rows.groupBy(
            trunc_period(F.col("usage_date"), unit).alias("usage_date"),
            group.alias("group_value"),
        )
        .agg(F.sum(measure).alias("cost"))
        .filter(F.col("cost").isNotNull())
    )


def trend_statistics(points: DataFrame) -> DataFrame:
    """One row over the displayed points: total, mean per point, least, greatest; zeros if none."""
    shown = points.select(display_round(F.col("cost"), 2).alias("cost"))
    total = display_round(F.sum("cost"), 2)
    return shown.agg(
        coalesce_zero(total).alias("total"),
        coalesce_zero(display_round(F.try_divide(total, F.count("*")), 2)).alias("average"),
        coalesce_zero(F.min("cost")).alias("min_cost"),
        coalesce_zero(F.max("cost")).alias("max_cost"),
    )
