"""Two periods of the summary compared by one dimension."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.checks import dimensions, ordered_range
from ledgerloom.functions.dates import days_between
from ledgerloom.model import SUMMARY_MEASURE
from ledgerloom.operators.changes import (
    change_totals,
    largest_changes,
    two_sided_costs,
    with_changes,
)
from ledgerloom.operators.filters import from_source

Period = tuple[date, date]


def period_costs(
    summary: DataFrame,
    period_a: Period,
    period_b: Period,
    *,
    group_by: str = "product_code",
    data_source: str | None = None,
    null_safe: bool = False,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """(group_value, side, a_cost, b_cost) of every group present in either period."""
    ordered_range(*period_a, what="period_a")
    ordered_range(*period_b, what="period_b")
    (key,) = dimensions(group_by)
    rows = from_source(summary, data_source).withColumnRenamed(key, "group_value")
    return two_sided_costs(
        rows,
        ["group_value"],
        days_between("usage_date", *period_a),
        days_between("usage_date", *period_b),
        F.col(measure),
        null_safe=null_safe,
    )


def compare_periods(
    summary: DataFrame,
    period_a: Period,
    period_b: Period,
    *,
    group_by: str = "product_code",
    top_n: int = 10,
    data_source: str | None = None,
    null_safe: bool = False,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """(category, rank, group_value, a_cost, b_cost, absolute_change, pct_change).

    Movers are cut to the ``top_n`` of greatest absolute change and ranked. New
    and disappeared groups are all kept, with no rank: each is a partition of its
    own in the ranking, so that list is never gathered in one task.
    """
    costs = period_costs(
        summary,
        period_a,
        period_b,
        group_by=group_by,
        data_source=data_source,
        null_safe=null_safe,
        measure=measure,
    )
    mover = F.col("category") == "mover"
    own_partition = F.when(~mover, F.struct("group_value", "side"))
    ranked = largest_changes(
        with_changes(costs), ["category", own_partition], "group_value", top_n
    )
    return ranked.select(
        "category",
        F.when(mover, F.col("rank")).alias("rank"),
        "group_value",
        "a_cost",
        "b_cost",
        "absolute_change",
        "pct_change",
    )


def comparison_totals(
    summary: DataFrame, period_a: Period, period_b: Period, **options
) -> DataFrame:
    """One row: totals of both periods over every group, and the change."""
    return change_totals(period_costs(summary, period_a, period_b, **options))
