"""What changed inside one service between two periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerloom.checks import dimensions, ordered_range, require_rows
from ledgerloom.functions.dates import instants_between
from ledgerloom.functions.labels import unknown_label
from ledgerloom.model import LINE_MEASURE
from ledgerloom.operators.changes import (
    change_totals,
    largest_changes,
    two_sided_costs,
    with_changes,
)
from ledgerloom.operators.comparison import Period
from ledgerloom.operators.filters import for_account, for_service, usage_only

ATTRIBUTION_DIMENSIONS = ("usage_type", "resource_id")


def _service_rows(
    line_items: DataFrame, service: str, account_id: str | None, exclude_types: bool
) -> DataFrame:
    rows = for_account(for_service(line_items, service), account_id)
    return usage_only(rows) if exclude_types else rows


def detail_period_costs(
    line_items: DataFrame,
    service: str,
    period_a: Period,
    period_b: Period,
    *,
    account_id: str | None = None,
    by=ATTRIBUTION_DIMENSIONS,
    exclude_types: bool = False,
    strict: bool = False,
    null_safe: bool = False,
    measure: str = LINE_MEASURE,
) -> DataFrame:
    """(dimension, key, side, a_cost, b_cost) of every key present in either period.

    A line item counts once under each dimension, so both breakdowns share one
    scan and one shuffle.
    """
    ordered_range(*period_a, what="period_a")
    ordered_range(*period_b, what="period_b")
    chosen = dimensions(by, ATTRIBUTION_DIMENSIONS)
    in_a = instants_between("usage_start_date", *period_a)
    in_b = instants_between("usage_start_date", *period_b)
    rows = _service_rows(line_items, service, account_id, exclude_types).filter(in_a | in_b)
    if strict:
        require_rows(rows, f"no line items for {service} in either period")
    named = rows.select(
        in_a.alias("in_a"),
        in_b.alias("in_b"),
        F.col(measure).alias("cost"),
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("key")) for c in chosen]
            )
        ),
    )
    return two_sided_costs(
        named,
        ["dimension", "key"],
        F.col("in_a"),
        F.col("in_b"),
        F.col("cost"),
        null_safe=null_safe,
    )


def attribute_change(
    line_items: DataFrame,
    service: str,
    period_a: Period,
    period_b: Period,
    *,
    top_n: int = 10,
    **options,
) -> DataFrame:
    """(dimension, category, rank, key, a_cost, b_cost, absolute_change, pct_change).

    Every category of every dimension is cut to its ``top_n`` greatest changes.
    """
    costs = detail_period_costs(line_items, service, period_a, period_b, **options)
    ranked = largest_changes(with_changes(costs), ["dimension", "category"], "key", top_n)
    return ranked.select(
        "dimension",
        "category",
        "rank",
        unknown_label(F.col("key")).alias("key"),
        "a_cost",
        "b_cost",
        "absolute_change",
        "pct_change",
    )


def attribution_totals(
    line_items: DataFrame, service: str, period_a: Period, period_b: Period, **options
) -> DataFrame:
    """One row: the service's totals in both periods and the change."""
    costs = detail_period_costs(
        line_items, service, period_a, period_b, by="usage_type", **options
    )
    return change_totals(costs)
