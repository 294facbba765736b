"""One service's cost broken down by usage type, operation and resource."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from ledgerloom.checks import DETAIL_DIMENSIONS, ordered_range, require_rows
from ledgerloom.functions.amounts import coalesce_zero, pct_of_total
from ledgerloom.functions.labels import unknown_label
from ledgerloom.model import LINE_MEASURE
from ledgerloom.operators.filters import for_account, for_service, in_usage_days, usage_only
from ledgerloom.operators.totals import rank_within


def drill_down(
    line_items: DataFrame,
    service: str,
    date_start: date,
    date_end: date,
    *,
    account_id: str | None = None,
    top_n: int = 10,
    exclude_types: bool = False,
    strict: bool = False,
    measure: str = LINE_MEASURE,
) -> DataFrame:
    """(dimension, rank, key, cost, pct_of_total, usage_amount), and a ``total`` row.

    All breakdowns and the total come from one scan and one shuffle by grouping
    sets. Resources without an id are left out of their breakdown but count in
    the total every share refers to. Tax, fees and credits are included unless
    ``exclude_types``. ``strict`` raises when no line item matches.
    """
    ordered_range(date_start, date_end)
    rows = for_account(
        for_service(in_usage_days(line_items, date_start, date_end), service), account_id
    )
    rows = usage_only(rows) if exclude_types else rows
    if strict:
        require_rows(rows, f"no line items for {service} between {date_start} and {date_end}")
    keys = [F.col(c) for c in DETAIL_DIMENSIONS]
    cells = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.sum(measure).alias("cost"),
        F.sum("usage_amount").alias("usage_amount"),
        *[F.grouping(c).alias(f"{c}_rolled_up") for c in DETAIL_DIMENSIONS],
    )
    dimension, key = F.lit("total"), F.lit(None).cast("string")
    for name in DETAIL_DIMENSIONS:
        own = F.col(f"{name}_rolled_up") == 0
        dimension, key = F.when(own, name).otherwise(dimension), F.when(own, F.col(name)).otherwise(key)
    breakdown = cells.select(
        dimension.alias("dimension"), key.alias("key"), "cost", "usage_amount"
    ).filter(
        (F.col("dimension") != "resource_id") | (F.col("key").isNotNull() & (F.col("key") != ""))
    )
    ranked = rank_within(
        breakdown,
        ["dimension"],
        [F.col("cost").desc_nulls_last(), F.col("key").asc_nulls_last()],
        top_n,
    )
    # at most top_n rows per breakdown are left: the total may be set beside them
    total = F.when(F.col("dimension") == "total", coalesce_zero(F.col("cost")))
    beside = ranked.withColumn("total", F.max(total).over(Window.partitionBy(F.lit(0))))
    by_type = F.col("dimension") == "usage_type"
    return beside.select(
        "dimension",
        "rank",
        F.when(F.col("dimension") != "total", unknown_label(F.col("key"))).alias("key"),
        coalesce_zero(F.col("cost")).alias("cost"),
        pct_of_total(coalesce_zero(F.col("cost")), F.col("total")).alias("pct_of_total"),
        F.when(by_type, coalesce_zero(F.col("usage_amount"))).alias("usage_amount"),
    )
