"""The daily cost summary: built from line items, fed by the billing API."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ledgerloom.fixed_values import API_SOURCE, EXPORT_SOURCE
from ledgerloom.functions.dates import to_day
from ledgerloom.model import DAILY_SUMMARY, conform
from ledgerloom.operators.filters import in_usage_days, usage_only


def summarize_line_items(
    line_items: DataFrame, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Usage line items added up per day, account, product and region.

    ``start`` and ``end`` restrict the work to a range of days, with a predicate
    the line-item scan can prune by.
    """
    rows = usage_only(line_items)
    if start or end:
        rows = in_usage_days(rows, start or date.min, end or date(9998, 12, 31))
    return (
        rows.groupBy(
            to_day(F.col("usage_start_date")).alias("usage_date"),
            "usage_account_id",
            "product_code",
            "region",
        )
        .agg(
            F.sum("unblended_cost").alias("total_unblended_cost"),
            F.sum("blended_cost").alias("total_blended_cost"),
            F.sum("net_unblended_cost").alias("total_net_amortized_cost"),
            F.sum("usage_amount").alias("total_usage_amount"),
            F.count("*").alias("line_item_count"),
        )
        .withColumn("data_source", F.lit(EXPORT_SOURCE))
    )


def api_summary(api_costs: DataFrame) -> DataFrame:
    """API costs in the shape of the summary: no region, no usage, no line items."""
    return conform(
        api_costs.withColumns(
            {
                "region": F.lit(""),
                "total_usage_amount": F.lit(0.0),
                "line_item_count": F.lit(0),
                "data_source": F.lit(API_SOURCE),
            }
        ),
        DAILY_SUMMARY,
    )


def union_sources(*summaries: DataFrame) -> DataFrame:
    """Summaries of several sources as one table, matched by column name."""
    united = conform(summaries[0], DAILY_SUMMARY)
    for other in summaries[1:]:
        united = united.unionByName(conform(other, DAILY_SUMMARY))
    return united


def replace_source(summary: DataFrame, rebuilt: DataFrame, data_source: str = EXPORT_SOURCE) -> DataFrame:
    """The summary with all rows of one source replaced."""
    kept = summary.filter(~F.col("data_source").eqNullSafe(data_source))
    return union_sources(kept, rebuilt)


def replace_range(
    summary: DataFrame, incoming: DataFrame, data_source: str = API_SOURCE
) -> DataFrame:
    """The summary with one source replaced over the date range of ``incoming``.

    Dates inside the range that ``incoming`` lacks are removed as well; other
    dates and sources stay. Nothing incoming means nothing is replaced.
    """
    # one row; the tag is an aggregate so that the join keeps it as an equality key
    bounds = incoming.agg(
        F.max(F.lit(data_source)).alias("data_source"),
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
    )
    kept = summary.alias("s").join(
        bounds.alias("b"),
        (F.col("s.data_source") == F.col("b.data_source"))
        & (F.col("s.usage_date") >= F.col("b.first_date"))
        & (F.col("s.usage_date") <= F.col("b.last_date")),
        "left_anti",
    )
    return union_sources(kept, incoming.withColumn("data_source", F.lit(data_source)))


def preferred_source(summary: DataFrame) -> DataFrame:
    """Rows of the API source if it has any, else the other rows."""
    from_api = F.bool_or(F.col("data_source") == API_SOURCE)
    sources = summary.agg(
        F.when(from_api, API_SOURCE).otherwise(EXPORT_SOURCE).alias("data_source")
    )
    return summary.join(sources, "data_source", "left_semi")
