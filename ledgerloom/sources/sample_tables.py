"""The order, part and event sample tables in the shape of the billing model.

Line items come from ``lineitem`` with its part and supplier, the second source
from ``events``. Amounts are put on a grid of 1/64: sums of such doubles are
exact in any order, so results do not depend on how Spark split the work and
can be compared bit by bit.

Schemas are declared, so no job is run to infer them. The side tables are joined
without hints: Spark broadcasts them where their size allows and shuffles, with
skew handling, where it does not.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.fixed_values import API_SOURCE, EXPORT_SOURCE
from ledgerloom.functions.dates import instants_between
from ledgerloom.model import LINE_ITEMS
from ledgerloom.operators.filters import in_usage_days, usage_only
from ledgerloom.operators.summary import api_summary, summarize_line_items, union_sources

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_type string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}
FROM_PART = {"product_code", "product_name", "usage_type"}
FROM_PLACE = {"usage_account_id", "region"}
API_COSTS = ("total_unblended_cost", "total_blended_cost", "total_net_amortized_cost")
DIMENSIONS = ("usage_account_id", "product_code", "region")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def grid(amount: str) -> str:
    return f"FLOOR(({amount}) * 64 + 0.5D) / 64"


_MONTH = "TRUNC(CAST(l_shipdate AS DATE), 'month')"
_LINE_ITEM = {
    "line_item_id": "CONCAT_WS('-', l_orderkey, l_linenumber)",
    "usage_start_date": "l_shipdate",
    "usage_end_date": "l_shipdate + INTERVAL 1 DAY",
    "billing_period_start": _MONTH,
    "billing_period_end": f"ADD_MONTHS({_MONTH}, 1)",
    "payer_account_id": "'999999999999'",
    "usage_account_id": "n_name",
    "product_code": "p_type",
    "product_name": "p_type",
    "region": "r_name",
    "availability_zone": "CAST(NULL AS STRING)",
    "usage_type": "p_brand",
    "operation": "l_linestatus",
    # a refund belongs to no resource
    "resource_id": "CASE WHEN l_returnflag <> 'R' THEN CONCAT('part-', l_partkey) END",
    "line_item_type": "CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Usage' END",
    "unblended_cost": grid("l_extendedprice"),
    "blended_cost": grid("l_extendedprice * (1 - l_discount)"),
    "net_unblended_cost": grid("l_extendedprice * (1 - l_discount) * (1 + l_tax)"),
    "usage_amount": "l_quantity",
    "currency_code": "'USD'",
    "line_item_description": "CAST(NULL AS STRING)",
    "billing_entity": "CASE WHEN l_linestatus = 'F' THEN 'AWS Marketplace' ELSE 'AWS' END",
    "_ingested_at": "CAST(NULL AS TIMESTAMP_NTZ)",
    "_source_file": "'lineitem.parquet'",
}


def line_items(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """``lineitem`` as billing line items.

    ``columns`` names the wanted ones. A side table none of them needs is not
    joined; the joins keep every line item, so the rows are the same either way.
    """
    names = list(columns or LINE_ITEMS.names)
    rows = table(spark, sf_dir, "lineitem")
    if FROM_PART & set(names):
        rows = rows.join(
            table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left"
        )
    if FROM_PLACE & set(names):
        # one after the other: each join is then planned by the size of its own table
        rows = rows.join(
            table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
        ).join(
            table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left"
        )
    if "region" in names:
        rows = rows.join(
            table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
    return rows.selectExpr(*[f"{_LINE_ITEM[name]} AS {name}" for name in names])


def api_rows(
    spark: SparkSession, sf_dir: str, start: date | None = None, end: date | None = None
) -> DataFrame:
    """``events`` as costs per day, account and product, not yet added up."""
    events = table(spark, sf_dir, "events")
    if start and end:
        events = events.filter(instants_between("ts", start, end))
    return events.selectExpr(
        "CAST(ts AS DATE) AS usage_date",
        "CAST(user_id % 5 AS STRING) AS usage_account_id",
        "event_type AS product_code",
        *[f"{grid('value')} AS {cost}" for cost in API_COSTS],
    )


def api_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`api_rows` added up per day, account and product, as the billing API reports them."""
    return (
        api_rows(spark, sf_dir)
        .groupBy("usage_date", "usage_account_id", "product_code")
        .agg(*[F.sum(cost).alias(cost) for cost in API_COSTS])
    )


def daily_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily cost summary of both sources."""
    return union_sources(
        summarize_line_items(line_items(spark, sf_dir)), api_summary(api_cells(spark, sf_dir))
    )


def summary_rows(
    spark: SparkSession,
    sf_dir: str,
    by: Sequence[str] = DIMENSIONS,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """Both sources in the columns of the summary, not yet added up.

    Operators on the summary add up by their own, coarser keys; adding up to its
    fine grain first would be one more shuffle for the same sums. ``by`` names
    the dimensions an operator uses, and a date range reaches both scans.
    """
    detail = usage_only(
        line_items(
            spark, sf_dir, ["usage_start_date", "line_item_type", "net_unblended_cost",
                            "unblended_cost", *by]
        )
    )
    if start and end:
        detail = in_usage_days(detail, start, end)
    kept = ["usage_date", *by, "total_unblended_cost", "total_net_amortized_cost", "data_source"]
    exported = detail.selectExpr(
        "CAST(usage_start_date AS DATE) AS usage_date",
        *by,
        "unblended_cost AS total_unblended_cost",
        "net_unblended_cost AS total_net_amortized_cost",
        f"'{EXPORT_SOURCE}' AS data_source",
    )
    fetched = api_rows(spark, sf_dir, start, end).selectExpr(
        "*", "'' AS region", f"'{API_SOURCE}' AS data_source"
    )
    return exported.select(*kept).unionByName(fetched.select(*kept))
