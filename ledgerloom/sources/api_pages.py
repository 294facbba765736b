"""Saved pages of the billing API, as nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.fixed_values import API_ZERO_COST
from ledgerloom.functions.labels import service_code

_AMOUNT = T.StructType(
    [T.StructField("Amount", T.StringType()), T.StructField("Unit", T.StringType())]
)
_METRICS = T.StructType(
    [
        T.StructField("UnblendedCost", _AMOUNT),
        T.StructField("BlendedCost", _AMOUNT),
        T.StructField("NetAmortizedCost", _AMOUNT),
    ]
)
API_PAGE = T.StructType(
    [
        T.StructField(
            "ResultsByTime",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "TimePeriod",
                            T.StructType(
                                [
                                    T.StructField("Start", T.StringType()),
                                    T.StructField("End", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "Groups",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("Keys", T.ArrayType(T.StringType())),
                                        T.StructField("Metrics", _METRICS),
                                    ]
                                )
                            ),
                        ),
                        T.StructField("Total", _METRICS),
                    ]
                )
            ),
        ),
        T.StructField("NextPageToken", T.StringType()),
    ]
)

_COSTS = {
    "total_unblended_cost": "UnblendedCost",
    "total_blended_cost": "BlendedCost",
    "total_net_amortized_cost": "NetAmortizedCost",
}


def read_api_pages(spark: SparkSession, *paths: str) -> DataFrame:
    """Pages as nested rows, one file per page."""
    return spark.read.schema(API_PAGE).json(list(paths), multiLine=True)


def _amounts(metrics: Column) -> dict[str, Column]:
    return {name: metrics[m]["Amount"].cast("double") for name, m in _COSTS.items()}


def api_groups(pages: DataFrame) -> DataFrame:
    """One row per day and group: usage_date, keys, and the three costs."""
    periods = pages.select(F.explode("ResultsByTime").alias("r"))
    groups = periods.select(
        F.col("r.TimePeriod.Start").cast("date").alias("usage_date"),
        F.explode("r.Groups").alias("g"),
    )
    amounts = _amounts(F.col("g.Metrics"))
    return groups.select(
        "usage_date",
        F.col("g.Keys").alias("keys"),
        *[amount.alias(name) for name, amount in amounts.items()],
    )


def drop_zero_costs(costs: DataFrame) -> DataFrame:
    """Without the rows whose three costs are all next to nothing."""
    noise = F.lit(True)
    for name in _COSTS:
        noise = noise & (F.abs(name) < API_ZERO_COST)
    return costs.filter(~noise)


def api_costs(pages: DataFrame) -> DataFrame:
    """Cost per day, account and product of pages grouped by service and account."""
    service = F.coalesce(F.get("keys", F.lit(0)), F.lit("Unknown"))
    account = F.coalesce(F.get("keys", F.lit(1)), F.lit(""))
    return drop_zero_costs(
        api_groups(pages).select(
            "usage_date",
            account.alias("usage_account_id"),
            service_code(service).alias("product_code"),
            *_COSTS,
        )
    )


def api_cost_by_dimension(
    pages: DataFrame, *, granularity: str = "DAILY", grouped: bool = True
) -> DataFrame:
    """(start, group_key, unblended_cost, net_amortized_cost) by the first group key.

    MONTHLY adds days up to months. Ungrouped, every group is added up; pages
    that carry only a total contribute it.
    """
    if granularity not in ("DAILY", "MONTHLY"):
        raise ValueError(f"granularity must be DAILY or MONTHLY, got {granularity!r}")
    by_group = api_groups(pages).select(
        "usage_date",
        F.get("keys", F.lit(0)).alias("group_key"),
        "total_unblended_cost",
        "total_net_amortized_cost",
    )
    total = _amounts(F.col("r.Total"))
    totals = (
        pages.select(F.explode("ResultsByTime").alias("r"))
        .filter(F.coalesce(F.size("r.Groups"), F.lit(0)) < 1)
        .filter(F.col("r.Total").isNotNull())
        .select(
            F.col("r.TimePeriod.Start").cast("date").alias("usage_date"),
            F.lit(None).cast("string").alias("group_key"),
            total["total_unblended_cost"].alias("total_unblended_cost"),
            total["total_net_amortized_cost"].alias("total_net_amortized_cost"),
        )
    )
    day = F.col("usage_date")
    key = F.col("group_key") if grouped else F.lit(None).cast("string")
    return (
        by_group.unionByName(totals)
        .groupBy(
            (day if granularity == "DAILY" else F.trunc(day, "month")).alias("start"),
            key.alias("group_key"),
        )
        .agg(
            F.sum("total_unblended_cost").alias("unblended_cost"),
            F.sum("total_net_amortized_cost").alias("net_amortized_cost"),
        )
    )
