"""Look-ups on monitoring, budget and account tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from ledgerloom.functions.dates import instant


def metric_hourly(
    metrics: DataFrame, end: datetime, *, hours: int = 24, value: str = "value", ts: str = "ts"
) -> DataFrame:
    """(hour, maximum, average) of a metric over the last hours before ``end``, at least one."""
    start = end - timedelta(hours=max(hours, 1))
    recent = metrics.filter((F.col(ts) >= instant(start)) & (F.col(ts) < instant(end)))
    return (
        recent.groupBy(F.window(ts, "1 hour").alias("hour"))
        .agg(F.max(value).alias("maximum"), F.avg(value).alias("average"))
        .withColumn("hour", F.col("hour.start"))
    )


def alarms_active(alarms: DataFrame, limit: int | None = None) -> DataFrame:
    """Alarms in state ALARM by name: all of them, unless the caller gives a limit."""
    active = alarms.filter(F.col("state") == "ALARM").orderBy("name")
    return active if limit is None else active.limit(limit)


def budget_status(budgets: DataFrame, spend: DataFrame) -> DataFrame:
    """Budgets (account_id, name, budget_limit, forecast) beside what was spent.

    ``spend`` is (account_id, actual_spend); an account without spend has none.
    The forecast is reported as given.
    """
    return budgets.join(spend, "account_id", "left").select(
        "account_id",
        "name",
        "budget_limit",
        F.coalesce("actual_spend", F.lit(0.0)).alias("actual_spend"),
        "forecast",
    )


def account_enrich(costs: DataFrame, accounts: DataFrame) -> DataFrame:
    """Costs with the name and status of their account; unknown accounts are kept.

    No join is forced: a small account table is broadcast by its size, a large
    one is shuffled.
    """
    return costs.join(
        accounts.select(
            F.col("account_id").alias("usage_account_id"),
            F.col("name").alias("account_name"),
            F.col("status").alias("account_status"),
        ),
        "usage_account_id",
        "left",
    )
