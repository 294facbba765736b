"""Plain aggregates and their orderings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.checks import positive
from ledgerloom.functions.amounts import coalesce_zero
from ledgerloom.model import SUMMARY_MEASURE


def group_costs(
    df: DataFrame, keys: Sequence[str], measure: str = SUMMARY_MEASURE, name: str = "cost"
) -> DataFrame:
    """Sum of a measure per key; partial sums are formed before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(measure).alias(name))


def daily_costs(summary: DataFrame, keys: Sequence[str], measure: str = SUMMARY_MEASURE) -> DataFrame:
    """Cost per key and day, without the days whose every value is NULL."""
    return group_costs(summary, [*keys, "usage_date"], measure).filter(F.col("cost").isNotNull())


def grand_total(df: DataFrame, measure: str = SUMMARY_MEASURE) -> DataFrame:
    """One row: the sum, 0.0 when there is nothing to add."""
    return df.agg(coalesce_zero(F.sum(measure)).alias("total_cost"))


def load_statistics(summary: DataFrame, measure: str = "total_unblended_cost") -> DataFrame:
    """One row: first and last date, distinct accounts and services, total cost."""
    return summary.agg(
        F.min("usage_date").alias("first_date"),
        F.max("usage_date").alias("last_date"),
        F.countDistinct("usage_account_id").alias("accounts"),
        F.countDistinct("product_code").alias("services"),
        F.sum(measure).alias("total_cost"),
    )


def daily_total_statistics(summary: DataFrame, measure: str = "total_unblended_cost") -> DataFrame:
    """One row: least, mean and greatest total per day."""
    return group_costs(summary, ["usage_date"], measure).agg(
        F.min("cost").alias("min_daily"),
        F.avg("cost").alias("avg_daily"),
        F.max("cost").alias("max_daily"),
    )


def top_groups(
    df: DataFrame, key: str, n: int, measure: str = SUMMARY_MEASURE
) -> DataFrame:
    """The n keys of greatest total; each partition keeps only its own best n."""
    return (
        group_costs(df, [key], measure, "total_cost")
        .orderBy(F.col("total_cost").desc_nulls_last(), F.col(key).asc_nulls_last())
        .limit(positive(n, "top_n"))
    )


def rank_within(
    df: DataFrame, partition: Sequence[Column | str], order: Sequence[Column], n: int
) -> DataFrame:
    """The first n rows of each partition, numbered in ``rank``.

    Written as a filtered ``row_number`` so that every task drops all but its
    own first n rows before the shuffle: a partition that holds most of the data
    still sends only n rows per task. Spark does so for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``; raise that for longer lists.
    """
    whole = Window.partitionBy(*partition).orderBy(*order)
    ranked = df.withColumn("rank", F.row_number().over(whole))
    return ranked.filter(F.col("rank") <= positive(n, "top_n"))


def by_date(points: DataFrame, *then: str) -> DataFrame:
    """A series in display order: date, then group, NULL last."""
    return points.orderBy(
        F.col("usage_date").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in then]
    )
