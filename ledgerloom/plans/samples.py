"""Inputs the queries share: date ranges over the sample tables, and exports,
manifests and API pages derived from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.fixed_values import EXPORT_COLUMNS
from ledgerloom.functions.dates import billing_period, to_day
from ledgerloom.sources import sample_tables
from ledgerloom.sources.api_pages import API_PAGE
from ledgerloom.sources.billing_files import column_map

# Two periods that cover every line item, and ranges that cover every cost.
PERIOD_A = (date(1995, 1, 1), date(1998, 6, 30))
PERIOD_B = (date(1998, 7, 1), date(2001, 12, 31))
WHOLE = (date(1995, 1, 1), date(2024, 2, 15))
# The events: thirty days up to the reference date.
REFERENCE = date(2024, 1, 30)
EVENT_DAYS = 29
SERVICE = "PROMO"
ACCOUNT = "NATION_7"
MONTH = "1997-03"


def as_export(line_items: DataFrame, generation: str) -> DataFrame:
    """Line items under the column names of an export generation."""
    return line_items.select(
        *[
            F.col(name).alias(v1 if generation == "v1" else v2)
            for name, v1, v2, _ in EXPORT_COLUMNS
            if name in line_items.columns
        ]
    )


def exports(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Refunds as an older export, all other line items as a newer one."""
    rows = sample_tables.line_items(spark, sf_dir)
    refund = F.col("line_item_type") == "Refund"
    return {
        "v1": as_export(rows.filter(refund), "v1"),
        "v2": as_export(rows.filter(~refund), "v2"),
    }


def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(billing_period, assembly_id, s3_key, rows, last_usage): one file per period and type."""
    rows = sample_tables.line_items(spark, sf_dir, ["usage_start_date", "line_item_type"])
    period = billing_period(to_day(F.col("usage_start_date")))
    return (
        rows.groupBy(period.alias("billing_period"), "line_item_type")
        .agg(F.count("*").alias("rows"), F.max("usage_start_date").alias("last_usage"))
        .select(
            "billing_period",
            F.concat(F.lit("assembly-"), F.lower("line_item_type")).alias("assembly_id"),
            F.concat_ws("/", "billing_period", F.concat("line_item_type", F.lit(".parquet"))).alias(
                "s3_key"
            ),
            "rows",
            "last_usage",
        )
    )


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, content): two manifests per billing period, the later one listing all files.

    A period has one file per line-item type, so a manifest lists a few keys.
    """
    per_period = (
        export_files(spark, sf_dir)
        .groupBy("billing_period")
        .agg(F.sort_array(F.collect_list("s3_key")).alias("keys"))
    )

    def iso(position: int) -> Column:
        part = F.split_part("billing_period", F.lit("-"), F.lit(position))
        return F.concat_ws(
            "-", part.substr(1, 4), part.substr(5, 2), F.concat(part.substr(7, 2), F.lit("T00:00:00Z"))
        )

    def content(assembly: str, keys: Column) -> Column:
        return F.to_json(
            F.struct(
                F.lit(assembly).alias("assemblyId"),
                F.lit("Parquet").alias("compression"),
                F.struct(iso(1).alias("start"), iso(2).alias("end")).alias("billingPeriod"),
                keys.alias("reportKeys"),
            )
        )

    def file(name: str, text: Column) -> Column:
        return F.struct(
            F.concat("billing_period", F.lit(f"/{name}-Manifest.json")).alias("key"),
            text.alias("content"),
        )

    return per_period.select(
        F.inline(
            F.array(
                file("1", content("assembly-early", F.slice("keys", 1, 1))),
                file("2", content("assembly-usage", F.col("keys"))),
            )
        )
    )


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested API pages of the event costs, one page per day.

    A page holds a day's cells: services times accounts, whatever the number of
    events.
    """
    service = F.col("product_code")
    display = (
        F.when(service == "view", "AWS Lambda")
        .when(service == "click", "Amazon CloudFront")
        .otherwise(service)
    )

    def amount(column: str) -> Column:
        return F.struct(F.col(column).cast("string").alias("Amount"), F.lit("USD").alias("Unit"))

    group = F.struct(
        F.array(display, F.col("usage_account_id")).alias("Keys"),
        F.struct(
            amount("total_unblended_cost").alias("UnblendedCost"),
            amount("total_blended_cost").alias("BlendedCost"),
            amount("total_net_amortized_cost").alias("NetAmortizedCost"),
        ).alias("Metrics"),
    )
    day = F.col("usage_date")
    pages = (
        sample_tables.api_cells(spark, sf_dir)
        .groupBy("usage_date")
        .agg(F.collect_list(group).alias("Groups"))
        .select(
            F.to_json(
                F.struct(
                    F.array(
                        F.struct(
                            F.struct(
                                day.cast("string").alias("Start"),
                                F.date_add(day, 1).cast("string").alias("End"),
                            ).alias("TimePeriod"),
                            "Groups",
                        )
                    ).alias("ResultsByTime")
                )
            ).alias("page")
        )
    )
    return pages.select(F.from_json("page", API_PAGE).alias("p")).select("p.*")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at any path that Spark's file systems know."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_export(rows: DataFrame, generation: str, root: str, name: str, lacking: str | None = None) -> None:
    """Line items as export files below ``root/name``, by billing period, large periods in several files."""
    export = as_export(rows, generation)
    if lacking:
        export = export.drop(column_map(generation)[lacking])
    period = billing_period(to_day(F.col(f"`{column_map(generation)['usage_start_date']}`")))
    dealt = export.withColumn("period", period).hint("rebalance", "period")
    dealt.write.partitionBy("period").parquet(f"{root}/{name}")
