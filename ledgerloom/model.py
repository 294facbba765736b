"""The three tables of the data model, as Spark schemas, and their migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ledgerloom.fixed_values import EXPORT_COLUMNS, EXPORT_SOURCE

_KINDS = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "timestamp_ntz": T.TimestampNTZType(),
}

LINE_ITEMS = T.StructType(
    [T.StructField(name, _KINDS[kind]) for name, _, _, kind in EXPORT_COLUMNS]
    + [
        T.StructField("_ingested_at", T.TimestampNTZType()),
        T.StructField("_source_file", T.StringType()),
    ]
)

DAILY_SUMMARY = T.StructType(
    [
        T.StructField("usage_date", T.DateType()),
        T.StructField("usage_account_id", T.StringType()),
        T.StructField("product_code", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("total_unblended_cost", T.DoubleType()),
        T.StructField("total_blended_cost", T.DoubleType()),
        T.StructField("total_net_amortized_cost", T.DoubleType()),
        T.StructField("total_usage_amount", T.DoubleType()),
        T.StructField("line_item_count", T.LongType()),
        T.StructField("data_source", T.StringType()),
    ]
)

INGESTION_LOG = T.StructType(
    [
        T.StructField("assembly_id", T.StringType()),
        T.StructField("billing_period", T.StringType()),
        T.StructField("s3_key", T.StringType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
    ]
)

# Values given to columns that older tables lack; every other column gets NULL.
_ADDED_DEFAULTS = {"data_source": EXPORT_SOURCE, "total_net_amortized_cost": 0.0}

SUMMARY_MEASURE = "total_net_amortized_cost"
LINE_MEASURE = "net_unblended_cost"


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give ``df`` exactly the columns of ``schema``, in order and by name.

    A column an older table lacks is added with its default, so a table written
    before the column existed keeps working. Existing NULLs are left alone.
    """
    present = set(df.columns)
    return df.select(
        *[
            (
                F.col(field.name)
                if field.name in present
                else F.lit(_ADDED_DEFAULTS.get(field.name))
            )
            .cast(field.dataType)
            .alias(field.name)
            for field in schema
        ]
    )
