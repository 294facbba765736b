"""Export manifests: which files make up a billing period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.dates import compact_period
from ledgerloom.sources.billing_files import file_key

MANIFEST = T.StructType(
    [
        T.StructField("assemblyId", T.StringType()),
        T.StructField("account", T.StringType()),
        T.StructField("reportName", T.StringType()),
        T.StructField(
            "billingPeriod",
            T.StructType(
                [T.StructField("start", T.StringType()), T.StructField("end", T.StringType())]
            ),
        ),
        T.StructField("reportKeys", T.ArrayType(T.StringType())),
        T.StructField("compression", T.StringType()),
        T.StructField("bucket", T.StringType()),
        T.StructField(
            "columns",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("category", T.StringType()),
                        T.StructField("name", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("_unparsed", T.StringType()),
    ]
)


def folder_period(key: Column) -> Column:
    """The billing-period folder a key lies in; empty if there is none.

    A period folder has 17 characters with a dash in the middle.
    """
    return F.regexp_extract(F.concat(F.lit("/"), key), r"/([^/]{8}-[^/]{8})/", 1)


def billing_periods(keys: DataFrame) -> DataFrame:
    """Distinct billing periods among file keys, in order."""
    return (
        keys.select(folder_period(F.col("key")).alias("billing_period"))
        .filter(F.col("billing_period") != "")
        .distinct()
        .orderBy("billing_period")
    )


def read_manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """(key, content) of the manifest files below ``root``."""
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*anifest.json")
        .text(root, wholetext=True)
    )
    return files.select(
        file_key(root).alias("key"),
        F.col("value").alias("content"),
    )


def latest_manifests(files: DataFrame) -> DataFrame:
    """(billing_period, manifest_key, content): the last manifest key of each period."""
    named = F.concat(F.lit("/"), F.col("key"))
    return (
        files.filter(named.endswith("-Manifest.json") | named.endswith("/manifest.json"))
        .withColumn("billing_period", folder_period(F.col("key")))
        .filter(F.col("billing_period") != "")
        .groupBy("billing_period")
        .agg(F.max("key").alias("manifest_key"), F.max_by("content", "key").alias("content"))
    )


def parse_manifests(manifests: DataFrame) -> DataFrame:
    """Manifests taken apart, with ``error`` set on those that cannot be used.

    ``content`` is parsed; all other columns are kept.
    """
    kept = [c for c in manifests.columns if c != "content"]
    parsed = manifests.withColumn(
        "m", F.from_json("content", MANIFEST, {"columnNameOfCorruptRecord": "_unparsed"})
    )
    m = F.col("m")
    error = (
        F.when(m.isNull() | m["_unparsed"].isNotNull(), "invalid JSON")
        .when(~F.ltrim("content").startswith("{"), "not a JSON object")
        .when(m["assemblyId"].isNull(), "no assemblyId")
        .when(F.coalesce(F.size(m["reportKeys"]), F.lit(0)) < 1, "no reportKeys")
    )

    def text(field: str) -> Column:
        return F.coalesce(m[field], F.lit("")).alias(
            {"reportName": "report_name"}.get(field, field)
        )

    start = F.coalesce(m["billingPeriod"]["start"], F.lit(""))
    end = F.coalesce(m["billingPeriod"]["end"], F.lit(""))
    return parsed.select(
        *kept,
        m["assemblyId"].alias("assembly_id"),
        text("account"),
        text("reportName"),
        compact_period(start, end).alias("manifest_period"),
        m["reportKeys"].alias("report_keys"),
        text("compression"),
        (F.lower(F.coalesce(m["compression"], F.lit(""))) == "parquet").alias("is_parquet"),
        text("bucket"),
        F.coalesce(m["columns"], F.array().cast(MANIFEST["columns"].dataType)).alias("columns"),
        error.alias("error"),
    )


def report_keys(parsed: DataFrame) -> DataFrame:
    """(billing_period, assembly_id, s3_key): one row per file of a usable manifest."""
    return parsed.filter(F.col("error").isNull()).select(
        "billing_period", "assembly_id", F.explode("report_keys").alias("s3_key")
    )


def rejected_manifests(parsed: DataFrame) -> DataFrame:
    """(billing_period, manifest_key, error) of the manifests that cannot be used."""
    return parsed.filter(F.col("error").isNotNull()).select(
        "billing_period", "manifest_key", "error"
    )
