from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.model import LINE_ITEMS
from ledgerloom.operators import ingestion
from ledgerloom.sources import api_pages, billing_files, manifests

V2_STRINGS = """identity_line_item_id line_item_usage_start_date line_item_usage_end_date
bill_billing_period_start_date bill_billing_period_end_date bill_payer_account_id
line_item_usage_account_id product_product_code product_product_name product_region
line_item_availability_zone line_item_usage_type line_item_operation line_item_resource_id
line_item_line_item_type line_item_currency_code line_item_line_item_description""".split()
V2_DOUBLES = """line_item_unblended_cost line_item_blended_cost line_item_net_unblended_cost
line_item_usage_amount""".split()


def v2_export(spark):
    rows = []
    for i in range(5):
        text = [f"id-{i}", "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "2025-01-01",
                "2025-02-01", "999", "111", "AmazonEC2", "EC2", "us-east-1", "us-east-1a",
                "BoxUsage", "Run", f"i-{i}", "Usage", "USD", "text"]
        rows.append((*text, 10.0 + i, 9.5 + i, 9.0 + i, 100.0))
    schema = ", ".join([f"{c} string" for c in V2_STRINGS] + [f"{c} double" for c in V2_DOUBLES])
    return spark.createDataFrame(rows, schema)


def v1_export(spark):
    columns = {
        "identity/LineItemId": "string", "lineItem/UsageStartDate": "string",
        "lineItem/UsageEndDate": "string", "bill/BillingPeriodStartDate": "string",
        "bill/BillingPeriodEndDate": "string", "bill/PayerAccountId": "string",
        "lineItem/UsageAccountId": "string", "product/ProductCode": "string",
        "product/ProductName": "string", "product/region": "string",
        "lineItem/LineItemType": "string", "lineItem/UnblendedCost": "double",
        "lineItem/BlendedCost": "double", "lineItem/UsageAmount": "double",
        "lineItem/CurrencyCode": "string",
    }
    rows = [
        (f"id-{i}", "2025-01-01T05:30:00Z", "2025-01-02T00:00:00Z", "2025-01-01T00:00:00Z",
         "2025-02-01T00:00:00Z", "999", "111", "AmazonS3", "S3", "us-west-2", "Usage",
         5.0 + i, 5.0, 1.0, "USD")
        for i in range(3)
    ]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in columns.items()))


def test_newer_export(spark):
    df = v2_export(spark)
    assert billing_files.export_generation(df.columns) == "v2"
    assert billing_files.missing_optional(df.columns) == ["billing_entity"]
    got = billing_files.normalize_export(df, "a.parquet")
    assert got.columns == LINE_ITEMS.names
    assert [f.dataType for f in got.schema] == [f.dataType for f in LINE_ITEMS]
    rows = got.orderBy("line_item_id").collect()
    assert len(rows) == 5
    assert (rows[0]["line_item_id"], rows[0]["product_code"], rows[0]["unblended_cost"]) == (
        "id-0", "AmazonEC2", 10.0)
    assert rows[0]["usage_start_date"] == datetime(2025, 1, 1)
    assert rows[0]["billing_period_start"] == date(2025, 1, 1)
    assert rows[0]["billing_entity"] is None and rows[0]["_source_file"] == "a.parquet"
    assert rows[0]["_ingested_at"] is not None


def test_older_export(spark):
    df = v1_export(spark)
    assert billing_files.export_generation(df.columns) == "v1"
    assert billing_files.missing_optional(df.columns) == sorted([
        "net_unblended_cost", "usage_type", "operation", "resource_id", "availability_zone",
        "line_item_description", "billing_entity"])
    rows = billing_files.normalize_export(df, "b").orderBy("line_item_id").collect()
    assert (len(rows), rows[0]["product_code"], rows[0]["region"], rows[0]["unblended_cost"]) == (
        3, "AmazonS3", "us-west-2", 5.0)
    assert rows[0]["usage_start_date"] == datetime(2025, 1, 1, 5, 30)
    assert rows[0]["net_unblended_cost"] is None


@pytest.mark.parametrize("target", ["UsageStartDate", "LineItemType", "UnblendedCost"])
def test_mandatory_columns(spark, target):
    df = v1_export(spark).drop(f"lineItem/{target}")
    with pytest.raises(ValueError, match="mandatory"):
        billing_files.normalize_export(df, "x")


def test_times_and_bad_values(spark):
    """Zone-less whatever the session zone; offsets applied; bad values become NULL."""
    df = v2_export(spark).limit(1)
    stamps = F.array(*[F.lit(t) for t in (
        "2025-01-02T02:30:00Z", "2025-01-02T02:30:00+02:00", "2025-01-02 02:30:00", "rubbish")])
    many = df.withColumn("line_item_usage_start_date", F.explode(stamps)).withColumn(
        "line_item_unblended_cost", F.lit("n/a"))
    got = billing_files.normalize_export(many, "x").collect()
    assert [r["usage_start_date"] for r in got] == [
        datetime(2025, 1, 2, 2, 30), datetime(2025, 1, 2, 0, 30), datetime(2025, 1, 2, 2, 30), None]
    assert {r["unblended_cost"] for r in got} == {None}
    instant = df.withColumn(
        "line_item_usage_start_date", F.expr("TIMESTAMP'2025-01-02 02:30:00+00:00'"))
    assert billing_files.normalize_export(instant, "x").first()["usage_start_date"] == datetime(
        2025, 1, 2, 2, 30)


def keyed(spark, *keys):
    return spark.createDataFrame([(key,) for key in keys], "s3_key string")


def test_scan_of_mixed_files(spark, tmp_path):
    root = str(tmp_path)
    v2_export(spark).coalesce(1).write.parquet(f"{root}/new")
    v1_export(spark).coalesce(1).write.parquet(f"{root}/old")
    keys = [r["key"] for r in billing_files.list_files(spark, root).collect() if r["key"].endswith(".parquet")]
    got = ingestion.read_exports(spark, keyed(spark, *keys), root)
    assert got.count() == 8
    assert {r[0] for r in got.select("_source_file").collect()} == set(keys)
    (tmp_path / "bad.parquet").write_bytes(b"not parquet")
    with pytest.raises(ValueError, match="bad.parquet"):
        ingestion.read_exports(spark, keyed(spark, *keys, "bad.parquet"), root)
    with pytest.raises(ValueError, match="does not exist"):
        ingestion.read_exports(spark, keyed(spark, "absent.parquet"), root)


def test_tasks_judge_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = str(tmp_path)
    good = {"line_item_usage_start_date": ["2025-01-01"], "line_item_line_item_type": ["Usage"], "line_item_unblended_cost": [1.0]}
    files = {
        "good": good,
        "text_cost": {**good, "line_item_unblended_cost": ["2.5"]},
        "tagged": {**good, "tag": ["x"]},
        "other_tag": {**good, "tag": [1]},
        "older": {"lineItem/UsageStartDate": ["2025-01-01"], "lineItem/LineItemType": ["Usage"], "lineItem/UnblendedCost": [4.0]},
        "no_cost": {k: v for k, v in good.items() if "cost" not in k},
        "null_cost": {**good, "line_item_unblended_cost": pa.array([None], pa.float64())},
        "empty": {k: pa.array([], pa.array(v).type) for k, v in good.items()},
    }
    for name, columns in files.items():
        pq.write_table(pa.table(columns), f"{root}/{name}")
    (tmp_path / "rubbish").write_bytes(b"rubbish" * 100)
    opened = []
    groups, verdicts = ingestion.judge_exports(spark, keyed(spark, *files, "rubbish", "absent"), root)
    by_name = {row["s3_key"]: row for row in verdicts}
    errors = {name: row["error"] for name, row in by_name.items() if row["error"]}
    assert errors.keys() == {"no_cost", "rubbish", "absent"}
    assert "unblended_cost" in errors["no_cost"] and "exist" in errors["absent"]
    assert {name: row["generation"] for name, row in by_name.items() if not row["error"]} == {
        name: "v1" if name == "older" else "v2" for name in files if name != "no_cost"}
    got = billing_files.scan_exports(spark, groups, verdicts, root)
    assert rows_of(got, "_source_file", "unblended_cost") == sorted(
        [("good", 1.0), ("text_cost", 2.5), ("tagged", 1.0), ("other_tag", 1.0), ("older", 4.0), ("null_cost", None)], key=repr)
    # The driver opens only what tasks could not tell.
    read = billing_files.read_footers
    try:
        billing_files.read_footers = lambda spark, paths: opened.extend(paths) or read(spark, paths)
        ingestion.judge_exports(spark, keyed(spark, *files, "rubbish", "absent"), root)
    finally:
        billing_files.read_footers = read
    assert {path.rsplit("/", 1)[1] for path in opened} == {"no_cost", "null_cost", "empty", "rubbish"}


MANIFEST = {
    "assemblyId": "a-1", "account": "999", "compression": "Parquet", "bucket": "b",
    "reportName": "daily",
    "billingPeriod": {"start": "2025-01-01T00:00:00.000Z", "end": "2025-02-01T00:00:00.000Z"},
    "reportKeys": ["r/20250101-20250201/1.parquet", "r/20250101-20250201/2.parquet"],
    "columns": [{"category": "lineItem", "name": "UnblendedCost"}],
}


def parse(spark, *contents):
    df = spark.createDataFrame(list(enumerate(contents)), "n int, content string")
    return manifests.parse_manifests(df).orderBy("n").collect()


def test_manifest(spark):
    (row,) = parse(spark, json.dumps(MANIFEST))
    assert (row["manifest_period"], len(row["report_keys"]), row["is_parquet"], row["error"]) == (
        "20250101-20250201", 2, True, None)
    assert row["columns"][0]["name"] == "UnblendedCost" and row["report_name"] == "daily"


def test_manifest_edges(spark):
    minimal = {"assemblyId": "a", "reportKeys": ["k"]}
    got = parse(
        spark,
        "{ not json",
        "[1, 2]",
        json.dumps({"reportKeys": ["k"]}),
        json.dumps({"assemblyId": "a", "reportKeys": []}),
        json.dumps({"assemblyId": "a"}),
        json.dumps(minimal),
        json.dumps({**minimal, "compression": "GZIP"}),
        '"text"',
    )
    assert all(r["error"] for r in got[:5]) and got[7]["error"]
    assert [r["error"] for r in got[5:7]] == [None, None]
    assert got[5]["account"] == "" and got[5]["columns"] == []
    assert [r["is_parquet"] for r in got[5:7]] == [False, False]


def test_periods_and_latest_manifest(spark):
    files = spark.createDataFrame(
        [("20250101-20250201/a-Manifest.json", "1"), ("20250101-20250201/b-Manifest.json", "2"),
         ("20250201-20250301/x/manifest.json", "3"), ("20250201-20250301/x/othermanifest.json", "4"),
         ("short/manifest.json", "5"), ("20250301-20250401/data.parquet", "6")],
        "key string, content string")
    assert [r[0] for r in manifests.billing_periods(files).collect()] == [
        "20250101-20250201", "20250201-20250301", "20250301-20250401"]
    latest = manifests.latest_manifests(files)
    assert rows_of(latest, "billing_period", "content") == [
        ("20250101-20250201", "2"), ("20250201-20250301", "3")]


def amounts(u, b, n):
    return {m: {"Amount": str(v), "Unit": "USD"} for m, v in
            zip(("UnblendedCost", "BlendedCost", "NetAmortizedCost"), (u, b, n))}


def test_api_pages(spark, tmp_path):
    page = {"ResultsByTime": [
        {"TimePeriod": {"Start": "2025-01-01", "End": "2025-01-02"}, "Groups": [
            {"Keys": ["AWS Lambda", "111"], "Metrics": amounts(1.5, 1.25, 1)},
            {"Keys": ["Novel Service", "222"], "Metrics": amounts(0, 0, 0.001)},
            {"Keys": ["AWS Glue"], "Metrics": amounts(-2, -2, -2)},
            {"Keys": ["AWS Config", "333"], "Metrics": amounts(0.0009, -0.0009, 0)}]},
        {"TimePeriod": {"Start": "2025-01-02", "End": "2025-01-03"}, "Groups": [
            {"Keys": [], "Metrics": amounts(3, 3, 3)}]}],
        "NextPageToken": "next"}
    total = {"ResultsByTime": [{"TimePeriod": {"Start": "2025-02-01", "End": "2025-02-02"},
                                "Groups": [], "Total": amounts(7, 7, 6)}]}
    (tmp_path / "1.json").write_text(json.dumps(page, indent=1))
    (tmp_path / "2.json").write_text(json.dumps(total))
    pages = api_pages.read_api_pages(spark, str(tmp_path))
    got = rows_of(api_pages.api_costs(pages), "usage_date", "usage_account_id", "product_code",
                  "total_unblended_cost", "total_net_amortized_cost")
    first = date(2025, 1, 1)
    assert got == sorted([
        (first, "111", "AWSLambda", 1.5, 1.0), (first, "222", "Novel Service", 0.0, 0.001),
        (first, "", "AWSGlue", -2.0, -2.0), (date(2025, 1, 2), "", "Unknown", 3.0, 3.0)], key=repr)
    monthly = api_pages.api_cost_by_dimension(pages, granularity="MONTHLY", grouped=False)
    assert rows_of(monthly, "start", "net_amortized_cost") == [
        (first, pytest.approx(2.001)), (date(2025, 2, 1), 6.0)]
    with pytest.raises(ValueError):
        api_pages.api_cost_by_dimension(pages, granularity="HOURLY")
