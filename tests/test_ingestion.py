"""Exports, manifests and tables end to end."""

from __future__ import annotations

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.functions.dates import islands
from ledgerloom.operators import ingestion
from ledgerloom.sources import tables

JAN, FEB = "20250101-20250201", "20250201-20250301"


class Exports:
    """Writes export files and manifests below one root."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root

    def file(self, key, costs, *, period="2025-01-01", kind="Usage", v1=False):
        import pyarrow as pa
        import pyarrow.parquet as pq

        path = self.root / key
        path.parent.mkdir(parents=True, exist_ok=True)
        n = len(costs)
        names = {
            "start": ("line_item_usage_start_date", "lineItem/UsageStartDate"),
            "type": ("line_item_line_item_type", "lineItem/LineItemType"),
            "cost": ("line_item_unblended_cost", "lineItem/UnblendedCost"),
            "product": ("product_product_code", "product/ProductCode"),
        }
        data = {
            names["start"][v1]: [f"{period}T00:00:00Z"] * n,
            names["type"][v1]: [kind] * n,
            names["cost"][v1]: [float(c) for c in costs],
            names["product"][v1]: ["p"] * n,
        }
        if not v1:
            data["bill_billing_period_start_date"] = [period] * n
        pq.write_table(pa.table(data), path)
        return key

    def manifest(self, period, assembly, keys, name="daily-Manifest.json", text=None):
        path = self.root / period / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text or json.dumps({
            "assemblyId": assembly, "reportKeys": keys,
            "billingPeriod": {"start": f"{period[:4]}-{period[4:6]}-01", "end": "2025-02-01"}}, indent=1))


@pytest.fixture
def exports(spark, tmp_path):
    return Exports(spark, tmp_path / "exports")


@pytest.fixture
def store(tmp_path):
    return str(tmp_path / "tables")


def costs(spark, store):
    return rows_of(tables.read_line_items(spark, store), "billing_period_start", "unblended_cost")


def log(spark, store):
    return rows_of(tables.read_log(spark, store), "billing_period", "assembly_id", "s3_key", "rows_loaded")


def two_periods(exports, key, costs):
    """A file of January's manifest that holds a row of January and one of December."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = exports.root / key
    path.parent.mkdir(parents=True, exist_ok=True)
    days = ["2025-01-03", "2024-12-31"]
    pq.write_table(pa.table({
        "line_item_usage_start_date": [f"{d}T00:00:00Z" for d in days], "line_item_line_item_type": ["Usage"] * 2,
        "line_item_unblended_cost": [float(c) for c in costs], "product_product_code": ["p"] * 2,
        "bill_billing_period_start_date": [f"{d[:7]}-01" for d in days], f"tag_of_{costs[0]}": ["x"] * 2}), path)
    return key


def test_rows_of_another_period_count_and_go_with_their_file(spark, exports, store):
    root, december = str(exports.root), "20241201-20250101"
    exports.manifest(december, "d1", [exports.file(f"{december}/d.parquet", [7], period="2024-12-01")])
    exports.manifest(JAN, "j1", [two_periods(exports, f"{JAN}/a.parquet", [5, 1])])
    report = ingestion.ingest_exports(spark, root, store)
    assert report.rows_loaded == 3
    assert sum(r["total_unblended_cost"] for r in tables.read_summary(spark, store).collect()) == 13.0
    again = ingestion.ingest_exports(spark, root, store)
    assert again.rows_loaded == 0 and len(again.skipped) == 2
    exports.manifest(JAN, "j2", [two_periods(exports, f"{JAN}/b.parquet", [6, 2])])
    ingestion.ingest_exports(spark, root, store)
    december_rows, january = date(2024, 12, 1), date(2025, 1, 1)
    assert costs(spark, store) == [(december_rows, 2.0), (december_rows, 7.0), (january, 6.0)]
    exports.manifest(december, "d2", [exports.file(f"{december}/e.parquet", [8], period="2024-12-01")])
    ingestion.ingest_exports(spark, root, store)
    assert costs(spark, store) == [(december_rows, 2.0), (december_rows, 8.0), (january, 6.0)]
    assert sum(r["total_unblended_cost"] for r in tables.read_summary(spark, store).collect()) == 16.0


def test_a_scheme_that_only_hadoop_knows(spark, exports, store):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.exports.link./in", f"file://{exports.root}")
    exports.manifest(JAN, "a1", [exports.file(f"{JAN}/a.parquet", [1, 2]), exports.file(f"{JAN}/b.parquet", [4], v1=True)])
    (exports.root / f"{JAN}/bad.parquet").write_text("no Parquet")
    exports.manifest(FEB, "a2", [f"{JAN}/bad.parquet"])
    report = ingestion.ingest_exports(spark, "viewfs://exports/in", store)
    assert report.rows_loaded == 3 and [key for key, _ in report.errors] == [f"{JAN}/bad.parquet"]


def test_ingest_and_restate(spark, exports, store):
    root = str(exports.root)
    a = exports.file(f"{JAN}/a.parquet", [1, 2])
    # the older generation names no period: it is taken from the manifest
    b = exports.file(f"{JAN}/b.parquet", [4], v1=True)
    exports.manifest(JAN, "first", [a, b])
    f = exports.file(f"{FEB}/f.parquet", [8], period="2025-02-01")
    exports.manifest(FEB, "feb", [f])
    jan, feb = date(2025, 1, 1), date(2025, 2, 1)

    report = ingestion.ingest_exports(spark, root, store)
    assert (report.rows_loaded, report.periods, report.errors, report.skipped) == (4, [JAN, FEB], [], [])
    assert report.summary_rows == 2
    assert costs(spark, store) == [(jan, 1.0), (jan, 2.0), (jan, 4.0), (feb, 8.0)]
    assert log(spark, store) == [
        (JAN, "first", a, 2), (JAN, "first", b, 1), (FEB, "feb", f, 1)]

    again = ingestion.ingest_exports(spark, root, store)
    assert (again.rows_loaded, again.skipped, again.summary_rows) == (0, [a, b, f], 2)
    assert len(costs(spark, store)) == 4

    c = exports.file(f"{JAN}/c.parquet", [16])
    exports.manifest(JAN, "second", [c], name="newer-Manifest.json")
    restated = ingestion.ingest_exports(spark, root, store)
    assert (restated.rows_loaded, restated.periods) == (1, [JAN])
    assert costs(spark, store) == [(jan, 16.0), (feb, 8.0)]
    assert log(spark, store) == [(JAN, "second", c, 1), (FEB, "feb", f, 1)]
    summary = tables.read_summary(spark, store)
    assert rows_of(summary, "usage_date", "total_unblended_cost") == [(jan, 16.0), (feb, 8.0)]

    one = ingestion.ingest_exports(spark, root, store, month="2025-02", full_refresh=True)
    assert (one.rows_loaded, one.periods) == (1, [FEB])
    assert len(log(spark, store)) == 2 and len(costs(spark, store)) == 2


def test_bad_files_and_manifests_are_isolated(spark, exports, store):
    a = exports.file(f"{JAN}/a.parquet", [1])
    bad = f"{JAN}/bad.parquet"
    (exports.root / bad).write_bytes(b"rubbish")
    absent = f"{JAN}/absent.parquet"
    exports.manifest(JAN, "first", [a, bad, absent])
    exports.manifest(FEB, "", [], text="{ broken")
    root = str(exports.root)
    report = ingestion.ingest_exports(spark, root, store)
    assert report.rows_loaded == 1 and len(log(spark, store)) == 1
    assert sorted(key for key, _ in report.errors) == sorted([bad, absent, f"{FEB}/daily-Manifest.json"])

    # the file that failed is not forgotten: once it is there it is loaded
    exports.file(bad, [2])
    exports.file(absent, [4])
    exports.manifest(FEB, "feb", [exports.file(f"{FEB}/f.parquet", [8], period="2025-02-01")])
    repaired = ingestion.ingest_exports(spark, root, store)
    assert (repaired.rows_loaded, repaired.skipped, repaired.errors) == (3, [a], [])
    assert [c for _, c in costs(spark, store)] == [1.0, 2.0, 4.0, 8.0]


def test_a_file_damaged_in_the_middle_is_left_out(spark, exports, store):
    """Its footer and mandatory columns are fine; a page of another column is not."""
    import pyarrow.parquet as pq

    a, b = exports.file(f"{JAN}/a.parquet", [1]), exports.file(f"{JAN}/b.parquet", range(200))
    path = exports.root / b
    column = next(c for c in (pq.ParquetFile(path).metadata.row_group(0).column(i) for i in range(5)) if c.path_in_schema == "product_product_code")
    data, start = bytearray(path.read_bytes()), column.dictionary_page_offset
    data[start : start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    path.write_bytes(data)
    exports.manifest(JAN, "first", [a, b])
    report = ingestion.ingest_exports(spark, str(exports.root), store)
    assert report.rows_loaded == 1 and [key for key, _ in report.errors] == [b]
    assert rows_of(tables.read_rejects(spark, store), "billing_period", "s3_key") == [(JAN, b)]
    assert costs(spark, store) == [(date(2025, 1, 1), 1.0)]
    exports.file(b, [2])
    repaired = ingestion.ingest_exports(spark, str(exports.root), store)
    assert repaired.rows_loaded == 1 and tables.read_rejects(spark, store).isEmpty()


def test_keys_with_special_characters(spark, exports, store):
    keys = [exports.file(f"{JAN}/run=1/{name}.parquet", [1]) for name in ("a b", "a+b", "a%20b", "ä-1")]
    exports.manifest(JAN, "first", keys)
    report = ingestion.ingest_exports(spark, str(exports.root), store)
    assert report.rows_loaded == 4
    assert [(key, n) for _, _, key, n in log(spark, store)] == sorted((key, 1) for key in keys)


def test_files_are_matched_to_periods_without_a_shuffle(spark, make_line_items, capsys):
    rows = make_line_items([{"_source_file": "k", "unblended_cost": 1.0}])
    files = spark.createDataFrame([(JAN, "a", "k")], "billing_period string, assembly_id string, s3_key string")
    matched = ingestion._with_period(rows, files)
    matched.explain()
    assert "hashpartitioning" not in capsys.readouterr().out
    assert rows_of(matched, "billing_period_start") == [(date(2025, 1, 1),)]


def test_nothing_usable(spark, exports, store):
    exports.manifest(JAN, "first", [f"{JAN}/absent.parquet"])
    with pytest.raises(ValueError, match="nothing could be loaded"):
        ingestion.ingest_exports(spark, str(exports.root), store)


def test_unusable_restatement_leaves_the_old_rows(spark, exports, store):
    exports.manifest(JAN, "first", [exports.file(f"{JAN}/a.parquet", [1])])
    root = str(exports.root)
    ingestion.ingest_exports(spark, root, store)
    exports.manifest(JAN, "second", [f"{JAN}/absent.parquet"])
    with pytest.raises(ValueError):
        ingestion.ingest_exports(spark, root, store)
    assert [c for _, c in costs(spark, store)] == [1.0]


def test_run_that_broke_off_before_the_log(spark, exports, store):
    a = exports.file(f"{JAN}/a.parquet", [1, 2])
    b = exports.file(f"{JAN}/b.parquet", [4])
    exports.manifest(JAN, "first", [a])
    root = str(exports.root)
    ingestion.ingest_exports(spark, root, store)
    # b was appended, its log entry was not
    leftover = tables.read_line_items(spark, store).limit(1).drop("_source_file").selectExpr(
        "*", f"'{b}' AS _source_file")
    held = spark.createDataFrame(leftover.collect(), leftover.schema)
    tables.append_line_items(held, store)
    exports.manifest(JAN, "first", [a, b])
    report = ingestion.ingest_exports(spark, root, store)
    assert report.rows_loaded == 3
    assert [c for _, c in costs(spark, store)] == [1.0, 2.0, 4.0]
    assert log(spark, store) == [(JAN, "first", a, 2), (JAN, "first", b, 1)]


def test_only_touched_days_are_summarized_again(spark, exports, store):
    """Months without a restated day keep their files; vanished days go."""
    root = str(exports.root)
    exports.manifest(JAN, "first", [exports.file(f"{JAN}/a.parquet", [1])])
    exports.manifest(FEB, "feb", [exports.file(f"{FEB}/f.parquet", [8], period="2025-02-01")])
    ingestion.ingest_exports(spark, root, store)
    days = exports.root.parent / "tables" / tables.SUMMARY_TABLE / "data_source=cur"
    before = {p: p.stat().st_mtime_ns for p in days.rglob("*.parquet") if "2025-01" in str(p)}
    assert len(before) == 1
    # the second assembly of February has one line item of another day
    import pyarrow as pa
    import pyarrow.parquet as pq

    key = f"{FEB}/g.parquet"
    pq.write_table(pa.table({
        "line_item_usage_start_date": ["2025-02-27T05:00:00Z"],
        "bill_billing_period_start_date": ["2025-02-01"],
        "line_item_line_item_type": ["Usage"],
        "line_item_unblended_cost": [3.0]}), exports.root / key)
    exports.manifest(FEB, "second", [key], name="second-Manifest.json")
    report = ingestion.ingest_exports(spark, root, store)
    assert (report.rows_loaded, report.summary_rows) == (1, 2)
    summary = tables.read_summary(spark, store)
    assert rows_of(summary, "usage_date", "total_unblended_cost") == [
        (date(2025, 1, 1), 1.0), (date(2025, 2, 27), 3.0)]
    assert before == {p: p.stat().st_mtime_ns for p in before}


def test_days_noted_by_a_broken_run_are_summarized(spark, exports, store):
    root = str(exports.root)
    exports.manifest(JAN, "first", [exports.file(f"{JAN}/a.parquet", [1])])
    ingestion.ingest_exports(spark, root, store)
    stale = tables.read_summary(spark, store).withColumn("usage_date", F.lit(date(2025, 1, 20)))
    tables.write_rebuilt_days(stale, store, [date(2025, 1, 20)])
    assert tables.count_summary(spark, store) == 2
    tables.note_pending(spark, store, [date(2025, 1, 20)])
    assert ingestion.ingest_exports(spark, root, store).summary_rows == 1
    assert tables.read_pending(spark, store) == []


def test_restating_two_months_rewrites_these_only(spark, exports, store):
    """Nothing between a month of 2021 and one of 2025 is written anew."""
    root = str(exports.root)
    periods = {f"{y}{m:02d}01-{y}{m:02d}28": f"{y}-{m:02d}-01" for y, m in ((2021, 3), (2022, 5), (2023, 7), (2025, 2))}
    for period, start in periods.items():
        exports.manifest(period, "first", [exports.file(f"{period}/a.parquet", [1], period=start)])
    ingestion.ingest_exports(spark, root, store)
    _, before = tables.summary_commit(spark, store)
    for period in ("20210301-20210328", "20250201-20250228"):
        exports.manifest(period, "second", [exports.file(f"{period}/b.parquet", [5], period=periods[period])], name="second-Manifest.json")
    ingestion.ingest_exports(spark, root, store)
    _, after = tables.summary_commit(spark, store)
    changed = {month for (_, month), version in after.items() if before["cur", month] != version}
    assert changed == {"2021-03", "2025-02"} and before.keys() == after.keys()
    assert rows_of(tables.read_summary(spark, store), "usage_date", "total_unblended_cost") == [
        (date(2021, 3, 1), 5.0), (date(2022, 5, 1), 1.0), (date(2023, 7, 1), 1.0), (date(2025, 2, 1), 5.0)]


def test_islands():
    days = [date(2025, 1, 3), date(2025, 1, 1), date(2025, 1, 2), date(2025, 3, 1)]
    assert islands(days) == [(date(2025, 1, 1), date(2025, 1, 3)), (date(2025, 3, 1), date(2025, 3, 1))]
    assert islands([]) == []


def test_line_items_without_a_usage_day(spark, exports, store):
    root = str(exports.root)
    exports.manifest(JAN, "first", [
        exports.file(f"{JAN}/a.parquet", [1]), exports.file(f"{JAN}/b.parquet", [2], period="rubbish")])
    assert ingestion.ingest_exports(spark, root, store).summary_rows == 2
    assert rows_of(tables.read_summary(spark, store), "usage_date", "total_unblended_cost") == [
        (None, 2.0), (date(2025, 1, 1), 1.0)]


def test_plan_and_log(spark):
    log = spark.createDataFrame(
        [("old", JAN, "k1", 1, datetime(2025, 1, 1)), ("new", JAN, "k1", 1, datetime(2025, 1, 2)),
         ("b", FEB, "k", 1, datetime(2025, 1, 3)), ("a", FEB, "k", 1, datetime(2025, 1, 3))],
        "assembly_id string, billing_period string, s3_key string, rows_loaded bigint, ingested_at timestamp_ntz")
    assert rows_of(ingestion.latest_assemblies(log)) == [(JAN, "new"), (FEB, "b")]
    keys = spark.createDataFrame(
        [(JAN, "new", "k1"), (JAN, "new", "k2"), (FEB, "c", "k"), ("20250301-20250401", "x", "k")],
        "billing_period string, assembly_id string, s3_key string")

    def actions(**options):
        return rows_of(ingestion.ingest_plan(keys, log, **options), "billing_period", "s3_key", "action")

    assert actions() == [(JAN, "k1", "skip"), (JAN, "k2", "load"), (FEB, "k", "replace"),
                         ("20250301-20250401", "k", "load")]
    assert {a for _, _, a in actions(full_refresh=True)} == {"replace"}
    assert actions(month="2025-02") == [(FEB, "k", "replace")]


def test_delete_and_replace_periods(spark, make_line_items):
    items = make_line_items([
        {"billing_period_start": d, "unblended_cost": c} for d, c in
        ((date(2025, 1, 1), 1.0), (date(2025, 2, 1), 2.0), (None, 3.0))])
    assert rows_of(ingestion.delete_period(items, JAN), "unblended_cost") == [(2.0,), (3.0,)]
    newer = make_line_items([{"billing_period_start": date(2025, 2, 1), "unblended_cost": 9.0}])
    assert rows_of(ingestion.replace_periods(items, newer), "unblended_cost") == [(1.0,), (3.0,), (9.0,)]
