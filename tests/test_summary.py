from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.model import DAILY_SUMMARY, LINE_ITEMS, conform
from ledgerloom.operators import summary as ops
from ledgerloom.sources import tables

DAY = datetime(2025, 1, 15)


def item(cost, kind="Usage", day=DAY, **more):
    return {"usage_start_date": day, "usage_account_id": "111", "product_code": "AmazonEC2",
            "region": "us-east-1", "line_item_type": kind, "unblended_cost": float(cost),
            "blended_cost": float(cost), "net_unblended_cost": float(cost), "usage_amount": 1.0,
            "billing_period_start": date(2025, 1, 1), **more}


def test_summary_leaves_out_non_usage(spark, make_line_items):
    items = make_line_items(
        [item(100), item(10, "Tax"), item(5, "Credit"), item(5, None), item(1, "Refund")])
    (row,) = ops.summarize_line_items(items).collect()
    assert (row["total_unblended_cost"], row["line_item_count"], row["data_source"]) == (100.0, 1, "cur")


def test_all_null_measure_sums_to_null(spark, make_line_items):
    items = make_line_items([item(100, net_unblended_cost=None), item(10, net_unblended_cost=None)])
    (row,) = ops.summarize_line_items(items).collect()
    assert row["total_unblended_cost"] == 110.0 and row["total_net_amortized_cost"] is None


def test_summary_of_a_range(spark, make_line_items):
    items = make_line_items([item(1), item(2, day=datetime(2025, 1, 16, 23)), item(4, day=datetime(2025, 1, 17))])
    got = ops.summarize_line_items(items, date(2025, 1, 15), date(2025, 1, 16))
    assert rows_of(got, "usage_date", "total_unblended_cost") == [
        (date(2025, 1, 15), 1.0), (date(2025, 1, 16), 2.0)]


def api(spark, *rows):
    return ops.api_summary(spark.createDataFrame(
        [(d, "111", "AmazonEC2", float(c), float(c), float(c)) for d, c in rows],
        "usage_date date, usage_account_id string, product_code string, "
        "total_unblended_cost double, total_blended_cost double, total_net_amortized_cost double"))


def test_api_rows_are_padded(spark):
    (row,) = api(spark, (date(2025, 1, 1), 5)).collect()
    assert (row["region"], row["total_usage_amount"], row["line_item_count"], row["data_source"]) == (
        "", 0.0, 0, "cost_explorer")


def state(summary):
    return rows_of(summary, "usage_date", "total_unblended_cost", "data_source")


D1, D2, D3, D15 = (date(2025, 1, d) for d in (1, 2, 3, 15))
CASES = [
    # what is held, what comes in, what must be there
    ([(D15, 100)], [(D15, 110)], [(D15, 110.0)]),
    ([(D15, 100)], [], [(D15, 100.0)]),
    ([(D1, 100), (D15, 50)], [(D15, 55)], [(D1, 100.0), (D15, 55.0)]),
    # the middle day has no incoming row and goes
    ([(D1, 1), (D2, 2), (D3, 3), (D15, 4)], [(D1, 10), (D3, 30)], [(D1, 10.0), (D3, 30.0), (D15, 4.0)]),
    ([], [(D1, 10)], [(D1, 10.0)]),
]


@pytest.mark.parametrize("held, incoming, expected", CASES)
def test_range_replace(spark, make_summary, tmp_path, held, incoming, expected):
    cur = make_summary([(D2, "1", "AmazonS3", "r", 9)])
    expected = sorted([(d, c, "cost_explorer") for d, c in expected] + [(D2, 9.0, "cur")], key=repr)
    lazy = ops.replace_range(ops.union_sources(cur, api(spark, *held)), api(spark, *incoming))
    assert state(lazy) == expected
    root = str(tmp_path)
    tables.write_rebuilt_summary(cur, root)
    tables.write_summary_range(api(spark, *held), root)
    assert tables.write_summary_range(api(spark, *incoming), root) == len(incoming)
    assert state(tables.read_summary(spark, root)) == expected


def test_rebuild_keeps_api_rows_and_drops_vanished_days(spark, make_line_items, tmp_path):
    root = str(tmp_path)
    tables.write_summary_range(api(spark, (D1, 5)), root)
    assert tables.read_summary(spark, str(tmp_path / "none")).isEmpty()
    first = make_line_items([item(1), item(2, day=datetime(2025, 1, 3))])
    assert tables.write_rebuilt_summary(ops.summarize_line_items(first), root) == 2
    second = make_line_items([item(3)])
    assert tables.write_rebuilt_summary(ops.summarize_line_items(second), root) == 1
    stored = tables.read_summary(spark, root)
    assert state(stored) == [(D1, 5.0, "cost_explorer"), (D15, 3.0, "cur")]
    assert stored.schema == DAILY_SUMMARY
    replaced = ops.replace_source(stored, ops.summarize_line_items(first))
    assert set(state(replaced)) == {(D1, 5.0, "cost_explorer"), (D3, 2.0, "cur"), (D15, 1.0, "cur")}


def test_older_tables_get_added_columns(spark, make_summary):
    older = make_summary([(D1, "1", "p", "r", 3)]).drop("data_source", "total_net_amortized_cost")
    (row,) = conform(older, DAILY_SUMMARY).collect()
    assert (row["data_source"], row["total_net_amortized_cost"]) == ("cur", 0.0)
    assert conform(spark.range(1).select(F.lit("x").alias("line_item_id")), LINE_ITEMS).first()["billing_entity"] is None


def test_preferred_source(spark, make_summary):
    cur = [(D1, "1", "p", "r", 1)]
    both = make_summary([*cur, (D1, "1", "p", "", 2, "cost_explorer")])
    assert state(ops.preferred_source(both)) == [(D1, 2.0, "cost_explorer")]
    assert state(ops.preferred_source(make_summary(cur))) == [(D1, 1.0, "cur")]


def test_readers_see_a_rebuild_whole_or_not_at_all(spark, make_line_items, tmp_path):
    root = str(tmp_path)
    tables.write_rebuilt_summary(ops.summarize_line_items(make_line_items([item(1), item(2, day=datetime(2025, 1, 3))])), root)
    old = [(D15, 1.0, "cur"), (D3, 2.0, "cur")]
    pinned = tables.read_summary(spark, root)
    seen = []

    def watch(where, *rest, publish=tables._publish):
        # All of the new rows are in the table's folder by now; a reader who comes here must not see them.
        seen.append(state(tables.read_summary(spark, root)))
        publish(where, *rest)

    tables._publish, publish = watch, tables._publish
    try:
        tables.write_rebuilt_summary(ops.summarize_line_items(make_line_items([item(7)])), root)
    finally:
        tables._publish = publish
    assert seen == [sorted(old, key=repr)]
    # Who read before keeps what was there; who reads now gets the new rows only.
    assert state(pinned) == sorted(old, key=repr)
    assert state(tables.read_summary(spark, root)) == [(D15, 7.0, "cur")]
    assert state(tables.read_summary_as_of(spark, root, 1)) == sorted(old, key=repr)


def test_a_rebuild_that_breaks_off_changes_nothing(spark, make_line_items, tmp_path, monkeypatch):
    root = str(tmp_path)
    tables.write_rebuilt_summary(ops.summarize_line_items(make_line_items([item(1)])), root)
    new = ops.summarize_line_items(make_line_items([item(2)]))
    with monkeypatch.context() as patched:
        patched.setattr(tables, "_publish", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tables.write_rebuilt_summary(new, root)
    assert state(tables.read_summary(spark, root)) == [(D15, 1.0, "cur")]
    # Half a commit file is no commit.
    half = tmp_path / tables.SUMMARY_TABLE / "_commits" / f"{2:012d}"
    half.write_text("cur\t2025-01-15\tsome")
    assert state(tables.read_summary(spark, root)) == [(D15, 1.0, "cur")]
    tables.write_rebuilt_summary(new, root)
    assert state(tables.read_summary(spark, root)) == [(D15, 2.0, "cur")]


def test_of_two_writers_one_fails(spark, make_line_items, tmp_path):
    root = str(tmp_path)
    summary = ops.summarize_line_items(make_line_items([item(1)]))
    tables.write_rebuilt_summary(summary, root)
    with pytest.raises(Exception, match="exists"):
        tables._publish(spark, root, 1, {})
    assert state(tables.read_summary(spark, root)) == [(D15, 1.0, "cur")]


def test_folders_no_commit_names_are_removed(spark, make_line_items, tmp_path):
    root = str(tmp_path)
    for cost in (1, 2, 3):
        tables.write_rebuilt_summary(ops.summarize_line_items(make_line_items([item(cost)])), root)
    assert tables.expire_summary(spark, root, keep=2) == 1
    assert state(tables.read_summary_as_of(spark, root, 2)) == [(D15, 2.0, "cur")]
    assert tables.expire_summary(spark, root, keep=1) == 1 and tables.expire_summary(spark, root, keep=1) == 0
    assert state(tables.read_summary(spark, root)) == [(D15, 3.0, "cur")]
    tables.write_rebuilt_summary(ops.summarize_line_items(make_line_items([item(4)])), root)
    assert tables.summary_commit(spark, root)[0] == 4


def test_a_range_of_days_reads_their_months_only(spark, make_summary, tmp_path):
    root = str(tmp_path)
    months = [date(2025, m, d) for m in (1, 2, 3) for d in (1, 20)]
    tables.write_rebuilt_summary(make_summary([*((d, "1", "p", "r", 1) for d in months), (None, "1", "p", "r", 9)]), root)
    tables.write_summary_range(api(spark, (date(2025, 2, 2), 5), (date(2025, 3, 3), 6)), root)
    asked = tables.read_summary(spark, root, date(2025, 2, 1), date(2025, 2, 19))
    assert state(asked) == [(date(2025, 2, 1), 1.0, "cur"), (date(2025, 2, 2), 5.0, "cost_explorer")]
    assert len(asked.inputFiles()) == 2 and all("usage_month=2025-02" in f for f in asked.inputFiles())
    assert len(tables.read_summary(spark, root, data_source="cur").inputFiles()) == 4
    assert "PushedFilters: [IsNotNull(usage_date)" in asked._jdf.queryExecution().executedPlan().toString()
    assert tables.read_summary(spark, root).filter("usage_date IS NULL").count() == 1


def test_replacing_a_day_carries_the_rest_of_its_month_over(spark, make_summary, tmp_path):
    root = str(tmp_path)
    tables.write_rebuilt_summary(make_summary([(d, "1", "p", "r", 1) for d in (D1, D2, None)]), root)
    tables.write_rebuilt_days(make_summary([(D2, "1", "p", "r", 7)]), root, [D2, D3])
    assert state(tables.read_summary(spark, root)) == sorted([(D1, 1.0, "cur"), (D2, 7.0, "cur"), (None, 1.0, "cur")], key=repr)
    tables.write_rebuilt_days(make_summary([]), root, [D1, None])
    assert state(tables.read_summary(spark, root)) == [(D2, 7.0, "cur")]
