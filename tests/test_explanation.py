from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from statistics import median

import pytest

from conftest import days, rows_of
from ledgerloom.operators import explanation as ops

START, DAY = date(2025, 1, 1), date(2025, 1, 15)


def detail(day, account, usage_type, cost, product="AmazonEC2"):
    return {"usage_start_date": datetime(day.year, day.month, day.day), "usage_account_id": account,
            "product_code": product, "usage_type": usage_type, "net_unblended_cost": cost}


@pytest.fixture(scope="module")
def summary(make_summary):
    rows = [(d, "111", "AmazonEC2", "r", 440 if d == DAY else 88) for d in days(START, 18)]
    return make_summary(rows + [(DAY, "111", "AmazonRDS", "r", 176)])


@pytest.fixture(scope="module")
def line_items(make_line_items):
    rows = []
    for d in days(START, 15):
        scale = 5.0 if d == DAY else 1.0
        rows += [detail(d, "111", t, c * scale) for t, c in
                 (("BoxUsage", 70.0), ("EBS", 20.0), ("DataTransfer", 10.0))]
    return make_line_items(rows)


def test_one_anomaly(summary, line_items):
    (row,) = ops.explain_anomaly(summary, line_items, "AmazonEC2", DAY).collect()
    assert (row["baseline_median"], row["baseline_min"], row["baseline_max"], row["anomaly_cost"]) == (
        88.0, 88.0, 88.0, 440.0)
    assert (row["cost_vs_median"], row["cost_multiple"]) == (352.0, 5.0)
    assert (row["is_ongoing"], row["days_after_checked"], row["elevated_days_after"]) == (False, 3, 0)
    assert row["has_baseline"] and row["has_cur_data"] and row["account_id"] is None
    assert [(c["usage_type"], c["baseline_cost"], c["anomaly_cost"], c["absolute_change"], c["pct_change"])
            for c in row["top_usage_type_changes"]] == [
        ("BoxUsage", 70.0, 350.0, 280.0, 400.0), ("EBS", 20.0, 100.0, 80.0, 400.0),
        ("DataTransfer", 10.0, 50.0, 40.0, 400.0)]


def test_without_detail_or_baseline(summary, line_items):
    (row,) = ops.explain_anomaly(summary, line_items, "AmazonRDS", DAY, account_id="").collect()
    assert (row["has_cur_data"], row["has_baseline"], row["anomaly_cost"], row["baseline_median"]) == (
        False, False, 176.0, 176.0)
    assert row["cost_multiple"] == 1.0 and row["top_usage_type_changes"] == []


def test_day_without_cost(summary, line_items):
    late = date(2025, 3, 1)
    assert ops.explain_anomaly(summary, line_items, "AmazonEC2", late).isEmpty()
    for service, day in (("AmazonEC2", late), ("AmazonRDS", START)):
        with pytest.raises(ValueError, match="no cost"):
            ops.explain_anomaly(summary, line_items, service, day, strict=True)


def test_ongoing(make_summary, make_line_items):
    rows = [(d, "1", "p", "r", 100 if d < DAY else 160) for d in days(START, 30)]
    got = ops.explain_anomaly(make_summary(rows), make_line_items([detail(DAY, "1", "t", 1.0)]), "p", DAY)
    (row,) = got.collect()
    assert (row["is_ongoing"], row["days_after_checked"], row["elevated_days_after"]) == (True, 7, 7)


def test_baseline_without_detail_on_the_day(make_summary, make_line_items):
    """Detail of the baseline alone explains nothing."""
    rows = make_summary([(d, "1", "AmazonEC2", "r", 100) for d in days(START, 15)])
    items = make_line_items([detail(START, "1", "t", 1.0)])
    (row,) = ops.explain_anomaly(rows, items, "AmazonEC2", DAY).collect()
    assert not row["has_cur_data"]


def test_null_usage_types_stay_apart(make_summary, make_line_items):
    rows = make_summary([(d, "1", "AmazonEC2", "r", 100) for d in (DAY - timedelta(1), DAY)])
    items = make_line_items([detail(DAY - timedelta(1), "1", None, 3.0), detail(DAY, "1", None, 9.0)])
    (row,) = ops.explain_anomaly(rows, items, "AmazonEC2", DAY).collect()
    assert [(c["usage_type"], c["baseline_cost"], c["anomaly_cost"]) for c in row["top_usage_type_changes"]] == [
        ("unknown", 0.0, 9.0), ("unknown", 3.0, 0.0)]


def test_many_requests_against_a_loop(spark, make_summary, make_line_items):
    rng = random.Random(9)
    cells = {}
    for product in ("a", "b"):
        for account in ("1", "2", None):
            for d in days(START, 40):
                if rng.random() < 0.7:
                    cells[product, account, d] = float(rng.randint(1, 400)) / 4
    summary = make_summary([(d, a, p, "r", c) for (p, a, d), c in cells.items()])
    items = make_line_items([detail(d, a, f"t{rng.randint(0, 14)}", c, p) for (p, a, d), c in cells.items()])
    asked = [(p, d, a) for p in ("a", "b", "c") for a in (None, "1", "2") for d in days(START, 45)]
    requests = spark.createDataFrame(asked, "service string, anomaly_date date, account_id string")
    got = {(r["service"], r["account_id"], r["anomaly_date"]): r
           for r in ops.explain_anomalies(summary, items, requests).collect()}
    expected = 0
    for product, day, account in asked:
        per_day = {}
        for (p, a, d), c in cells.items():
            if p == product and (account is None or a == account):
                per_day[d] = per_day.get(d, 0.0) + c
        if day not in per_day:
            assert (product, account, day) not in got
            continue
        expected += 1
        row = got[product, account, day]
        base = [c for d, c in per_day.items() if timedelta(0) < day - d <= timedelta(14)]
        after = [c for d, c in per_day.items() if timedelta(0) < d - day <= timedelta(7)]
        mid = round(median(base or [per_day[day]]), 2)
        assert row["baseline_median"] == mid and row["has_baseline"] == bool(base)
        assert row["cost_vs_median"] == round(round(per_day[day], 2) - mid, 2)
        assert (row["days_after_checked"], row["elevated_days_after"]) == (
            len(after), sum(c > mid * 1.5 for c in after))
        assert row["has_cur_data"] and len(row["top_usage_type_changes"]) <= 10
        top = row["top_usage_type_changes"]
        assert [abs(c["absolute_change"]) for c in top] == sorted(
            (abs(c["absolute_change"]) for c in top), reverse=True)
    assert len(got) == expected > 100
