"""Trends, comparison, drill-down and attribution on small fixtures."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest

from conftest import days, rows_of
from ledgerloom.operators import attribution, changes, comparison, drilldown, totals, trends

START = date(2025, 1, 1)
A, B = (START, date(2025, 1, 7)), (date(2025, 1, 8), date(2025, 1, 14))


@pytest.fixture(scope="module")
def two_periods(make_summary):
    rows = []
    for d in days(START, 7):
        rows += [(d, "111", p, "us-east-1", c) for p, c in
                 (("AmazonEC2", 88), ("AmazonS3", 17.6), ("AmazonRDS", 44))]
    for d in days(B[0], 7):
        rows += [(d, "111", p, "us-east-1", c) for p, c in
                 (("AmazonEC2", 176), ("AmazonS3", 17.6), ("AWSLambda", 26.4))]
    return make_summary(rows)


def test_compare_periods(two_periods):
    got = {r["group_value"]: r for r in comparison.compare_periods(two_periods, A, B).collect()}
    assert {k: r["category"] for k, r in got.items()} == {
        "AmazonEC2": "mover", "AmazonS3": "mover", "AWSLambda": "new", "AmazonRDS": "disappeared"}
    ec2 = got["AmazonEC2"]
    assert (ec2["rank"], ec2["absolute_change"], ec2["pct_change"]) == (
        1, pytest.approx(616), pytest.approx(100))
    assert got["AmazonS3"]["rank"] == 2 and got["AmazonS3"]["absolute_change"] == pytest.approx(0)
    assert got["AWSLambda"]["pct_change"] is None and got["AWSLambda"]["rank"] is None
    total = comparison.comparison_totals(two_periods, A, B).first()
    assert (total["a_total"], total["b_total"], total["absolute_change"]) == (
        pytest.approx(1047.2), pytest.approx(1540.0), pytest.approx(492.8))
    assert round(total["pct_change"], 1) == 47.1


def test_only_movers_are_cut(two_periods, make_summary):
    got = comparison.compare_periods(two_periods, A, B, top_n=1)
    assert rows_of(got, "category", "group_value") == [
        ("disappeared", "AmazonRDS"), ("mover", "AmazonEC2"), ("new", "AWSLambda")]
    many = make_summary([(B[0], "1", f"p{i}", "r", i + 1) for i in range(30)])
    assert comparison.compare_periods(many, A, B, top_n=2).count() == 30


def test_compare_empty_and_invalid(two_periods):
    none = ((date(2020, 1, 1), date(2020, 1, 2)), (date(2020, 2, 1), date(2020, 2, 2)))
    assert comparison.compare_periods(two_periods, *none).isEmpty()
    total = comparison.comparison_totals(two_periods, *none).first()
    assert (total["a_total"], total["b_total"], total["pct_change"]) == (0.0, 0.0, None)
    for periods, options in (((A[::-1], B), {}), ((A, B[::-1]), {}), ((A, B), {"group_by": "x"}),
                             ((A, B), {"top_n": 0})):
        with pytest.raises(ValueError):
            comparison.compare_periods(two_periods, *periods, **options)


def test_null_keys_do_not_match(make_summary):
    rows = make_summary([(A[0], "1", None, "r", 5), (B[0], "1", None, "r", 7), (A[0], "1", "", "r", 1)])
    got = comparison.compare_periods(rows, A, B, top_n=1)
    assert rows_of(got, "category", "group_value", "a_cost", "b_cost") == sorted([
        ("disappeared", None, 5.0, 0.0), ("new", None, 0.0, 7.0), ("disappeared", "", 1.0, 0.0)], key=repr)
    safe = comparison.compare_periods(rows, A, B, null_safe=True)
    assert ("mover", None, 5.0, 7.0) in rows_of(safe, "category", "group_value", "a_cost", "b_cost")


def test_zero_cost_null_keys_are_both_kept(make_summary):
    rows = make_summary([(A[0], "1", None, "r", 0), (B[0], "1", None, "r", 0)])
    assert comparison.compare_periods(rows, A, B, top_n=1).count() == 2


def test_sources_are_summed_unless_chosen(make_summary):
    rows = make_summary([(A[0], "1", "p", "r", 5), (A[0], "1", "p", "", 5, "cost_explorer")])
    assert comparison.comparison_totals(rows, A, B).first()["a_total"] == 10.0
    one = comparison.comparison_totals(rows, A, B, data_source="cur")
    assert one.first()["a_total"] == 5.0


@pytest.fixture(scope="module")
def without_rds_lambda(two_periods):
    return two_periods.filter("product_code IN ('AmazonEC2', 'AmazonS3')")


def test_cost_trend(without_rds_lambda):
    span = (A[0], B[1])
    daily = trends.cost_trend(without_rds_lambda, *span)
    assert daily.count() == 14
    stats = trends.trend_statistics(daily).first()
    assert stats["total"] == 2094.4 and stats["average"] == round(2094.4 / 14, 2)
    assert (stats["min_cost"], stats["max_cost"]) == (105.6, 193.6)
    weekly = trends.cost_trend(without_rds_lambda, *span, granularity="weekly")
    assert [(r["usage_date"], round(r["cost"], 2)) for r in totals.by_date(weekly).collect()] == [
        (date(2024, 12, 30), 528.0), (date(2025, 1, 6), 1179.2), (date(2025, 1, 13), 387.2)]
    grouped = trends.cost_trend(
        without_rds_lambda, *span, group_by="product_code", granularity="monthly")
    assert {r["group_value"]: round(r["cost"], 2) for r in grouped.collect()} == {
        "AmazonEC2": 1848.0, "AmazonS3": 246.4}
    one = trends.cost_trend(
        without_rds_lambda, *span, group_by="product_code", filter_value="AmazonS3")
    assert {r["group_value"] for r in one.collect()} == {"AmazonS3"}
    empty = trends.cost_trend(without_rds_lambda, date(2020, 1, 1), date(2020, 1, 2))
    assert empty.isEmpty() and tuple(trends.trend_statistics(empty).first()) == (0.0,) * 4
    for options in ({"filter_value": "x"}, {"group_by": "x"}, {"granularity": "hourly"}):
        with pytest.raises(ValueError):
            trends.cost_trend(without_rds_lambda, *span, **options)
    with pytest.raises(ValueError):
        trends.cost_trend(without_rds_lambda, *span[::-1])


def test_daily_trends(make_summary):
    d = days(START, 4)
    rows = make_summary([
        (d[0], "1", "a", "r", 10), (d[1], "1", "a", "r", 15), (d[3], "1", "a", "r", 12),
        (d[0], "1", "b", "r", 0), (d[1], "1", "b", "r", 4),
        (d[0], "1", None, "r", 100), (d[0], "1", "", "r", 50), (d[0], "1", "small", "r", 1)])
    got = trends.daily_trends(rows, reference_date=d[3], days=3, top_n=4)
    assert rows_of(got) == sorted([
        (d[0], "a", 10.0, None, None), (d[1], "a", 15.0, 5.0, 50.0), (d[3], "a", 12.0, -3.0, -20.0),
        (d[0], "b", 0.0, None, None), (d[1], "b", 4.0, 4.0, None),
        (d[0], "unknown", 50.0, None, None)], key=repr)
    assert trends.daily_trends(rows, reference_date=date(2026, 1, 1)).isEmpty()
    later = trends.daily_trends(rows, reference_date=d[1], days=0, top_n=1)
    assert rows_of(later, "usage_date", "total_cost") == [(d[1], 15.0), (d[3], 12.0)]
    ended = trends.daily_trends(rows, reference_date=d[1], days=0, top_n=1, end=d[1])
    assert rows_of(ended, "usage_date", "total_cost") == [(d[1], 15.0)]
    with pytest.raises(ValueError):
        trends.daily_trends(rows, group_by="usage_type")


def test_total_daily_costs(two_periods):
    got = trends.total_daily_costs(two_periods, reference_date=B[1], days=1)
    assert [(r["usage_date"], round(r["total_cost"], 2)) for r in totals.by_date(got).collect()] == [
        (B[1] - timedelta(1), 220.0), (B[1], 220.0)]


def detail(day, account, product, usage_type, operation, resource, cost):
    return {"usage_start_date": datetime(day.year, day.month, day.day, 7),
            "usage_account_id": account, "product_code": product, "usage_type": usage_type,
            "operation": operation, "resource_id": resource, "net_unblended_cost": cost,
            "usage_amount": 1.0, "line_item_type": "Usage"}


@pytest.fixture(scope="module")
def spike_detail(make_line_items):
    d = date(2025, 1, 15)
    return make_line_items([
        detail(d, "111", "AmazonEC2", "BoxUsage:m5", "Run", "i-1", 120.0),
        detail(d, "111", "AmazonEC2", "BoxUsage:m5", "Run", "i-2", 20.0 + 60.0 - 60.0),
        detail(d, "111", "AmazonEC2", "BoxUsage:c5", "Run", "i-2", 60.0),
        detail(d, "111", "AmazonEC2", "BoxUsage:c5", "Run", "i-3", 60.0),
        detail(d, "111", "AmazonEC2", "EBS", "Create", None, 25.0),
        detail(d, "111", "AmazonEC2", "Transfer", "Transfer", "", 15.0),
        detail(d, "222", "AmazonEC2", "BoxUsage:t3", "Run", "i-4", 5.0),
        detail(d, "111", "AmazonS3", "Storage", "Put", "bucket", 9.0)])


def test_drill_down(spike_detail):
    d = date(2025, 1, 15)
    got = drilldown.drill_down(spike_detail, "AmazonEC2", d, d).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["dimension"], []).append((r["key"], r["cost"], round(r["pct_of_total"], 1)))
    assert by["total"] == [(None, 305.0, 100.0)]
    assert by["usage_type"] == [
        ("BoxUsage:m5", 140.0, 45.9), ("BoxUsage:c5", 120.0, 39.3), ("EBS", 25.0, 8.2),
        ("Transfer", 15.0, 4.9), ("BoxUsage:t3", 5.0, 1.6)]
    assert [c for _, c, _ in by["operation"]] == [265.0, 25.0, 15.0]
    assert by["resource_id"] == [
        ("i-1", 120.0, 39.3), ("i-2", 80.0, 26.2), ("i-3", 60.0, 19.7), ("i-4", 5.0, 1.6)]
    usage = {r["key"]: r["usage_amount"] for r in got if r["dimension"] == "usage_type"}
    assert usage["BoxUsage:m5"] == 2.0
    one = drilldown.drill_down(spike_detail, "AmazonEC2", d, d, account_id="111", top_n=1)
    assert rows_of(one, "dimension", "cost") == [
        ("operation", 260.0), ("resource_id", 120.0), ("total", 300.0), ("usage_type", 140.0)]


def test_drill_down_without_rows(spike_detail):
    d = date(2025, 1, 15)
    assert drilldown.drill_down(spike_detail, "Nothing", d, d).isEmpty()
    with pytest.raises(ValueError, match="no line items"):
        drilldown.drill_down(spike_detail, "Nothing", d, d, strict=True)
    with pytest.raises(ValueError):
        drilldown.drill_down(spike_detail, "AmazonEC2", d, d - timedelta(1))


def test_drill_down_of_zero_total(make_line_items):
    d = date(2025, 1, 15)
    items = make_line_items([detail(d, "1", "p", None, "o", "x", 5.0), detail(d, "1", "p", None, "o", "y", -5.0)])
    got = drilldown.drill_down(items, "p", d, d)
    assert {r["pct_of_total"] for r in got.collect()} == {0.0}
    assert ("usage_type", "unknown") in rows_of(got, "dimension", "key")
    nulls = make_line_items([detail(d, "1", "p", "u", "o", "x", None)])
    assert {r["cost"] for r in drilldown.drill_down(nulls, "p", d, d).collect()} == {0.0}


@pytest.fixture(scope="module")
def changed_detail(make_line_items):
    rows = []
    for d in days(A[0], 7):
        rows += [detail(d, "111", "AmazonEC2", "BoxUsage:m5.xlarge", "Run", "i-1", 80.0),
                 detail(d, "111", "AmazonEC2", "EBS", "Create", "vol-1", 15.0)]
    rows.append(detail(A[0], "222", "AmazonEC2", "BoxUsage:t3.micro", "Run", "i-9", 5.0))
    for d in days(B[0], 7):
        rows += [detail(d, "111", "AmazonEC2", "BoxUsage:m5.xlarge", "Run", "i-1", 160.0),
                 detail(d, "111", "AmazonEC2", "SpotUsage", "Run", "i-2", 40.0)]
    return make_line_items(rows)


def test_attribution(changed_detail):
    got = attribution.attribute_change(changed_detail, "AmazonEC2", A, B)
    types = got.filter("dimension = 'usage_type'")
    assert rows_of(types, "category", "rank", "key", "a_cost", "b_cost") == sorted([
        ("mover", 1, "BoxUsage:m5.xlarge", 560.0, 1120.0), ("new", 1, "SpotUsage", 0.0, 280.0),
        ("disappeared", 1, "EBS", 105.0, 0.0), ("disappeared", 2, "BoxUsage:t3.micro", 5.0, 0.0)], key=repr)
    assert got.filter("dimension = 'resource_id'").count() == 4
    total = attribution.attribution_totals(changed_detail, "AmazonEC2", A, B).first()
    assert (total["a_total"], total["b_total"]) == (670.0, 1400.0)
    one = attribution.attribution_totals(changed_detail, "AmazonEC2", A, B, account_id="111")
    assert one.first()["a_total"] == 665.0
    cut = attribution.attribute_change(changed_detail, "AmazonEC2", A, B, top_n=1)
    assert cut.filter("dimension = 'usage_type'").count() == 3
    with pytest.raises(ValueError, match="either period"):
        attribution.attribute_change(changed_detail, "Nothing", A, B, strict=True)
    with pytest.raises(ValueError):
        attribution.attribute_change(changed_detail, "AmazonEC2", A[::-1], B)


def test_overlapping_periods_count_on_both_sides(changed_detail):
    whole = (A[0], B[1])
    total = attribution.attribution_totals(changed_detail, "AmazonEC2", whole, B).first()
    assert (total["a_total"], total["b_total"]) == (2070.0, 1400.0)


def test_two_sided_costs_against_a_join(spark):
    """One pass of conditional sums gives what grouping twice and joining gives."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", "", None, "z"]), rng.random() < 0.5, rng.random() < 0.5,
             float(rng.randint(-3, 3))) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, in_a boolean, in_b boolean, cost double")
    got = changes.two_sided_costs(df, ["k"], F.col("in_a"), F.col("in_b"), F.col("cost"))
    a = df.filter("in_a").groupBy("k").agg(F.sum("cost").alias("a")).alias("a")
    b = df.filter("in_b").groupBy("k").agg(F.sum("cost").alias("b")).alias("b")
    joined = a.join(b, F.col("a.k") == F.col("b.k"), "full_outer").select(
        F.coalesce("a.k", "b.k"), F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))
    assert rows_of(got, "k", "a_cost", "b_cost") == rows_of(joined)
