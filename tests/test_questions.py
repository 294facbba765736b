"""Guarded SQL and the golden month."""

from __future__ import annotations

import json
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest

from conftest import days, rows_of
from ledgerloom.operators import adhoc, filters, lookups, totals


@pytest.mark.parametrize("text", [
    "SELECT 1", "select 1;", "WITH a AS (SELECT 1) SELECT * FROM a", "-- note\nSELECT 1",
    "/* a */ /* b */ SELECT 1", "SELECT updated_at FROM t", "  \n SELECT 1 ;;"])
def test_accepted(text):
    assert not adhoc.check_sql(text).endswith(";")


@pytest.mark.parametrize("text", [
    "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "DELETE FROM t", "DROP TABLE t",
    "CREATE TABLE t (a int)", "ATTACH 'x'", "COPY t TO 'x'", "SHOW TABLES", "SELECT 1; SELECT 2",
    "SELECT * FROM (DELETE FROM t)", "SELECT 'please drop it'", "-- only a comment", "",
    "SELECT reflect('java.lang.System', 'exit')", "EXPLAIN SELECT 1"])
def test_rejected(text):
    with pytest.raises(adhoc.RefusedQueryError):
        adhoc.check_sql(text)


def test_run_sql(spark, make_summary):
    summary = make_summary([(date(2025, 1, 1), "1", "p", "r", 2)])
    result = adhoc.run_sql(
        spark,
        "SELECT usage_date, CAST(1.5 AS DECIMAL(3,1)) AS d, array(1, 2) AS a, region AS r, "
        "CAST(NULL AS STRING) AS n FROM daily_cost_summary;",
        {"daily_cost_summary": summary})
    assert result.first()["d"] == Decimal("1.5")
    assert json.loads(adhoc.json_rows(result).first()["row"]) == {
        "usage_date": "2025-01-01", "d": 1.5, "a": [1, 2], "r": "r", "n": None}


# cost per day of each account: EC2, RDS, S3, CloudFront, Lambda
DAILY = {
    "111": (150, 90, 30, 20, 5), "222": (60, 30, 15, 14, 8), "333": (25, 15, 5, 7, 8)}
PRODUCTS = ("AmazonEC2", "AmazonRDS", "AmazonS3", "AmazonCloudFront", "AWSLambda")


@pytest.fixture(scope="module")
def month(make_summary):
    rows = []
    for d in days(date(2025, 1, 1), 30):
        for account, costs in DAILY.items():
            for product, cost in zip(PRODUCTS, costs):
                rows += [(d, account, product, "us-east-1", cost * 0.6), (d, account, product, "eu-west-1", cost * 0.4)]
    return make_summary(rows)


def shown(df, *keys):
    return {tuple(r[k] for k in keys): round(r["cost"], 2) for r in df.collect()}


def test_golden_month(month):
    per_day = {p: sum(c[i] for c in DAILY.values()) for i, p in enumerate(PRODUCTS)}
    assert month.count() == 900
    assert round(totals.grand_total(month).first()[0], 2) == 30 * sum(per_day.values())
    assert shown(totals.group_costs(month, ["product_code"]), "product_code") == {
        (p,): 30.0 * c for p, c in per_day.items()}
    top = totals.top_groups(month, "product_code", 2).collect()
    assert [r["product_code"] for r in top] == ["AmazonEC2", "AmazonRDS"]
    assert shown(totals.group_costs(month, ["usage_account_id"]), "usage_account_id") == {
        (a,): 30.0 * sum(c) for a, c in DAILY.items()}
    ec2 = filters.for_service(month, "AmazonEC2")
    assert shown(totals.group_costs(ec2, ["usage_account_id", "region"]), "usage_account_id", "region")[
        "111", "us-east-1"] == 2700.0
    stats = totals.daily_total_statistics(month).first()
    assert round(stats["avg_daily"], 2) == sum(per_day.values())
    load = totals.load_statistics(month).first()
    assert (load["first_date"], load["last_date"], load["accounts"], load["services"]) == (
        date(2025, 1, 1), date(2025, 1, 30), 3, 5)
    empty = filters.in_range(month, date(2024, 1, 1), date(2024, 1, 31))
    assert totals.group_costs(empty, ["product_code"]).isEmpty()
    assert totals.grand_total(empty).first()[0] == 0.0


def test_rank_within_drops_rows_before_the_shuffle(month, capsys):
    ranked = totals.rank_within(
        totals.group_costs(month, ["product_code", "usage_account_id"]), ["product_code"],
        [totals.F.col("cost").desc()], 1)
    ranked.explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and rows_of(ranked, "rank") == [(1,)] * 5


def test_more_ranks_than_spark_cuts_early(spark):
    rows = [("hot" if i % 3 else f"k{i % 5}", float(i * 7919 % 4001)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranked = rows_of(totals.rank_within(df, ["k"], [totals.F.col("v").desc()], 1500).filter("k = 'hot'"), "rank")
    assert ranked == sorted(((i,) for i in range(1, 1501)), key=repr)


@pytest.mark.parametrize("text", [
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM others", "SELECT (SELECT MAX(x) FROM others) FROM own",
    "WITH own AS (SELECT * FROM others) SELECT * FROM own", "SELECT * FROM own WHERE EXISTS (SELECT 1 FROM others)",
    "SELECT * FROM own JOIN global_temp.others ON TRUE", "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
    "SELECT * FROM IDENTIFIER('oth' || 'ers')", "SELECT * FROM (WITH others AS (SELECT 1 x) SELECT * FROM others) y JOIN others z",
    "WITH a AS (SELECT * FROM b), b AS (SELECT 1 x) SELECT * FROM a", "SELECT * FROM own, LATERAL (SELECT * FROM others)",
    "SELECT x FROM own WHERE x IN (SELECT x FROM others)", "SELECT * FROM range(5)", "SELECT IDENTIFIER('ab' || 's')(x) FROM own",
    "SELECT x, RANK() OVER (ORDER BY (SELECT MAX(x) FROM others)) FROM own", "SELECT TRANSFORM(x) USING 'cat' FROM own",
    "WITH others AS (SELECT * FROM others) SELECT * FROM others", "SELECT not_built_in(x) FROM own", "SELECT default.abs(x) FROM own"])
def test_only_given_tables(spark, text):
    spark.range(3).toDF("x").createOrReplaceTempView("others")
    own = spark.range(2).toDF("x")
    with pytest.raises(adhoc.RefusedQueryError):
        adhoc.run_sql(spark, text, {"own": own})
    outcome = adhoc.execute_sql(spark, text, {"own": own})
    assert outcome.error and outcome.columns == [] and outcome.row_count() == 0


@pytest.mark.parametrize("text,count", [
    ("WITH RECURSIVE a AS (SELECT 1 x UNION ALL SELECT x + 1 FROM a WHERE x < 3) SELECT * FROM a", 3),
    ("with a as (select x from own), b as (select x from A) select * from b where x in (select max(x) from a)", 1),
    ("SELECT * FROM own TABLESAMPLE (100 PERCENT) t LATERAL VIEW explode(array(1, 2)) v AS y", 4),
    ("SELECT SUM(x) OVER w FROM own WINDOW w AS (PARTITION BY x) ORDER BY 1 LIMIT 1", 1),
    ("SELECT x, COUNT(*) c FROM own GROUP BY GROUPING SETS ((x), ()) HAVING COUNT(*) > 1", 1),
    ("SELECT * FROM own, LATERAL (SELECT own.x + 1) z UNION SELECT 7, LENGTH(CAST(CURRENT_DATE AS STRING))", 3),
    ("SELECT * FROM (SELECT x, 'a' AS k FROM own) PIVOT (SUM(x) FOR k IN ('a', 'b'))", 1),
    ("SELECT t.x FROM VALUES (0), (5) t(x) EXCEPT SELECT x FROM OWN", 1)])
def test_queries_that_are_let_through(spark, text, count):
    assert adhoc.run_sql(spark, text, {"own": spark.range(2).toDF("x")}).count() == count


def test_views_of_the_session_stay(spark):
    spark.range(3).createOrReplaceTempView("own")
    tables = {"own": spark.range(1)}
    assert adhoc.run_sql(spark, "SELECT * FROM own", tables).count() == 1
    assert adhoc.run_sql(spark, "/* c */ WITH a AS (SELECT * FROM own) SELECT * FROM a ORDER BY 1", tables).count() == 1
    assert spark.table("own").count() == 3
    outcome = adhoc.execute_sql(spark, "SELECT id, id + 1 AS next FROM own", tables)
    assert (outcome.columns, outcome.row_count(), outcome.error) == (["id", "next"], 1, None)
    assert outcome.rows().first()["row"] == '{"id":0,"next":1}'
    assert adhoc.execute_sql(spark, "SELECT nothing FROM own", tables).error
    assert rows_of(outcome.table(spark)) == [('{"id":0,"next":1}', "id,next", 1, None)]
    empty = adhoc.execute_sql(spark, "SELECT id FROM own WHERE id > 5", tables)
    assert rows_of(empty.table(spark)) == [(None, "id", 0, None)]
    refused = adhoc.execute_sql(spark, "DROP TABLE own", tables).table(spark)
    assert [(r[0], r[2]) for r in rows_of(refused)] == [(None, 0)] and rows_of(refused)[0][3]


def test_lookups(spark):
    end = datetime(2025, 1, 1, 12)
    metrics = spark.createDataFrame(
        [(end - timedelta(minutes=m), float(v)) for m, v in ((0, 9), (1, 1), (59, 3), (61, 5), (200, 7))],
        "ts timestamp_ntz, value double")
    got = lookups.metric_hourly(metrics, end, hours=2)
    assert rows_of(got) == [(datetime(2025, 1, 1, 10), 5.0, 5.0), (datetime(2025, 1, 1, 11), 3.0, 2.0)]
    assert lookups.metric_hourly(metrics, end, hours=0).count() == 1
    alarms = spark.createDataFrame(
        [(f"a{i:03d}", "ALARM" if i % 2 else "OK") for i in range(150)], "name string, state string")
    assert [r["name"] for r in lookups.alarms_active(alarms).collect()] == [f"a{i:03d}" for i in range(1, 150, 2)]
    assert [r["name"] for r in lookups.alarms_active(alarms, limit=2).collect()] == ["a001", "a003"]
    budgets = spark.createDataFrame([("1", "b", 10.0, 12.0), ("2", "c", 5.0, None)],
                                    "account_id string, name string, budget_limit double, forecast double")
    spend = spark.createDataFrame([("1", 4.0)], "account_id string, actual_spend double")
    assert rows_of(lookups.budget_status(budgets, spend), "account_id", "actual_spend", "forecast") == [
        ("1", 4.0, 12.0), ("2", 0.0, None)]
    costs = spark.createDataFrame([("1", 1.0), ("9", 2.0)], "usage_account_id string, cost double")
    accounts = spark.createDataFrame([("1", "main", "ACTIVE")], "account_id string, name string, status string")
    assert rows_of(lookups.account_enrich(costs, accounts), "usage_account_id", "account_name") == [
        ("1", "main"), ("9", None)]
