"""Guarded ad-hoc SQL, the questions asked of the summary, and look-ups."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Window, functions as F

from ledgerloom.operators import adhoc, filters, lookups, totals
from ledgerloom.operators import summary as summary_ops
from ledgerloom.plans import samples
from ledgerloom.plans.registry import query
from ledgerloom.plans.samples import ACCOUNT, SERVICE
from ledgerloom.sources import sample_tables as tables
from ledgerloom.sources.api_pages import api_cost_by_dimension as cost_by_dimension

_COST = "SUM(total_net_amortized_cost) AS cost"


def _summary(spark, sf, *by):
    return tables.summary_rows(spark, sf, by)


def _answer(df, *keys):
    return totals.group_costs(df, keys)


# Guarded ad-hoc SQL

_ADHOC = """-- cost per service and month
WITH monthly AS (
  SELECT product_code, date_trunc('month', usage_date) AS month,
         SUM(total_net_amortized_cost) AS cost
  FROM daily_cost_summary GROUP BY product_code, date_trunc('month', usage_date))
SELECT product_code, COUNT(*) AS months, MAX(cost) AS dearest FROM monthly GROUP BY product_code;"""


@query(
    """WITH monthly AS (
  SELECT product_code, date_trunc('month', usage_date) AS month,
         SUM(total_net_amortized_cost) AS cost
  FROM summary GROUP BY 1, 2)
SELECT product_code, COUNT(*) AS months, MAX(cost) AS dearest FROM monthly GROUP BY product_code"""
)
def sql_query(spark, sf):
    return adhoc.run_sql(
        spark, _ADHOC, {"daily_cost_summary": _summary(spark, sf, "product_code")}
    )


@query(
    """SELECT '{"usage_account_id":"' || usage_account_id || '","line_items":' || COUNT(*)
       || ',"first_day":"' || MIN(usage_date) || '"}' AS row,
  'usage_account_id,line_items,first_day' AS columns,
  COUNT(*) OVER () AS row_count, CAST(NULL AS VARCHAR) AS error
FROM line_items GROUP BY usage_account_id
UNION ALL SELECT NULL, '', 0, 'not among the tables given: daily_cost_summary'"""
)
def sql_execute(spark, sf):
    """The outcome of a query that is answered, and of one that is refused, row by row."""
    rows = tables.line_items(spark, sf, ["usage_account_id", "usage_start_date"])
    texts = (
        """SELECT usage_account_id, COUNT(*) AS line_items,
                  MIN(CAST(usage_start_date AS DATE)) AS first_day
           FROM cost_line_items GROUP BY usage_account_id""",
        "SELECT * FROM daily_cost_summary",
    )
    outcomes = [adhoc.execute_sql(spark, text, {"cost_line_items": rows}) for text in texts]
    return outcomes[0].table(spark).unionByName(outcomes[1].table(spark))


# Questions


@query(f"SELECT {_COST} FROM summary WHERE usage_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'")
def q_total_spend(spark, sf):
    start, end = date(1997, 3, 1), date(1997, 3, 31)
    rows = tables.summary_rows(spark, sf, [], start, end)
    return filters.in_range(rows, start, end).agg(F.sum("total_net_amortized_cost").alias("cost"))


@query(f"SELECT product_code, {_COST} FROM summary GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def q_top_services(spark, sf):
    top = totals.top_groups(_summary(spark, sf, "product_code"), "product_code", 5)
    return top.withColumnRenamed("total_cost", "cost")


@query(f"SELECT usage_account_id, {_COST} FROM summary GROUP BY 1 ORDER BY 2 DESC")
def q_by_account(spark, sf):
    costs = _answer(_summary(spark, sf, "usage_account_id"), "usage_account_id")
    return costs.orderBy(F.col("cost").desc(), "usage_account_id")


@query(f"SELECT region, {_COST} FROM summary GROUP BY 1")
def q_by_region(spark, sf):
    return _answer(_summary(spark, sf, "region"), "region")


@query(
    f"""SELECT usage_account_id, region, {_COST} FROM summary
WHERE product_code = '{SERVICE}' GROUP BY 1, 2"""
)
def q_service_account_region(spark, sf):
    rows = filters.for_service(_summary(spark, sf, *tables.DIMENSIONS), SERVICE)
    return _answer(rows, "usage_account_id", "region")


@query(f"SELECT product_code, {_COST} FROM summary WHERE usage_account_id = '{ACCOUNT}' GROUP BY 1")
def q_account_services(spark, sf):
    rows = _summary(spark, sf, "product_code", "usage_account_id")
    return _answer(filters.for_account(rows, ACCOUNT), "product_code")


@query(
    """SELECT date_trunc('month', usage_date)::DATE AS month, COUNT(*) AS days, AVG(cost) AS daily_average
FROM (SELECT usage_date, SUM(total_net_amortized_cost) AS cost FROM summary GROUP BY 1)
GROUP BY 1""",
    text=("month",),
)
def q_daily_average(spark, sf):
    daily = _answer(_summary(spark, sf), "usage_date")
    return daily.groupBy(F.trunc("usage_date", "month").alias("month")).agg(
        F.count("*").alias("days"), F.avg("cost").alias("daily_average")
    )


@query(f"SELECT product_code, {_COST} FROM summary WHERE usage_date > DATE '2030-01-01' GROUP BY 1")
def q_no_data_range(spark, sf):
    """A range without data has no rows, not rows of zero."""
    rows = _summary(spark, sf, "product_code")
    return _answer(filters.in_range(rows, date(2030, 1, 2), date(2031, 1, 1)), "product_code")


@query(
    """WITH daily AS (
  SELECT usage_account_id, usage_date, SUM(total_net_amortized_cost) AS cost
  FROM summary GROUP BY 1, 2),
changes AS (
  SELECT *, cost - LAG(cost) OVER (PARTITION BY usage_account_id ORDER BY usage_date) AS change
  FROM daily)
SELECT usage_account_id, usage_date, change FROM changes WHERE change IS NOT NULL
ORDER BY abs(change) DESC, usage_account_id, usage_date LIMIT 1""",
    text=("usage_date",),
)
def q_day_over_day(spark, sf):
    """The account and day of the greatest change from one day to the next."""
    daily = _answer(_summary(spark, sf, "usage_account_id"), "usage_account_id", "usage_date")
    before = F.lag("cost").over(Window.partitionBy("usage_account_id").orderBy("usage_date"))
    return (
        daily.select("usage_account_id", "usage_date", (F.col("cost") - before).alias("change"))
        .filter(F.col("change").isNotNull())
        .orderBy(F.abs("change").desc(), "usage_account_id", "usage_date")
        .limit(1)
    )


@query(
    f"""SELECT product_code, {_COST} FROM summary GROUP BY product_code
UNION ALL SELECT 'total', SUM(total_net_amortized_cost) FROM summary"""
)
def q_cross_check(spark, sf):
    """Services beside the grand total they add up to."""
    rows = _summary(spark, sf, "product_code")
    return rows.rollup("product_code").agg(
        F.sum("total_net_amortized_cost").alias("cost"), F.grouping("product_code").alias("all")
    ).select(
        F.when(F.col("all") == 1, "total").otherwise(F.col("product_code")).alias("product_code"),
        "cost",
    )


@query(
    """SELECT product_code, SUM(net_unblended_cost) AS cost FROM line_items
WHERE billing_entity = 'AWS Marketplace' GROUP BY 1"""
)
def q_marketplace(spark, sf):
    rows = tables.line_items(spark, sf, ["product_code", "billing_entity", "net_unblended_cost"])
    return totals.group_costs(
        rows.filter(F.col("billing_entity") == "AWS Marketplace"),
        ["product_code"],
        "net_unblended_cost",
    )


@query(
    f"""SELECT product_code, {_COST} FROM summary
WHERE data_source = CASE WHEN EXISTS (SELECT 1 FROM summary WHERE data_source = 'cost_explorer')
                    THEN 'cost_explorer' ELSE 'cur' END
GROUP BY 1"""
)
def q_source_preference(spark, sf):
    rows = summary_ops.preferred_source(_summary(spark, sf, "product_code"))
    return _answer(rows, "product_code")


# Look-ups


@query(
    """SELECT CAST(date_trunc('month', usage_date) AS DATE) AS start,
       CASE product_code WHEN 'view' THEN 'AWS Lambda' WHEN 'click' THEN 'Amazon CloudFront'
            ELSE product_code END AS group_key,
       SUM(cost) AS unblended_cost, SUM(cost) AS net_amortized_cost
FROM api_cells GROUP BY 1, 2""",
    text=("start",),
)
def api_cost_by_dimension(spark, sf):
    return cost_by_dimension(samples.api_pages(spark, sf), granularity="MONTHLY")


@query(
    """SELECT date_trunc('hour', ts) AS hour, MAX(value) AS maximum, AVG(value * 64) / 64 AS average
FROM (SELECT ts, FLOOR(value * 64 + 0.5) / 64 AS value FROM events) GROUP BY 1""",
    text=("hour",),
)
def metric_hourly(spark, sf):
    """Hourly greatest and mean event value over the thirty days before February."""
    events = tables.table(spark, sf, "events").select(
        "ts", (F.floor(F.col("value") * 64 + 0.5) / 64).alias("value")
    )
    return lookups.metric_hourly(events, datetime(2024, 2, 1), hours=31 * 24)


@query(
    """SELECT name, state, metric, threshold FROM (
  SELECT 'cost of user ' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS name,
         CASE WHEN SUM(FLOOR(value * 64 + 0.5)) > 64 * 1000 THEN 'ALARM' ELSE 'OK' END AS state,
         'value' AS metric, CAST(1000.0 AS DOUBLE) AS threshold
  FROM events GROUP BY user_id)
WHERE state = 'ALARM' ORDER BY name"""
)
def alarms_active(spark, sf):
    """Alarms on the total value of each user: those that are raised."""
    total = F.sum(F.floor(F.col("value") * 64 + 0.5))
    alarms = (
        tables.table(spark, sf, "events")
        .groupBy("user_id")
        .agg(F.when(total > 64 * 1000, "ALARM").otherwise("OK").alias("state"))
        .select(
            F.concat(F.lit("cost of user "), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("name"),
            "state",
            F.lit("value").alias("metric"),
            F.lit(1000.0).alias("threshold"),
        )
    )
    return lookups.alarms_active(alarms)


_BALANCE = "FLOOR(c_acctbal * 64 + 0.5) / 64"


@query(
    f"""WITH budgets AS (
  SELECT n_name AS account_id, SUM({_BALANCE}) AS budget_limit, MAX({_BALANCE}) AS forecast
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
spend AS (
  SELECT usage_account_id AS account_id, SUM(total_net_amortized_cost) AS actual
  FROM summary GROUP BY 1)
SELECT account_id, 'budget of ' || account_id AS name, budget_limit,
       COALESCE(actual, 0) AS actual_spend, forecast
FROM budgets LEFT JOIN spend USING (account_id)"""
)
def budget_status(spark, sf):
    """Customer balances per nation as budgets of the accounts."""
    balance = F.floor(F.col("c_acctbal") * 64 + 0.5) / 64
    budgets = (
        tables.table(spark, sf, "customer")
        .join(tables.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("account_id"))
        .agg(F.sum(balance).alias("budget_limit"), F.max(balance).alias("forecast"))
        .withColumn("name", F.concat(F.lit("budget of "), "account_id"))
    )
    spend = totals.group_costs(
        _summary(spark, sf, "usage_account_id"), ["usage_account_id"], name="actual_spend"
    ).withColumnRenamed("usage_account_id", "account_id")
    return lookups.budget_status(budgets, spend)


@query(
    f"""WITH costs AS (SELECT usage_account_id, {_COST} FROM summary GROUP BY 1)
SELECT usage_account_id, cost, r_name || ' / ' || n_name AS account_name,
       CASE WHEN n_name IS NOT NULL THEN 'ACTIVE' END AS account_status
FROM costs LEFT JOIN nation ON usage_account_id = n_name LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def account_enrich(spark, sf):
    accounts = (
        tables.table(spark, sf, "nation")
        .join(tables.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_name").alias("account_id"),
            F.concat_ws(" / ", "r_name", "n_name").alias("name"),
            F.lit("ACTIVE").alias("status"),
        )
    )
    costs = _answer(_summary(spark, sf, "usage_account_id"), "usage_account_id")
    return lookups.account_enrich(costs, accounts)
