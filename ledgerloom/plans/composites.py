"""The analytics operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.operators import anomalies, attribution, comparison, drilldown, explanation, trends
from ledgerloom.operators import summary as summary_ops
from ledgerloom.plans.model_sql import anomalies_sql, rounded
from ledgerloom.plans.registry import query, stored
from ledgerloom.plans.samples import (
    EVENT_DAYS,
    PERIOD_A,
    PERIOD_B,
    REFERENCE,
    SERVICE,
    WHOLE,
)
from ledgerloom.sources import sample_tables as tables

DETAIL = (
    "usage_start_date", "product_code", "usage_type", "operation", "resource_id",
    "usage_amount", "net_unblended_cost",
)
EVENT_START = date(2024, 1, 1)
SCAN = (WHOLE[0].isoformat(), WHOLE[1].isoformat())
_A = f"BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}'"
_B = f"BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{PERIOD_B[1]}'"
_CATEGORY = """CASE WHEN a_cost = 0 THEN 'new' WHEN b_cost = 0 THEN 'disappeared'
            ELSE 'mover' END AS category"""
_CHANGE = """b_cost - a_cost AS absolute_change,
       CASE WHEN a_cost <> 0 THEN (b_cost - a_cost) / a_cost * 100 END AS pct_change"""


@query(
    """SELECT usage_date, SUM(total_net_amortized_cost) AS total_cost
FROM summary WHERE usage_date >= DATE '1995-01-01' GROUP BY usage_date""",
    text=("usage_date",),
)
def total_daily_costs(spark, sf):
    rows = tables.summary_rows(spark, sf, [])
    return trends.total_daily_costs(rows, reference_date=date(1995, 1, 15))


@query(
    """WITH top AS (
  SELECT usage_account_id FROM summary GROUP BY usage_account_id
  ORDER BY SUM(total_net_amortized_cost) DESC, usage_account_id LIMIT 10),
daily AS (
  SELECT usage_date, usage_account_id AS group_value, SUM(total_net_amortized_cost) AS total_cost
  FROM summary WHERE usage_account_id IN (SELECT usage_account_id FROM top) GROUP BY ALL),
lagged AS (
  SELECT *, LAG(total_cost) OVER (PARTITION BY group_value ORDER BY usage_date) AS previous
  FROM daily)
SELECT CAST(usage_date AS VARCHAR) AS usage_date, group_value, total_cost,
       total_cost - previous AS cost_change,
       CASE WHEN previous > 0 THEN (total_cost - previous) / previous * 100 END AS pct_change
FROM lagged"""
)
def daily_trends(spark, sf):
    rows = tables.summary_rows(spark, sf, ["usage_account_id"])
    return trends.daily_trends(
        rows, reference_date=date(1995, 1, 15), group_by="usage_account_id"
    )


@query(
    f"""SELECT CAST(date_trunc('week', usage_date) AS DATE) AS usage_date,
       region AS group_value, SUM(total_net_amortized_cost) AS cost
FROM summary WHERE usage_date BETWEEN DATE '{WHOLE[0]}' AND DATE '{WHOLE[1]}'
GROUP BY 1, 2""",
    text=("usage_date",),
)
def cost_trend(spark, sf):
    rows = tables.summary_rows(spark, sf, ["region"])
    return trends.cost_trend(rows, *WHOLE, group_by="region", granularity="weekly")


@query(
    f"""WITH a AS (
  SELECT usage_account_id AS k, SUM(total_net_amortized_cost) AS cost
  FROM summary WHERE usage_date {_A} GROUP BY 1),
b AS (
  SELECT usage_account_id AS k, SUM(total_net_amortized_cost) AS cost
  FROM summary WHERE usage_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{WHOLE[1]}' GROUP BY 1),
costs AS (
  SELECT COALESCE(a.k, b.k) AS group_value, COALESCE(a.cost, 0) AS a_cost,
         COALESCE(b.cost, 0) AS b_cost
  FROM a FULL OUTER JOIN b ON a.k = b.k),
changes AS (SELECT *, {_CATEGORY}, {_CHANGE} FROM costs),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY category ORDER BY abs(absolute_change) DESC, group_value) AS place FROM changes)
SELECT category, CASE WHEN category = 'mover' THEN place ELSE 0 END AS rank,
       group_value, a_cost, b_cost, absolute_change, pct_change
FROM ranked WHERE category <> 'mover' OR place <= 10"""
)
def compare_periods(spark, sf):
    rows = tables.summary_rows(spark, sf, ["usage_account_id"])
    compared = comparison.compare_periods(
        rows, PERIOD_A, (PERIOD_B[0], WHOLE[1]), group_by="usage_account_id"
    )
    return compared.withColumn("rank", F.coalesce("rank", F.lit(0)))


@query(
    f"""WITH rows AS (SELECT * FROM line_items WHERE product_code = '{SERVICE}'),
cells AS (
  SELECT 'usage_type' AS dimension, usage_type AS key, SUM(net_unblended_cost) AS cost,
         SUM(usage_amount) AS usage_amount FROM rows GROUP BY usage_type
  UNION ALL
  SELECT 'operation', operation, SUM(net_unblended_cost), NULL FROM rows GROUP BY operation
  UNION ALL
  SELECT 'resource_id', resource_id, SUM(net_unblended_cost), NULL FROM rows
  WHERE resource_id IS NOT NULL AND resource_id <> '' GROUP BY resource_id
  UNION ALL
  SELECT 'total', NULL, SUM(net_unblended_cost), NULL FROM rows),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY cost DESC, key) AS rank FROM cells)
SELECT dimension, rank, key, cost,
       cost / (SELECT SUM(net_unblended_cost) FROM rows) * 100 AS pct_of_total, usage_amount
FROM ranked WHERE rank <= 10"""
)
def drill_down(spark, sf):
    rows = tables.line_items(spark, sf, DETAIL)
    return drilldown.drill_down(rows, SERVICE, *WHOLE)


def two_sided_sql(dimension: str) -> str:
    """A real full outer join of both periods on one dimension of the service."""
    side = f"""SELECT {dimension} AS k, SUM(net_unblended_cost) AS cost FROM line_items
  WHERE product_code = '{SERVICE}' AND usage_date"""
    return f"""SELECT '{dimension}' AS dimension, COALESCE(a.k, b.k) AS key,
       COALESCE(a.cost, 0) AS a_cost, COALESCE(b.cost, 0) AS b_cost
FROM ({side} {_A} GROUP BY 1) AS a
FULL OUTER JOIN ({side} {_B} GROUP BY 1) AS b ON a.k = b.k"""


ATTRIBUTION_SQL = f"""WITH costs AS (
{two_sided_sql("usage_type")}
UNION ALL
{two_sided_sql("resource_id")}),
changes AS (SELECT *, {_CATEGORY}, {_CHANGE} FROM costs),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY dimension, category ORDER BY abs(absolute_change) DESC, key) AS rank
  FROM changes)
SELECT dimension, category, rank, COALESCE(NULLIF(key, ''), 'unknown') AS key,
       a_cost, b_cost, absolute_change, pct_change
FROM ranked WHERE rank <= 10"""


@query(ATTRIBUTION_SQL)
def attribute_change(spark, sf):
    rows = tables.line_items(spark, sf, DETAIL)
    return attribution.attribute_change(rows, SERVICE, PERIOD_A, PERIOD_B)


@query(anomalies_sql("product_code, usage_account_id", str(REFERENCE), str(REFERENCE), EVENT_DAYS))
def detect_anomalies(spark, sf):
    rows = tables.summary_rows(
        spark, sf, ["product_code", "usage_account_id"], EVENT_START, REFERENCE
    )
    return anomalies.detect_anomalies(
        rows,
        reference_date=REFERENCE,
        days=EVENT_DAYS,
        group_by=["product_code", "usage_account_id"],
    )


@query(anomalies_sql("product_code", *SCAN))
def scan_anomalies(spark, sf):
    return scanned(spark, sf)


def scanned(spark, sf, by="product_code"):
    """Anomalies by one dimension over every day of both sources."""
    return anomalies.scan_anomalies(tables.summary_rows(spark, sf, [by]), *WHOLE, group_by=by)


def requests(spark, sf):
    """What the scan by product found, and every event product, day and account.

    Stored, as findings are before anyone asks for their explanation.
    """
    found = scanned(spark, sf).select(
        F.col("group_value").alias("service"),
        F.col("usage_date").alias("anomaly_date"),
        F.lit(None).cast("string").alias("account_id"),
    )
    accounts = tables.api_rows(spark, sf).select(
        F.col("product_code").alias("service"),
        F.col("usage_date").alias("anomaly_date"),
        F.col("usage_account_id").alias("account_id"),
    )
    return stored(found.unionByName(accounts.distinct()))


_REQUESTS = f"""requests AS (
  SELECT DISTINCT group_value AS service, CAST(usage_date AS DATE) AS anomaly_date,
         CAST(NULL AS VARCHAR) AS account_id
  FROM ({anomalies_sql("product_code", *SCAN)})
  UNION ALL
  SELECT DISTINCT product_code, usage_date, usage_account_id FROM api_rows)"""
_EXPLAINED = f"""WITH {_REQUESTS},
costs AS (
  SELECT service, anomaly_date, account_id, usage_date, SUM(total_net_amortized_cost) AS cost
  FROM requests JOIN summary ON product_code = service
   AND (account_id IS NULL OR usage_account_id = account_id)
   AND usage_date BETWEEN anomaly_date - 14 AND anomaly_date + 7
  GROUP BY ALL),
stats AS (
  SELECT service, anomaly_date, account_id,
         max(cost) FILTER (WHERE usage_date = anomaly_date) AS actual,
         list(cost) FILTER (WHERE usage_date < anomaly_date) AS base,
         coalesce(list(cost) FILTER (WHERE usage_date > anomaly_date), []) AS later
  FROM costs GROUP BY ALL),
based AS (
  SELECT *, base IS NOT NULL AS has_baseline, coalesce(base, [actual]) AS b
  FROM stats WHERE actual IS NOT NULL),
shown AS (
  SELECT *, {rounded("(list_sort(b)[(len(b) + 1) // 2] + list_sort(b)[len(b) // 2 + 1]) / 2", 2)}
           AS baseline_median,
         {rounded("list_min(b)", 2)} AS baseline_min, {rounded("list_max(b)", 2)} AS baseline_max,
         {rounded("actual", 2)} AS anomaly_cost
  FROM based),
explained AS (
  SELECT *, len(list_filter(later, lambda c: c > baseline_median * 1.5)) AS elevated FROM shown)"""


@query(
    f"""{_EXPLAINED}
SELECT service, CAST(anomaly_date AS VARCHAR) AS anomaly_date, account_id,
       baseline_median, baseline_min, baseline_max, anomaly_cost,
       {rounded("anomaly_cost - baseline_median", 2)} AS cost_vs_median,
       CASE WHEN baseline_median <> 0
            THEN {rounded("anomaly_cost / baseline_median", 1)} ELSE 0.0 END AS cost_multiple,
       elevated > 0 AS is_ongoing, CAST(len(later) AS BIGINT) AS days_after_checked,
       CAST(elevated AS BIGINT) AS elevated_days_after,
       has_baseline, CAST(len(b) AS BIGINT) AS baseline_days_used
FROM explained"""
)
def explain_anomaly(spark, sf):
    rows = tables.summary_rows(spark, sf, ["product_code", "usage_account_id"])
    return explanation.explain_costs(rows, requests(spark, sf))


BASELINE_SQL = f"""{_EXPLAINED},
base_side AS (
  SELECT service, anomaly_date, account_id, usage_type,
         SUM(net_unblended_cost) / len(any_value(b)) AS cost
  FROM explained JOIN line_items ON product_code = service
   AND (account_id IS NULL OR usage_account_id = account_id)
   AND usage_date BETWEEN anomaly_date - 14 AND anomaly_date - 1
  GROUP BY ALL),
day_side AS (
  SELECT service, anomaly_date, account_id, usage_type, SUM(net_unblended_cost) AS cost
  FROM explained JOIN line_items ON product_code = service
   AND (account_id IS NULL OR usage_account_id = account_id)
   AND usage_date = anomaly_date
  GROUP BY ALL),
sides AS (
  SELECT COALESCE(x.service, y.service) AS service,
         COALESCE(x.anomaly_date, y.anomaly_date) AS anomaly_date,
         COALESCE(x.account_id, y.account_id) AS account_id,
         COALESCE(x.usage_type, y.usage_type) AS usage_type,
         COALESCE(x.cost, 0) AS a_cost, COALESCE(y.cost, 0) AS b_cost
  FROM base_side AS x FULL OUTER JOIN day_side AS y
    ON x.service = y.service AND x.anomaly_date = y.anomaly_date
   AND x.account_id IS NOT DISTINCT FROM y.account_id AND x.usage_type = y.usage_type),
changes AS (
  SELECT sides.*, {_CHANGE} FROM sides
  WHERE (service, anomaly_date) IN (SELECT (service, anomaly_date) FROM day_side)),
ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY service, anomaly_date, account_id
    ORDER BY abs(absolute_change) DESC, usage_type) AS rank FROM changes)
SELECT service, CAST(anomaly_date AS VARCHAR) AS anomaly_date, account_id, rank, usage_type,
       a_cost AS baseline_cost, b_cost AS anomaly_cost, absolute_change, pct_change
FROM ranked WHERE rank <= 10"""


def usage_type_changes(spark, sf):
    rows = tables.summary_rows(spark, sf, ["product_code", "usage_account_id"])
    explained = stored(explanation.explain_costs(rows, requests(spark, sf)))
    detail = tables.line_items(
        spark,
        sf,
        ["usage_start_date", "product_code", "usage_account_id", "usage_type",
         "net_unblended_cost"],
    )
    return explanation.explain_usage_types(detail, explained)


@query(
    "SELECT * FROM export_summary",
    text=("usage_date",),
)
def summary_rebuild(spark, sf):
    return summary_ops.summarize_line_items(
        tables.line_items(
            spark,
            sf,
            ["usage_start_date", "line_item_type", "usage_account_id", "product_code", "region",
             "unblended_cost", "blended_cost", "net_unblended_cost", "usage_amount"],
        )
    )
