"""The billing model over the sample tables as SQL common table expressions."""

from __future__ import annotations

import re


def grid(amount: str) -> str:
    return f"FLOOR(({amount}) * 64 + 0.5) / 64"


def median_of(values: str) -> str:
    """Median of a list: the mean of the two middle values when the count is even."""
    ordered = f"list_sort({values})"
    return (
        f"(({ordered})[(len({values}) + 1) // 2] + ({ordered})[len({values}) // 2 + 1]) / 2"
    )


def rounded(amount: str, digits: int) -> str:
    return f"CAST(format('{{:.{digits}f}}', {amount}) AS DOUBLE)"


_MODEL = {
    "line_items": f"""
SELECT l_orderkey || '-' || l_linenumber AS line_item_id,
       l_shipdate AS usage_start_date,
       l_shipdate + INTERVAL 1 DAY AS usage_end_date,
       CAST(l_shipdate AS DATE) AS usage_date,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS billing_period_start,
       CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) AS billing_period_end,
       strftime(date_trunc('month', l_shipdate), '%Y%m%d') || '-'
         || strftime(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH, '%Y%m%d')
         AS billing_period,
       n_name AS usage_account_id, p_type AS product_code, r_name AS region,
       p_brand AS usage_type, l_linestatus AS operation,
       CASE WHEN l_returnflag <> 'R' THEN 'part-' || l_partkey END AS resource_id,
       CASE WHEN l_returnflag = 'R' THEN 'Refund' ELSE 'Usage' END AS line_item_type,
       {grid("l_extendedprice")} AS unblended_cost,
       {grid("l_extendedprice * (1 - l_discount)")} AS blended_cost,
       {grid("l_extendedprice * (1 - l_discount) * (1 + l_tax)")} AS net_unblended_cost,
       l_quantity AS usage_amount,
       CASE WHEN l_linestatus = 'F' THEN 'AWS Marketplace' ELSE 'AWS' END AS billing_entity
FROM lineitem
LEFT JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey""",
    "api_rows": f"""
SELECT CAST(ts AS DATE) AS usage_date, CAST(user_id % 5 AS VARCHAR) AS usage_account_id,
       event_type AS product_code, {grid("value")} AS cost
FROM events""",
    "api_cells": """
SELECT usage_date, usage_account_id, product_code, SUM(cost) AS cost
FROM api_rows GROUP BY ALL""",
    "export_summary": """
SELECT usage_date, usage_account_id, product_code, region,
       SUM(unblended_cost) AS total_unblended_cost, SUM(blended_cost) AS total_blended_cost,
       SUM(net_unblended_cost) AS total_net_amortized_cost,
       SUM(usage_amount) AS total_usage_amount,
       COUNT(*) AS line_item_count, 'cur' AS data_source
FROM line_items
WHERE line_item_type NOT IN ('Tax', 'Fee', 'Credit', 'Refund', 'BundledDiscount')
GROUP BY usage_date, usage_account_id, product_code, region""",
    "summary": """
SELECT * FROM export_summary
UNION ALL
SELECT usage_date, usage_account_id, product_code, '', cost, cost, cost, 0.0, 0, 'cost_explorer'
FROM api_cells""",
    "daily_product": """
SELECT product_code, usage_date, SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY product_code, usage_date""",
}


def with_model(sql: str) -> str:
    """``sql`` with the model's tables it mentions, and theirs, in front."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name, body in _MODEL.items():
            if name not in wanted and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(body)
                wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    parts = ",\n".join(f"{name} AS ({_MODEL[name]}\n)" for name in wanted)
    body = sql.lstrip()
    return f"WITH {parts},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {parts}\n{sql}"


def anomalies_sql(
    keys: str, start: str, end: str, days: int = 14, threshold: float = 2.5, *, streaks: bool = True
) -> str:
    """Anomalies of every day from start to end, by a self-join over positions."""
    label = keys.replace(", ", "+")
    shown = [f"CASE {key} WHEN '' THEN 'unknown' ELSE {key} END" for key in keys.split(", ")]
    value = " || ' / ' || ".join(shown)
    return f"""WITH daily AS (
  SELECT {keys}, usage_date, SUM(total_net_amortized_cost) AS cost FROM summary
  WHERE usage_date BETWEEN DATE '{start}' - {days} AND DATE '{end}' GROUP BY ALL),
refs AS (
  SELECT DISTINCT {keys}, CAST(usage_date + CAST(o AS INTEGER) AS DATE) AS ref_date
  FROM daily, range(0, {days + 1}) AS t(o)
  WHERE CAST(usage_date + CAST(o AS INTEGER) AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'),
positions AS (
  SELECT {keys}, ref_date, d.day AS usage_date, cost,
         row_number() OVER (PARTITION BY {keys}, ref_date ORDER BY d.day) AS pos
  FROM refs JOIN (SELECT {keys}, usage_date AS day, cost FROM daily) AS d USING ({keys})
  WHERE d.day BETWEEN ref_date - {days} AND ref_date),
windows AS (
  SELECT {keys}, ref_date, max(usage_date) AS usage_date,
         list(cost ORDER BY usage_date) AS costs, count(*) AS n
  FROM positions GROUP BY ALL HAVING count(*) >= 3),
slopes AS (
  SELECT {keys}, ref_date, list((b.cost - a.cost) / (b.pos - a.pos)) AS slopes
  FROM positions AS a JOIN positions AS b USING ({keys}, ref_date)
  WHERE b.pos > a.pos GROUP BY ALL),
judged AS (
  SELECT *, costs[n] AS current_cost, costs[1:n - 1] AS baseline FROM windows
  WHERE costs[n] >= 1.0),
centred AS (SELECT *, {median_of("baseline")} AS median_cost FROM judged),
spread AS (
  SELECT *, list_transform(baseline, lambda x: abs(x - median_cost)) AS deviations FROM centred),
measured AS (SELECT *, {median_of("deviations")} AS mad FROM spread),
scored AS (
  SELECT m.*,
         CASE WHEN mad >= 1e-10 THEN 0.6745 * (current_cost - median_cost) / mad
              WHEN abs(current_cost - median_cost) <= 1.0 THEN 0.0
              WHEN current_cost > median_cost THEN 10.0 ELSE -10.0 END AS z,
         CASE WHEN n >= 5 AND median_cost > 1.0
              THEN {median_of("slopes")} * n / median_cost END AS drift
  FROM measured AS m JOIN slopes USING ({keys}, ref_date)),
flagged AS (
  SELECT *, 'point' AS kind, z AS z_score,
         CASE WHEN abs(z) > 4 THEN 'critical' WHEN abs(z) > 3 THEN 'warning' ELSE 'info' END
           AS severity,
         CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS direction
  FROM scored WHERE abs(z) >= {threshold}
  UNION ALL
  SELECT *, 'trend', drift,
         CASE WHEN abs(drift) > 1.0 THEN 'critical' WHEN abs(drift) > 0.5 THEN 'warning'
              ELSE 'info' END,
         CASE WHEN drift > 0 THEN 'drift_up' ELSE 'drift_down' END
  FROM scored WHERE abs(drift) >= 0.2),
runs AS (
  SELECT *, ref_date - CAST(row_number() OVER (
           PARTITION BY {keys}, kind ORDER BY ref_date) AS INTEGER) AS run
  FROM flagged),
placed AS (
  SELECT *, row_number() OVER (
           PARTITION BY {keys}, kind, run ORDER BY abs(z_score) DESC, ref_date) AS place
  FROM runs)
SELECT CAST(usage_date AS VARCHAR) AS usage_date, '{label}' AS group_by, {value} AS group_value,
       current_cost, median_cost, mad, z_score, severity, direction, kind
FROM placed {"WHERE place = 1" if streaks else ""}"""
