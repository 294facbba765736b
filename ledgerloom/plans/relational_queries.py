"""Filters, joins, aggregates, windows, orderings and set operations."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Window, functions as F

from ledgerloom import checks
from ledgerloom.functions import robust
from ledgerloom.functions.dates import instants_between, month_start
from ledgerloom.functions.labels import group_label, group_value
from ledgerloom.operators import (
    anomalies,
    attribution,
    changes,
    comparison,
    drilldown,
    filters,
    heavy_groups,
    ingestion,
    medians,
    totals,
    trends,
)
from ledgerloom.plans import composites, samples
from ledgerloom.plans.composites import two_sided_sql
from ledgerloom.plans.model_sql import anomalies_sql, median_of, rounded
from ledgerloom.plans.registry import query, stored
from ledgerloom.plans.samples import ACCOUNT, PERIOD_A, PERIOD_B, REFERENCE, SERVICE, WHOLE
from ledgerloom.sources import sample_tables as tables

_BY_PRODUCT = """SELECT product_code, SUM(total_net_amortized_cost) AS cost, MIN(usage_date) AS first_date
FROM summary"""
_DETAIL_BY_PRODUCT = """SELECT product_code, COUNT(*) AS line_items, SUM(net_unblended_cost) AS cost
FROM line_items"""


def _by_product(summary):
    return summary.groupBy("product_code").agg(
        F.sum("total_net_amortized_cost").alias("cost"), F.min("usage_date").alias("first_date")
    )


def _detail_by_product(line_items):
    return line_items.groupBy("product_code").agg(
        F.count("*").alias("line_items"), F.sum("net_unblended_cost").alias("cost")
    )


def _summary(spark, sf, *by):
    return tables.summary_rows(spark, sf, by)


# Filters


@query(
    f"{_BY_PRODUCT} WHERE usage_date BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}' GROUP BY 1",
    text=("first_date",),
)
def date_range_filter(spark, sf):
    return _by_product(filters.in_range(_summary(spark, sf, "product_code"), *PERIOD_A))


@query(
    f"{_BY_PRODUCT} WHERE usage_date >= DATE '{WHOLE[0]}' + 200 GROUP BY 1", text=("first_date",)
)
def lookback_filter(spark, sf):
    reference = WHOLE[0] + timedelta(days=214)
    return _by_product(filters.since(_summary(spark, sf, "product_code"), 14, reference))


@query(f"{_BY_PRODUCT} WHERE data_source = 'cost_explorer' GROUP BY 1", text=("first_date",))
def source_filter(spark, sf):
    tag = checks.source_tag("cost-explorer")
    return _by_product(filters.from_source(_summary(spark, sf, "product_code"), tag))


@query(f"{_BY_PRODUCT} WHERE product_code = '{SERVICE}' GROUP BY 1", text=("first_date",))
def service_filter(spark, sf):
    return _by_product(filters.for_service(_summary(spark, sf, "product_code"), SERVICE))


@query(f"{_BY_PRODUCT} WHERE usage_account_id = '{ACCOUNT}' GROUP BY 1", text=("first_date",))
def account_filter(spark, sf):
    rows = _summary(spark, sf, "product_code", "usage_account_id")
    return _by_product(filters.for_account(rows, ACCOUNT))


@query(f"{_BY_PRODUCT} WHERE region = 'ASIA' GROUP BY 1", text=("first_date",))
def group_value_filter(spark, sf):
    rows = _summary(spark, sf, "product_code", "region")
    return _by_product(filters.for_group_value(rows, "region", "ASIA"))


@query(
    f"""{_DETAIL_BY_PRODUCT}
WHERE line_item_type NOT IN ('Tax', 'Fee', 'Credit', 'Refund', 'BundledDiscount') GROUP BY 1"""
)
def type_exclusion(spark, sf):
    rows = tables.line_items(spark, sf, ["product_code", "line_item_type", "net_unblended_cost"])
    return _detail_by_product(filters.usage_only(rows))


@query(
    f"""{_DETAIL_BY_PRODUCT}
WHERE CAST(usage_start_date AS DATE) BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{PERIOD_B[1]}' GROUP BY 1"""
)
def day_cast_filter(spark, sf):
    rows = tables.line_items(spark, sf, ["product_code", "usage_start_date", "net_unblended_cost"])
    return _detail_by_product(filters.in_usage_days(rows, *PERIOD_B))


@query(f"{_DETAIL_BY_PRODUCT} WHERE resource_id IS NOT NULL AND resource_id <> '' GROUP BY 1")
def nonempty_resource(spark, sf):
    rows = tables.line_items(spark, sf, ["product_code", "resource_id", "net_unblended_cost"])
    return _detail_by_product(filters.with_resource(rows))


_IN_TOP = f"""WITH top AS (
  SELECT product_code FROM summary GROUP BY product_code
  ORDER BY SUM(total_net_amortized_cost) DESC, product_code LIMIT 4)
{_BY_PRODUCT} WHERE product_code IN (SELECT product_code FROM top) GROUP BY 1"""


def _in_top(spark, sf):
    rows = _summary(spark, sf, "product_code")
    return _by_product(filters.in_top(rows, totals.top_groups(rows, "product_code", 4), "product_code"))


@query(_IN_TOP, text=("first_date",))
def topn_membership(spark, sf):
    return _in_top(spark, sf)


@query(
    """SELECT 'product_code' AS dimension, COUNT(DISTINCT product_code) AS groups FROM summary
UNION ALL SELECT 'usage_account_id', COUNT(DISTINCT usage_account_id) FROM summary
UNION ALL SELECT 'region', COUNT(DISTINCT region) FROM summary"""
)
def dimension_whitelist(spark, sf):
    """Groups per column that may be grouped by; the others are refused."""
    allowed = []
    for name in ("product_code", "usage_account_id", "region", "resource_id", "data_source"):
        try:
            allowed += checks.dimensions(name)
        except ValueError:
            continue
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in allowed]
    return (
        _summary(spark, sf, *allowed)
        .select(F.inline(F.array(*pairs)))
        .groupBy("dimension")
        .agg(F.countDistinct("value").alias("groups"))
    )


@query(
    """SELECT 'daily' AS granularity, COUNT(DISTINCT usage_date) AS points FROM summary
UNION ALL SELECT 'weekly', COUNT(DISTINCT date_trunc('week', usage_date)) FROM summary
UNION ALL SELECT 'monthly', COUNT(DISTINCT date_trunc('month', usage_date)) FROM summary"""
)
def param_checks(spark, sf):
    """Points of a trend per accepted granularity; others, and reversed ranges, are refused."""
    rows, counted = _summary(spark, sf), []
    for name in ("daily", "weekly", "monthly", "hourly"):
        for span in (WHOLE, WHOLE[::-1]):
            try:
                points = trends.cost_trend(rows, *span, granularity=name)
            except ValueError:
                continue
            counted.append(points.agg(F.lit(name).alias("granularity"), F.count("*").alias("points")))
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(f"SELECT COUNT(*) AS line_items FROM line_items WHERE product_code = '{SERVICE}'")
def no_data_check(spark, sf):
    """Line items of a service that must have some; one without any is refused."""
    rows = tables.line_items(spark, sf, ["product_code"])
    try:
        checks.require_rows(filters.for_service(rows, "no such service"), "no line items")
    except ValueError:
        found = checks.require_rows(filters.for_service(rows, SERVICE), "no line items")
    return found.agg(F.count("*").alias("line_items"))


# Joins


@query(
    f"""SELECT COALESCE(a.k, b.k) AS group_value, COALESCE(a.cost, 0) AS a_cost,
       COALESCE(b.cost, 0) AS b_cost
FROM (SELECT region AS k, SUM(total_net_amortized_cost) AS cost FROM summary
      WHERE usage_date BETWEEN DATE '{PERIOD_A[0]}' AND DATE '{PERIOD_A[1]}' GROUP BY 1) AS a
FULL OUTER JOIN
     (SELECT region AS k, SUM(total_net_amortized_cost) AS cost FROM summary
      WHERE usage_date BETWEEN DATE '{PERIOD_B[0]}' AND DATE '{WHOLE[1]}' GROUP BY 1) AS b
  ON a.k = b.k"""
)
def join_full_outer_period(spark, sf):
    rows = _summary(spark, sf, "region")
    costs = comparison.period_costs(rows, PERIOD_A, (PERIOD_B[0], WHOLE[1]), group_by="region")
    return costs.select("group_value", "a_cost", "b_cost")


@query(f"{two_sided_sql('usage_type')} UNION ALL {two_sided_sql('resource_id')}")
def join_full_outer_lineitem(spark, sf):
    rows = tables.line_items(spark, sf, composites.DETAIL)
    costs = attribution.detail_period_costs(rows, SERVICE, PERIOD_A, PERIOD_B)
    return costs.select("dimension", "key", "a_cost", "b_cost")


@query(composites.BASELINE_SQL)
def join_full_outer_baseline(spark, sf):
    return composites.usage_type_changes(spark, sf)


@query(_IN_TOP, text=("first_date",))
def join_semi_topn(spark, sf):
    return _in_top(spark, sf)


# Aggregates


@query(
    """SELECT product_code, usage_account_id, region, SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY 1, 2, 3"""
)
def agg_sum_group(spark, sf):
    return totals.group_costs(_summary(spark, sf, *tables.DIMENSIONS), checks.SUMMARY_DIMENSIONS)


@query("SELECT COUNT(*) AS line_items FROM line_items")
def agg_count(spark, sf):
    return tables.line_items(spark, sf, ["line_item_type"]).agg(F.count("*").alias("line_items"))


@query(
    """SELECT MIN(usage_date) AS first_date, MAX(usage_date) AS last_date,
       COUNT(DISTINCT usage_account_id) AS accounts, COUNT(DISTINCT product_code) AS services,
       SUM(total_unblended_cost) AS total_cost FROM summary""",
    text=("first_date", "last_date"),
)
def agg_count_distinct(spark, sf):
    return totals.load_statistics(_summary(spark, sf, "usage_account_id", "product_code"))


@query(
    """SELECT MIN(t) AS min_daily, AVG(t) AS avg_daily, MAX(t) AS max_daily
FROM (SELECT SUM(total_unblended_cost) AS t FROM summary GROUP BY usage_date)"""
)
def agg_nested_stats(spark, sf):
    return totals.daily_total_statistics(_summary(spark, sf))


@query(
    """SELECT billing_period, line_item_type AS assembly_id FROM (
  SELECT billing_period, line_item_type, row_number() OVER (
    PARTITION BY billing_period ORDER BY MAX(usage_start_date) DESC, line_item_type DESC) AS place
  FROM line_items GROUP BY billing_period, line_item_type)
WHERE place = 1"""
)
def agg_max_by(spark, sf):
    log = samples.export_files(spark, sf).select(
        "billing_period",
        F.initcap(F.split_part("assembly_id", F.lit("-"), F.lit(2))).alias("assembly_id"),
        F.col("last_usage").alias("ingested_at"),
    )
    return ingestion.latest_assemblies(log)


_MONTHLY = """monthly AS (
  SELECT product_code, CAST(date_trunc('month', usage_date) AS DATE) AS month,
         list(cost ORDER BY usage_date) AS costs
  FROM daily_product GROUP BY 1, 2)"""


def _monthly(spark, sf):
    """Daily costs of each product and month as arrays, at most 31 long."""
    daily = totals.daily_costs(_summary(spark, sf, "product_code"), ["product_code"])
    point = F.struct("usage_date", "cost")
    return daily.groupBy("product_code", month_start(F.col("usage_date")).alias("month")).agg(
        F.sort_array(F.collect_list(point))["cost"].alias("costs"), F.median("cost").alias("exact")
    )


@query(
    f"WITH {_MONTHLY} SELECT product_code, month, {median_of('costs')} AS median_cost FROM monthly",
    text=("month",),
)
def agg_median(spark, sf):
    """Grouped exact median by the built-in aggregate."""
    return _monthly(spark, sf).select("product_code", "month", F.col("exact").alias("median_cost"))


@query(
    """SELECT product_code, COUNT(net_unblended_cost) AS n, median(net_unblended_cost) AS median_cost
FROM line_items WHERE net_unblended_cost IS NOT NULL GROUP BY product_code"""
)
def agg_median_line_items(spark, sf):
    """Exact median over line items, of which a group is never gathered."""
    rows = tables.line_items(spark, sf, ["product_code", "net_unblended_cost"])
    found = medians.exact_medians(rows, ["product_code"], "net_unblended_cost", stored)
    return found.withColumnRenamed("median", "median_cost")


@query(
    f"""WITH {_MONTHLY},
centred AS (SELECT *, {median_of("costs")} AS median_cost FROM monthly),
spread AS (SELECT *, list_transform(costs, lambda x: abs(x - median_cost)) AS d FROM centred)
SELECT product_code, month, median_cost, {median_of("d")} AS mad FROM spread""",
    text=("month",),
)
def agg_mad(spark, sf):
    centred = _monthly(spark, sf).withColumn("median_cost", F.expr(robust.median_of("costs")))
    mad = F.expr(robust.mad_of("costs", "median_cost"))
    return centred.select("product_code", "month", "median_cost", mad.alias("mad"))


@query(
    f"""WITH placed AS (
  SELECT product_code, CAST(date_trunc('month', usage_date) AS DATE) AS month, cost,
         row_number() OVER (
           PARTITION BY product_code, date_trunc('month', usage_date) ORDER BY usage_date) AS pos
  FROM daily_product),
slopes AS (
  SELECT product_code, month, list((b.cost - a.cost) / (b.pos - a.pos))
           FILTER (WHERE b.pos > a.pos) AS s
  FROM placed AS a JOIN placed AS b USING (product_code, month) GROUP BY ALL)
SELECT product_code, month, {median_of("s")} AS slope FROM slopes""",
    text=("month",),
)
def agg_theil_sen(spark, sf):
    slope = F.expr(robust.theil_sen("costs"))
    return _monthly(spark, sf).select("product_code", "month", slope.alias("slope"))


@query(
    f"""WITH points AS (
  SELECT {rounded("SUM(total_net_amortized_cost)", 2)} AS cost
  FROM summary GROUP BY date_trunc('month', usage_date), region)
SELECT {rounded("SUM(cost)", 2)} AS total,
       {rounded(rounded("SUM(cost)", 2) + " / COUNT(*)", 2)} AS average,
       MIN(cost) AS min_cost, MAX(cost) AS max_cost FROM points"""
)
def agg_series_stats(spark, sf):
    points = trends.cost_trend(
        _summary(spark, sf, "region"), *WHOLE, group_by="region", granularity="monthly"
    )
    return trends.trend_statistics(points)


@query(
    """WITH days AS (
  SELECT product_code, COUNT(DISTINCT usage_date) AS n FROM line_items GROUP BY 1)
SELECT product_code, usage_type, SUM(net_unblended_cost) / any_value(n) AS average
FROM line_items JOIN days USING (product_code) GROUP BY 1, 2"""
)
def agg_weighted_daily_avg(spark, sf):
    """Cost per usage type over the days its product has, zero days counted."""
    rows = tables.line_items(
        spark, sf, ["usage_start_date", "product_code", "usage_type", "net_unblended_cost"]
    )
    per_type = rows.groupBy("product_code", "usage_type").agg(
        F.sum("net_unblended_cost").alias("cost")
    )
    days = rows.groupBy("product_code").agg(
        F.countDistinct(F.to_date("usage_start_date")).alias("n")
    )
    return per_type.join(days, "product_code").select(
        "product_code", "usage_type", (F.col("cost") / F.col("n")).alias("average")
    )


@query("SELECT COALESCE(SUM(total_net_amortized_cost), 0.0) AS total_cost FROM summary")
def agg_grand_total(spark, sf):
    return totals.grand_total(_summary(spark, sf))


@query(
    """SELECT 'product_code+region' AS group_by,
       product_code || ' / ' || CASE region WHEN '' THEN 'unknown' ELSE region END AS group_value,
       SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY product_code, region"""
)
def agg_multi_dim(spark, sf):
    keys = checks.dimensions(checks.group_columns("service+region"))
    costs = totals.group_costs(_summary(spark, sf, *keys), keys)
    return costs.select(
        F.lit(group_label(keys)).alias("group_by"), group_value(keys).alias("group_value"), "cost"
    )


# Windows


@query(
    """SELECT usage_date, product_code AS group_value, cost AS total_cost,
       cost - LAG(cost) OVER w AS cost_change,
       CASE WHEN LAG(cost) OVER w > 0
            THEN (cost - LAG(cost) OVER w) / LAG(cost) OVER w * 100 END AS pct_change
FROM daily_product WINDOW w AS (PARTITION BY product_code ORDER BY usage_date)""",
    text=("usage_date",),
)
def win_lag_change(spark, sf):
    """Every group's change from its previous present day."""
    daily = totals.daily_costs(_summary(spark, sf, "product_code"), ["product_code"])
    before = F.lag("cost").over(Window.partitionBy("product_code").orderBy("usage_date"))
    change = F.col("cost") - before
    return daily.select(
        "usage_date",
        F.col("product_code").alias("group_value"),
        F.col("cost").alias("total_cost"),
        change.alias("cost_change"),
        F.when(before > 0, change / before * 100).alias("pct_change"),
    )


@query(
    f"""WITH series AS (
  SELECT product_code, list(cost ORDER BY usage_date) AS c, MAX(usage_date) AS usage_date
  FROM daily_product GROUP BY 1),
parts AS (SELECT *, c[len(c)] AS current_cost, c[1:len(c) - 1] AS base FROM series)
SELECT product_code, usage_date, current_cost, CAST(len(base) AS BIGINT) AS baseline_days,
       {median_of("base")} AS median_cost FROM parts""",
    text=("usage_date",),
)
def win_trailing_baseline(spark, sf):
    """Last present day beside the median of all days before it."""
    daily = totals.daily_costs(_summary(spark, sf, "product_code"), ["product_code"])
    last = F.max_by("cost", "usage_date").over(Window.partitionBy("product_code"))
    final = F.max("usage_date").over(Window.partitionBy("product_code"))
    marked = daily.select("*", last.alias("current_cost"), final.alias("last_date"))
    earlier = F.when(F.col("usage_date") < F.col("last_date"), F.col("cost"))
    return marked.groupBy(
        "product_code", F.col("last_date").alias("usage_date"), "current_cost"
    ).agg(F.count(earlier).alias("baseline_days"), F.median(earlier).alias("median_cost"))


@query(
    """WITH refs AS (
  SELECT DISTINCT region, CAST(usage_date + CAST(o AS INTEGER) AS DATE) AS ref_date
  FROM summary, range(0, 15) AS t(o)),
daily AS (
  SELECT region, usage_date, SUM(total_net_amortized_cost) AS cost FROM summary GROUP BY ALL)
SELECT region, ref_date, COUNT(*) AS days, SUM(cost) AS cost
FROM refs JOIN daily USING (region)
WHERE usage_date BETWEEN ref_date - 14 AND ref_date AND ref_date <= DATE '2024-02-15'
GROUP BY ALL""",
    text=("ref_date",),
)
def win_sliding_reference(spark, sf):
    windows = anomalies.sliding_windows(_summary(spark, sf, "region"), *WHOLE, group_by="region")
    total = F.aggregate("points", F.lit(0.0), lambda total, p: total + p["cost"])
    return windows.select(
        "region", "ref_date", F.size("points").alias("days"), total.alias("cost")
    )


@query(anomalies_sql("region", WHOLE[0].isoformat(), WHOLE[1].isoformat()))
def win_streak_dedup(spark, sf):
    return composites.scanned(spark, sf, "region")


@query(anomalies_sql("product_code", *composites.SCAN, 60, streaks=True))
def scan_long_windows(spark, sf):
    """Windows of sixty days, whose order statistics roll from day to day."""
    rows = _summary(spark, sf, "product_code")
    return anomalies.scan_anomalies(rows, *WHOLE, days=60)


# Orderings and top-n


@query(
    """SELECT usage_account_id, SUM(total_net_amortized_cost) AS total_cost
FROM summary GROUP BY 1 ORDER BY total_cost DESC, usage_account_id LIMIT 10"""
)
def topn_groups(spark, sf):
    return totals.top_groups(_summary(spark, sf, "usage_account_id"), "usage_account_id", 10)


@query(
    f"""SELECT dimension, rank, key, cost FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY cost DESC, key) AS rank FROM (
    SELECT 'usage_type' AS dimension, usage_type AS key, SUM(net_unblended_cost) AS cost
    FROM line_items WHERE product_code = '{SERVICE}' GROUP BY 2
    UNION ALL
    SELECT 'operation', operation, SUM(net_unblended_cost)
    FROM line_items WHERE product_code = '{SERVICE}' GROUP BY 2
    UNION ALL
    SELECT 'resource_id', resource_id, SUM(net_unblended_cost)
    FROM line_items WHERE product_code = '{SERVICE}' AND resource_id <> '' GROUP BY 2))
WHERE rank <= 5"""
)
def topn_breakdown(spark, sf):
    rows = tables.line_items(spark, sf, composites.DETAIL)
    broken_down = drilldown.drill_down(rows, SERVICE, *WHOLE, top_n=5)
    return broken_down.filter("dimension <> 'total'").select("dimension", "rank", "key", "cost")


@query(
    """SELECT product_code, rank, resource_id, total_cost FROM (
  SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY total_cost DESC, resource_id) AS rank FROM (
    SELECT product_code, resource_id, SUM(net_unblended_cost) AS total_cost
    FROM line_items WHERE resource_id <> '' GROUP BY 1, 2))
WHERE rank <= 10"""
)
def topn_resources(spark, sf):
    """The ten costliest resources of every service; resources whose bucket cannot hold one are not added up."""
    rows = tables.line_items(spark, sf, ["product_code", "resource_id", "net_unblended_cost"])
    named = filters.with_resource(rows)
    return heavy_groups.heaviest_keys(named, ["product_code"], "resource_id", 10, "net_unblended_cost", stored)


_SIDE = """SELECT product_code AS service, resource_id AS k, SUM(net_unblended_cost) AS cost
  FROM line_items WHERE usage_date"""
_RESOURCE_CHANGES = f"""changes AS (
  SELECT *, b_cost - a_cost AS absolute_change FROM (
    SELECT COALESCE(a.service, b.service) AS service, COALESCE(a.k, b.k) AS key,
           COALESCE(a.cost, 0) AS a_cost, COALESCE(b.cost, 0) AS b_cost
    FROM ({_SIDE} {composites._A} GROUP BY 1, 2) AS a
    FULL OUTER JOIN ({_SIDE} {composites._B} GROUP BY 1, 2) AS b ON a.service = b.service AND a.k = b.k))"""


def _resource_changes(spark, sf):
    """Changes of every resource of every service between the two periods."""
    rows = tables.line_items(spark, sf, ["usage_start_date", "product_code", "resource_id", "net_unblended_cost"])
    in_a, in_b = (instants_between("usage_start_date", *period) for period in (PERIOD_A, PERIOD_B))
    named = rows.filter(in_a | in_b).select(
        in_a.alias("in_a"), in_b.alias("in_b"), F.col("net_unblended_cost").alias("cost"),
        F.col("product_code").alias("service"), F.col("resource_id").alias("key"),
    )
    costs = changes.two_sided_costs(named, ["service", "key"], F.col("in_a"), F.col("in_b"), F.col("cost"))
    return changes.with_changes(costs)


@query(
    f"""WITH {_RESOURCE_CHANGES}
SELECT service, rank, key, a_cost, b_cost, absolute_change FROM (
  SELECT *, row_number() OVER (
    PARTITION BY service ORDER BY abs(absolute_change) DESC, key, b_cost) AS rank FROM changes)
WHERE rank <= 100"""
)
def sort_abs_change(spark, sf):
    """The hundred resources of greatest change of each service, whatever their category."""
    largest = changes.largest_changes(_resource_changes(spark, sf), ["service"], "key", 100)
    return largest.select("service", "rank", "key", "a_cost", "b_cost", "absolute_change")


@query(
    f"""WITH {_RESOURCE_CHANGES},
categories AS (
  SELECT *, CASE WHEN a_cost = 0 THEN 'new' WHEN b_cost = 0 THEN 'disappeared' ELSE 'mover' END
    AS category FROM changes)
SELECT service, category, rank, key, absolute_change FROM (
  SELECT *, row_number() OVER (
    PARTITION BY service, category ORDER BY abs(absolute_change) DESC, key, b_cost) AS rank FROM categories)
WHERE rank <= 25"""
)
def topn_per_category(spark, sf):
    largest = changes.largest_changes(_resource_changes(spark, sf), ["service", "category"], "key", 25)
    return largest.select("service", "category", "rank", "key", "absolute_change")


@query(
    f"""SELECT service, anomaly_date, account_id, COUNT(*) AS usage_types,
       MAX(abs(absolute_change)) AS largest_change
FROM ({composites.BASELINE_SQL}) GROUP BY ALL"""
)
def topn_fixed10(spark, sf):
    """How many usage types each explanation lists, at most ten."""
    return (
        composites.usage_type_changes(spark, sf)
        .groupBy("service", "anomaly_date", "account_id")
        .agg(
            F.count("*").alias("usage_types"),
            F.max(F.abs("absolute_change")).alias("largest_change"),
        )
    )


@query(anomalies_sql("product_code", *composites.SCAN))
def sort_severity(spark, sf):
    """Everything a scan of all days found, gravest first."""
    return anomalies.by_severity(composites.scanned(spark, sf))


@query(
    """SELECT CAST(date_trunc('month', usage_date) AS DATE) AS usage_date,
       product_code AS group_value, SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY 1, 2 ORDER BY 1, 2""",
    text=("usage_date",),
)
def sort_series(spark, sf):
    points = trends.cost_trend(
        _summary(spark, sf, "product_code"), *WHOLE, group_by="product_code", granularity="monthly"
    )
    return totals.by_date(points, "group_value")


# Set operations


@query(
    """SELECT data_source, COUNT(*) AS rows, SUM(total_net_amortized_cost) AS cost
FROM summary GROUP BY data_source"""
)
def union_sources(spark, sf):
    return (
        tables.daily_summary(spark, sf)
        .groupBy("data_source")
        .agg(F.count("*").alias("rows"), F.sum("total_net_amortized_cost").alias("cost"))
    )


@query(
    f"""SELECT group_value, usage_date, COUNT(*) AS kinds, MIN(kind) AS first_kind
FROM ({anomalies_sql("product_code", *composites.SCAN, 14, 2.0, streaks=False)})
GROUP BY 1, 2"""
)
def union_kinds(spark, sf):
    """Groups with the kinds of anomaly they show, up to two, over all days."""
    rows = _summary(spark, sf, "product_code")
    windows = anomalies.sliding_windows(rows, *WHOLE)
    found = anomalies.score_windows(windows, sensitivity="high")
    return found.groupBy(F.col("product_code").alias("group_value"), "usage_date").agg(
        F.count("*").alias("kinds"), F.min("kind").alias("first_kind")
    )
