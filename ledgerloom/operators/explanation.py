"""Anomalies explained: baseline, size, whether they go on, and what drove them."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerloom.checks import positive, require_rows
from ledgerloom.fixed_values import DAYS_AFTER, ELEVATED_FACTOR, TOP_USAGE_TYPES
from ledgerloom.functions.amounts import display_round
from ledgerloom.functions.dates import to_day
from ledgerloom.functions.labels import unknown_label
from ledgerloom.model import LINE_MEASURE, SUMMARY_MEASURE
from ledgerloom.operators.changes import largest_changes, two_sided_costs, with_changes
from ledgerloom.operators.filters import (
    for_account,
    for_service,
    from_source,
    in_range,
    in_usage_days,
)

_REQUEST = ("service", "anomaly_date", "account_id")


def _requests(requests: DataFrame) -> DataFrame:
    """Distinct requests; an empty account means all accounts, like none."""
    account = F.col("account_id")
    return requests.select(
        "service",
        F.col("anomaly_date").cast("date").alias("anomaly_date"),
        F.when(account != "", account).alias("account_id"),
    ).distinct()


def _wanted_days(requests: DataFrame, before: int, after: int) -> DataFrame:
    """One row per request and day it looks at, so that days can be matched by equality."""
    day = F.col("anomaly_date")
    return requests.withColumn(
        "usage_date", F.explode(F.sequence(F.date_sub(day, before), F.date_add(day, after)))
    )


def _matched(rows: DataFrame, wanted: DataFrame, extra: list[str], measure: str) -> DataFrame:
    """Wanted days beside their cost per ``extra``, in the scope each request asks for.

    Costs are added up once, per account; those of all accounts are sums of these sums, so
    line items are scanned once whatever scopes are asked for. Days nobody asks
    about are dropped during the scan; the list of days is as long as a calendar
    at most, so it may be broadcast. What is left is added up before anything is
    shuffled: a service with most of the rows sends few.
    """
    costs = rows.withColumnsRenamed(
        {"product_code": "service", "usage_account_id": "account_id"}
    )
    days = F.broadcast(wanted.select("usage_date").distinct())
    per_account = (
        costs.join(days, "usage_date", "left_semi")
        .groupBy("service", "usage_date", "account_id", *extra)
        .agg(F.sum(measure).alias("cost"))
    )
    in_all = per_account.groupBy("service", "usage_date", *extra).agg(F.sum("cost").alias("cost"))
    for_all = wanted.filter(F.col("account_id").isNull())
    for_one = wanted.filter(F.col("account_id").isNotNull())
    return for_all.join(in_all, ["service", "usage_date"]).unionByName(
        for_one.join(per_account, ["service", "usage_date", "account_id"])
    )


def explain_costs(
    summary: DataFrame,
    requests: DataFrame,
    *,
    baseline_days: int = 14,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """One row per request (service, anomaly_date, account_id) whose day has a cost.

    ``requests`` is used more than once: give a stored table, not a long plan.

    The baseline is the ``baseline_days`` days before; without any, the anomaly
    day stands in and ``has_baseline`` is false. Costs are rounded here, because
    the difference, the multiple and the elevated days are defined on rounded
    values.
    """
    positive(baseline_days, "baseline_days")
    wanted = _wanted_days(_requests(requests), baseline_days, DAYS_AFTER)
    day, on, cost = F.col("usage_date"), F.col("anomaly_date"), F.col("cost")
    before = F.when(day < on, cost)
    per_request = (
        _matched(summary, wanted, [], measure)
        .filter(F.col("cost").isNotNull())
        .groupBy(*_REQUEST)
        .agg(
            F.max(F.when(day == on, cost)).alias("actual"),
            F.median(before).alias("median"),
            F.min(before).alias("least"),
            F.max(before).alias("greatest"),
            F.count(before).alias("baseline_count"),
            # at most one entry per day after
            F.collect_list(F.when(day > on, cost)).alias("after"),
        )
        .filter(F.col("actual").isNotNull())
    )

    def or_actual(name: str) -> Column:
        return display_round(F.coalesce(F.col(name), F.col("actual")), 2)

    rounded = per_request.select(
        *_REQUEST,
        or_actual("median").alias("baseline_median"),
        or_actual("least").alias("baseline_min"),
        or_actual("greatest").alias("baseline_max"),
        display_round(F.col("actual"), 2).alias("anomaly_cost"),
        "baseline_count",
        "after",
    )
    median, anomaly = F.col("baseline_median"), F.col("anomaly_cost")
    elevated = F.size(F.filter("after", lambda c: c > median * ELEVATED_FACTOR))
    return rounded.select(
        *_REQUEST,
        "baseline_median",
        "baseline_min",
        "baseline_max",
        "anomaly_cost",
        display_round(anomaly - median, 2).alias("cost_vs_median"),
        F.when(median != 0, display_round(anomaly / median, 1)).otherwise(0.0).alias("cost_multiple"),
        (elevated > 0).alias("is_ongoing"),
        F.size("after").alias("days_after_checked"),
        elevated.alias("elevated_days_after"),
        (F.col("baseline_count") > 0).alias("has_baseline"),
        F.greatest(F.col("baseline_count"), F.lit(1)).alias("baseline_days_used"),
    )


def explain_usage_types(
    line_items: DataFrame,
    explained: DataFrame,
    *,
    baseline_days: int = 14,
    top_n: int = TOP_USAGE_TYPES,
    measure: str = LINE_MEASURE,
) -> DataFrame:
    """The usage types that changed most for each row of `explain_costs`.

    ``explained`` is used more than once: give a stored table, not a long plan.

    Baseline cost is the sum over the baseline days divided by the number of
    baseline days the summary has. Requests whose anomaly day has no line item
    yield nothing.
    """
    request = [*_REQUEST, "baseline_days_used"]
    wanted = _wanted_days(explained.select(*request), baseline_days, 0)
    rows = line_items.withColumn("usage_date", to_day(F.col("usage_start_date")))
    matched = _matched(rows, wanted, ["usage_type"], measure)
    on_day = F.col("usage_date") == F.col("anomaly_date")
    sides = two_sided_costs(
        matched, [*request, "usage_type"], ~on_day, on_day, F.col("cost")
    )
    detailed = F.max("b_rows").over(Window.partitionBy(*_REQUEST)) > 0
    covered = sides.withColumn("detailed", detailed).filter("detailed")
    averaged = covered.withColumn("a_cost", F.col("a_cost") / F.col("baseline_days_used"))
    ranked = largest_changes(with_changes(averaged), list(_REQUEST), "usage_type", top_n)
    return ranked.select(
        *_REQUEST,
        "rank",
        unknown_label(F.col("usage_type")).alias("usage_type"),
        F.col("a_cost").alias("baseline_cost"),
        F.col("b_cost").alias("anomaly_cost"),
        "absolute_change",
        "pct_change",
    )


def explain_anomalies(
    summary: DataFrame,
    line_items: DataFrame,
    requests: DataFrame,
    *,
    baseline_days: int = 14,
    top_n: int = TOP_USAGE_TYPES,
) -> DataFrame:
    """`explain_costs` with ``has_cur_data`` and ``top_usage_type_changes`` beside each row."""
    explained = explain_costs(summary, requests, baseline_days=baseline_days)
    changes = (
        explain_usage_types(line_items, explained, baseline_days=baseline_days, top_n=top_n)
        .groupBy(*_REQUEST)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "rank",
                        "usage_type",
                        "baseline_cost",
                        "anomaly_cost",
                        "absolute_change",
                        "pct_change",
                    )
                )
            ).alias("top_usage_type_changes")
        )
    )
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in _REQUEST]
    return (
        explained.alias("e")
        .join(changes.alias("c"), same, "left")
        .select(
            "e.*",
            F.col("c.top_usage_type_changes").isNotNull().alias("has_cur_data"),
            F.coalesce("c.top_usage_type_changes", F.array()).alias("top_usage_type_changes"),
        )
        .drop("baseline_days_used")
    )


def explain_anomaly(
    summary: DataFrame,
    line_items: DataFrame,
    service: str,
    anomaly_date: date,
    *,
    account_id: str | None = None,
    baseline_days: int = 14,
    data_source: str | None = None,
    strict: bool = False,
    top_n: int = TOP_USAGE_TYPES,
) -> DataFrame:
    """`explain_anomalies` for one service and day, its scans narrowed beforehand.

    ``strict`` raises when the day has no cost.
    """
    start = anomaly_date - timedelta(days=baseline_days)
    end = anomaly_date + timedelta(days=DAYS_AFTER)
    costs = for_account(
        for_service(from_source(in_range(summary, start, end), data_source), service), account_id
    )
    detail = for_account(
        for_service(in_usage_days(line_items, start, anomaly_date), service), account_id
    )
    if strict:
        require_rows(
            costs.filter(F.col("usage_date") == F.lit(anomaly_date)),
            f"no cost of {service} on {anomaly_date}",
        )
    request = summary.sparkSession.range(1).select(
        F.lit(service).alias("service"),
        F.lit(anomaly_date).alias("anomaly_date"),
        F.lit(account_id).cast("string").alias("account_id"),
    )
    return explain_anomalies(costs, detail, request, baseline_days=baseline_days, top_n=top_n)
