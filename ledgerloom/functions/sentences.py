"""One-sentence summaries of results, as columns.

The wording and number formats are fixed values that readers of the results know.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from ledgerloom.functions.amounts import change_text, money_text


def _words(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def trend_sentence(start: date, end: date, granularity: str) -> Column:
    """Over a row of `trend_statistics`."""
    return _words(
        f"Cost trend from {start} to {end} ({granularity}): total ",
        money_text(F.col("total")),
        ", avg ",
        money_text(F.col("average")),
        "/period, range ",
        money_text(F.col("min_cost")),
        "–",
        money_text(F.col("max_cost")),
        ".",
    )


def drill_down_sentence(
    service: str, start: date, end: date, total: Column, top_usage_type: Column
) -> Column:
    return _words(
        money_text(total),
        f" total for {service} ({start} to {end}). Top usage type: ",
        F.coalesce(top_usage_type, F.lit("N/A")),
        ".",
    )


def attribution_sentence(
    service: str, before: Column, after: Column, changed: Column, new: Column, gone: Column
) -> Column:
    return _words(
        change_text(service, before, after),
        " ",
        changed,
        " changed, ",
        new,
        " new, ",
        gone,
        " disappeared usage types.",
    )


def detection_sentence(count: Column, days: int, sensitivity: str) -> Column:
    return _words(
        count, f" anomalies detected over the last {days} days (sensitivity={sensitivity})."
    )


def scan_sentence(count: Column, start: date, end: date) -> Column:
    scanned = (end - start).days + 1
    return _words(count, f" anomalies found scanning {start} to {end} ({scanned} days).")


def explanation_sentence() -> Column:
    """Over a row of `explain_costs`."""
    checked = F.col("days_after_checked")
    afterwards = (
        F.when(
            F.col("is_ongoing"),
            _words(
                " Costs remained elevated for ",
                F.col("elevated_days_after"),
                " of ",
                checked,
                " days after.",
            ),
        )
        .when(checked > 0, _words(" Costs returned to normal within ", checked, " days."))
        .otherwise("")
    )
    return _words(
        F.col("service"),
        " cost on ",
        F.col("anomaly_date"),
        " was ",
        money_text(F.col("anomaly_cost")),
        ", which is ",
        F.call_function("format_number", F.col("cost_multiple"), F.lit("0.0")),
        "x the baseline median of ",
        money_text(F.col("baseline_median")),
        " (+",
        money_text(F.col("cost_vs_median")),
        ").",
        afterwards,
    )
