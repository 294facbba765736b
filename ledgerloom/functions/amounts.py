"""Arithmetic on costs and its presentation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def coalesce_zero(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0.0))


def pct_change(change: Column, base: Column) -> Column:
    """Change in percent of the base, NULL when the base is zero."""
    return F.try_divide(change, base) * 100


def pct_of_total(cost: Column, total: Column) -> Column:
    """Share of the total in percent, 0.0 when there is no total."""
    return F.when(coalesce_zero(total) != 0, cost / total * 100).otherwise(F.lit(0.0))


def display_round(amount: Column, digits: int) -> Column:
    """Round for display: the exact binary value, halves to even.

    ``round`` works on the shortest decimal text of a double, so 2.675 becomes
    2.68 although the stored value lies below 2.675. The number formatter looks
    at the stored value, as ordinary spreadsheet and script tooling does.
    """
    pattern = "0." + "0" * digits if digits else "0"
    finite = F.abs(amount) < float("inf")
    text = F.call_function("format_number", F.when(finite, amount), F.lit(pattern))
    return F.when(finite, text.cast("double")).otherwise(amount)


def money_text(amount: Column) -> Column:
    """``$1,234.50``; an em dash for NULL."""
    return F.when(amount.isNull(), F.lit("—")).otherwise(
        F.concat(F.lit("$"), F.format_number(amount, 2))
    )


def pct_text(value: Column) -> Column:
    """``+12.3%``; an em dash for NULL."""
    return F.when(value.isNull(), F.lit("—")).otherwise(
        F.concat(
            F.when(value > 0, F.lit("+")).otherwise(F.lit("")),
            F.call_function("format_number", value, F.lit("0.0")),
            F.lit("%"),
        )
    )


def change_text(subject: Column | str, before: Column, after: Column) -> Column:
    """One sentence on a change of cost: both amounts, difference and percent."""
    subject = F.lit(subject) if isinstance(subject, str) else subject
    change = after - before
    percent = pct_change(change, before)
    return F.concat(
        subject,
        F.lit(" cost changed from "),
        money_text(before),
        F.lit(" to "),
        money_text(after),
        F.lit(" ("),
        F.when(change >= 0, F.lit("+")).otherwise(F.lit("")),
        money_text(change),
        F.when(percent.isNull(), F.lit("")).otherwise(
            F.concat(
                F.lit(", "),
                F.when(percent >= 0, F.lit("+")).otherwise(F.lit("")),
                F.call_function("format_number", percent, F.lit("0.0")),
                F.lit("%"),
            )
        ),
        F.lit(")."),
    )
