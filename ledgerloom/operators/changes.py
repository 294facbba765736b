"""Cost of keys in two periods, side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions.amounts import coalesce_zero, pct_change
from ledgerloom.operators.totals import rank_within


def two_sided_costs(
    rows: DataFrame,
    keys: Sequence[str],
    in_a: Column,
    in_b: Column,
    cost: Column,
    *,
    null_safe: bool = False,
) -> DataFrame:
    """(keys…, side, a_cost, b_cost, b_rows): the full outer join of two grouped sums.

    Both sides come out of one scan and one shuffle as conditional sums, so no
    join is run. The last key is the join key. As in an equi-join, a NULL key
    matches nothing: where both sides have one it appears once per side, told
    apart by ``side``, unless ``null_safe``. A missing side or an all-NULL sum
    costs 0; ``b_rows`` tells a missing b side from one that costs 0.
    """
    sums = (
        rows.filter(in_a | in_b)
        .groupBy(*keys)
        .agg(
            coalesce_zero(F.sum(F.when(in_a, cost))).alias("a_cost"),
            coalesce_zero(F.sum(F.when(in_b, cost))).alias("b_cost"),
            F.count(F.when(in_a, 1)).alias("a_rows"),
            F.count(F.when(in_b, 1)).alias("b_rows"),
        )
    )
    if null_safe:
        return sums.select(*keys, F.lit("both").alias("side"), "a_cost", "b_cost", "b_rows")
    apart = F.col(keys[-1]).isNull() & (F.col("a_rows") > 0) & (F.col("b_rows") > 0)

    def row(side: str, a: Column, b: Column, n: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), a.alias("a_cost"), b.alias("b_cost"), n.alias("b_rows")
        )

    a, b, n = F.col("a_cost"), F.col("b_cost"), F.col("b_rows")
    zero, none = F.lit(0.0), F.lit(0).cast("long")
    return sums.select(
        *keys,
        F.inline(
            F.when(
                apart, F.array(row("a", a, zero, none), row("b", zero, b, n))
            ).otherwise(F.array(row("both", a, b, n)))
        ),
    )


def with_changes(costs: DataFrame) -> DataFrame:
    """Adds category, absolute_change and pct_change. Categories go by value, not presence."""
    change = F.col("b_cost") - F.col("a_cost")
    return costs.withColumns(
        {
            "category": F.when(F.col("a_cost") == 0, "new")
            .when(F.col("b_cost") == 0, "disappeared")
            .otherwise("mover"),
            "absolute_change": change,
            "pct_change": pct_change(change, F.col("a_cost")),
        }
    )


def largest_changes(
    changes: DataFrame, partition: Sequence[Column | str], key: str, n: int
) -> DataFrame:
    """The n rows of greatest absolute change per partition, ties by key."""
    order = [F.abs("absolute_change").desc(), F.col(key).asc_nulls_last(), F.col("b_cost")]
    return rank_within(changes, partition, order, n)


def change_totals(costs: DataFrame) -> DataFrame:
    """One row: totals of both sides, their difference, and it in percent."""
    totals = costs.agg(
        coalesce_zero(F.sum("a_cost")).alias("a_total"),
        coalesce_zero(F.sum("b_cost")).alias("b_total"),
    )
    change = F.col("b_total") - F.col("a_total")
    return totals.select(
        "a_total",
        "b_total",
        change.alias("absolute_change"),
        pct_change(change, F.col("a_total")).alias("pct_change"),
    )
