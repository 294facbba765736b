"""The keys of greatest total within groups, without shuffling a row per key.

Where a group has very many keys, resources of a service above all, adding up each of them to keep a few sends a row
per key and task. Here keys are first thrown into buckets by hash. The positive amounts of a bucket, added up, are a
bound that no total of one of its keys exceeds. The buckets of greatest bounds are opened: their keys are added up
exactly, and the n-th best of them is a total that the result must reach. Only buckets whose bound reaches it as well are
opened then. What is shuffled before that is at most one row per bucket and task, whatever the number of keys.

The result is exact. Bounds only leave out keys that cannot be among the best; where costs are spread so evenly that most
buckets have to be opened, all keys are added up as a plain aggregate would.

NULL amounts count for nothing, a key of NULL amounts only comes after all others, NULL is a key and a group like any
other, NaN is the greatest total, and ties go to the smaller key, NULL last.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.checks import positive
from ledgerloom.operators.totals import rank_within

#: Buckets of a group. Sums are rounded, so bounds are taken a little larger.
BUCKETS, ROUNDING = 8192, 1e-6


def heaviest_keys(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    n: int,
    measure: str,
    store: Callable[[DataFrame], DataFrame],
    buckets: int = BUCKETS,
) -> DataFrame:
    """``by``, ``rank``, ``key`` and ``total_cost``: the n keys of greatest total of each group; of all rows without ``by``.

    ``store`` writes a table and reads it back: one row per group and bucket, then a few per group. Reads ``df`` up to
    three times.
    """
    positive(n, "n")
    positive(buckets, "buckets")
    names = [f"group_{i}" for i in range(len(by))]
    group = ["all", *names]
    rows = df.select(
        F.lit(0).alias("all"), *[F.col(column).alias(name) for column, name in zip(by, names)], F.col(key).alias("k"),
        F.col(measure).cast("double").alias("v"),
    ).withColumn("bucket", F.pmod(F.xxhash64("k"), F.lit(buckets)))

    bounds = store(rows.groupBy(*group, "bucket").agg(_bound(F.col("v")).alias("bound")))
    # n buckets have n keys at least, unless the group has no more.
    first = rank_within(bounds, group, [F.col("bound").desc(), F.col("bucket")], n).select(*group, "bucket")
    first = store(first)
    best = store(_best(_totals(_matching(rows, first, [*group, "bucket"]), group), group, n))

    reached = best.groupBy(*group).agg(F.when(F.count("total_cost") >= n, F.min("total_cost")).alias("least"))
    may = F.col("least").isNull() | (F.col("bound") >= F.col("least"))
    more = _matching(bounds, reached, group).filter(may).select(*group, "bucket")
    more = store(_matching(more, first, [*group, "bucket"], "left_anti"))
    opened = more.count()
    if 2 * opened > bounds.count():
        best = _best(_totals(rows, group), group, n)
    elif opened:
        others = _totals(_matching(rows, more, [*group, "bucket"]), group)
        best = _best(best.drop("rank").unionByName(others), group, n)
    back = [F.col(name).alias(column) for column, name in zip(by, names)]
    return best.select(*back, "rank", F.col("k").alias(key), "total_cost")


def _bound(v: Column) -> Column:
    """No total over some of the amounts is greater. One that overflows may also come out as NaN, the greatest."""
    upper = F.coalesce(F.sum(F.greatest(v, F.lit(0.0))), F.lit(0.0)) * (1 + ROUNDING)
    return F.when(upper == float("inf"), float("nan")).otherwise(upper)


def _totals(rows: DataFrame, group: list[str]) -> DataFrame:
    return rows.groupBy(*group, "k").agg(F.sum("v").alias("total_cost"))


def _best(totals: DataFrame, group: list[str], n: int) -> DataFrame:
    return rank_within(totals, group, [F.col("total_cost").desc_nulls_last(), F.col("k").asc_nulls_last()], n)


def _matching(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined on equal or NULL keys. ``other`` is stored, so Spark knows its size and sends it along if small."""
    other = other.select(*[F.col(c).alias(f"of_{c}") if c in on else F.col(c) for c in other.columns])
    same = reduce(Column.__and__, [rows[c].eqNullSafe(other[f"of_{c}"]) for c in on])
    return rows.join(other, same, how).drop(*[f"of_{c}" for c in on])
