"""Exact medians of groups of any size, without gathering a group.

Spark's own median keeps a count for each distinct value of a group in one task. Here that holds only for groups
of at most ``FEW`` values. For the others, mergeable quantile sketches give an interval around the middle, a pass counts
what lies below, at and inside its ends, and the next sketch looks inside only; an interval shrinks about by
``GRID / 3`` a pass, until few values are left to be sorted. Sketches only propose: counts decide, so the result is exact
also where a sketch is off.

NULL values count for nothing, groups of NULL values only are left out, NULL keys are one group, NaN is the greatest value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.checks import positive

#: Values of a group that one task may sort; steps of a sketch; its accuracy, many times finer than a step.
FEW, GRID, ACCURACY = 4096, 256, 8192


def exact_medians(
    df: DataFrame, keys: Sequence[str], value: str, store: Callable[[DataFrame], DataFrame], few: int = FEW
) -> DataFrame:
    """``keys``, ``n`` (values that are not NULL) and ``median`` of each group; of all rows if there are no keys.

    ``store`` writes a table and reads it back. What it gets has one row per group of more than ``few`` values.
    """
    positive(few, "few")
    names = [f"key_{i}" for i in range(len(keys))]
    chosen = [F.col(key).alias(name) for key, name in zip(keys, names)]
    rows = df.select(F.lit(0).alias("all"), *chosen, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    group = ["all", *names]
    back = [F.col(name).alias(key) for key, name in zip(keys, names)]

    sized = rows.groupBy(*group).agg(F.count("*").alias("n"), _marks(F.col("v")).alias("marks"))
    large = store(sized.filter(F.col("n") > few))
    direct = _matching(rows, large.select(*group), group, "left_anti").groupBy(*group)
    small = direct.agg(F.count("*").alias("n"), F.median("v").alias("median")).select(*back, "n", "median")
    if large.isEmpty():
        return small

    whole = {"lo": "double", "hi": "double"}
    state = large.select(
        *group, "n", F.expr("(n - 1) DIV 2").alias("rank"), F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in whole.items()], "marks",
    )
    found, last = [], []
    while True:
        last.append(state.filter(F.coalesce(F.col("inside") <= few, F.lit(False))))
        state = state.filter(F.coalesce(F.col("inside") > few, F.lit(True)))
        if state.isEmpty():
            break
        passed = store(_verdict(_counted(rows, _narrowed(state), group)))
        found.append(passed.filter("found IS NOT NULL").select(*group, "n", "found"))
        state = passed.filter("found IS NULL").drop("found")
    found.append(_sorted_out(rows, reduce(DataFrame.unionByName, last), group))
    lower = store(reduce(DataFrame.unionByName, found))
    return _with_upper(rows, lower, group).select(*back, "n", "median").unionByName(small)


def _marks(v: Column) -> Column:
    """The values at every ``GRID``-th part of the ranks, about."""
    return F.percentile_approx(v, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _matching(rows: DataFrame, groups: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined to the columns of their group; NULL keys match. A hot group is split by adaptive execution."""
    other = groups.select(*[F.col(c).alias(f"of_{c}") if c in group else F.col(c) for c in groups.columns])
    same = reduce(Column.__and__, [rows[c].eqNullSafe(other[f"of_{c}"]) for c in group])
    return rows.join(other, same, how).drop(*[f"of_{c}" for c in group])


def _narrowed(state: DataFrame) -> DataFrame:
    """The state with ends moved to the marks around the wanted rank, one step further on either side."""
    step = F.floor((F.col("rank") - F.col("before") + 1) * GRID / F.col("inside")).cast("int")
    lo, hi = F.get("marks", step - 1), F.get("marks", step + 2)
    # Without marks an interval is counted as it is.
    return state.withColumns({"lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi")}).drop("before", "inside", "marks")


def _between() -> Column:
    """Whether a value lies inside an interval; an end that is NULL is open."""
    above, below = F.col("lo").isNull() | (F.col("v") > F.col("lo")), F.col("hi").isNull() | (F.col("v") < F.col("hi"))
    return above & below


def _counted(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    v, between = F.col("v"), _between()
    return (
        _matching(rows, state, group)
        .groupBy(*group, "n", "rank", "lo", "hi")
        .agg(
            F.count_if(v < F.col("lo")).alias("under"),
            F.count_if(v == F.col("lo")).alias("at_lo"),
            F.count_if(between).alias("within"),
            F.count_if(v == F.col("hi")).alias("at_hi"),
            _marks(F.when(between, v)).alias("marks"),
        )
    )


def _verdict(counted: DataFrame) -> DataFrame:
    """The value at the rank where it is an end of the interval, or else the interval to go on with."""
    rank, lo, hi = F.col("rank"), F.col("lo"), F.col("hi")
    low = F.col("under") + F.col("at_lo")
    high = low + F.col("within")
    under, at_lo, within = rank < F.col("under"), rank < low, rank < high
    at_hi = rank < high + F.col("at_hi")
    hit = ~at_lo & within
    return counted.select(
        *[c for c in counted.columns if c not in ("lo", "hi", "under", "at_lo", "within", "at_hi", "marks")],
        F.when(under, None).when(at_lo, lo).when(within, None).when(at_hi, hi).alias("found"),
        # A sketch that missed leaves the side it missed, unbounded.
        F.when(hit, lo).when(~under, hi).alias("lo"),
        F.when(hit, hi).when(under, lo).alias("hi"),
        F.when(hit, low).alias("before"),
        F.when(hit, F.col("within")).alias("inside"),
        F.when(hit, F.col("marks")).alias("marks"),
    )


def _sorted_out(rows: DataFrame, state: DataFrame, group: list[str]) -> DataFrame:
    """The value at the rank of each group, of whose interval few values are left."""
    left = _matching(rows, state.drop("marks", "inside"), group).filter(_between())
    values = left.groupBy(*group, "n", "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("values"))
    return values.select(*group, "n", F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias("found"))


def _with_upper(rows: DataFrame, lower: DataFrame, group: list[str]) -> DataFrame:
    """The mean of the lower middle value and the upper one, which is the same or the next greater."""
    v, found = F.col("v"), F.col("found")
    counts = _matching(rows, lower, group).groupBy(*group, "n", "found").agg(
        F.count_if(v <= found).alias("upto"), F.min(F.when(v > found, v)).alias("above")
    )
    upper = F.when(F.col("upto") > F.expr("n DIV 2"), found).otherwise(F.col("above"))
    return counts.select(*group, "n", F.when(upper == found, found).otherwise(found / 2 + upper / 2).alias("median"))
