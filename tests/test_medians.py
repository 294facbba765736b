"""Medians by refinement against the built-in aggregate."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.operators import medians
from ledgerloom.operators.medians import exact_medians
from ledgerloom.plans.registry import stored


def built_in(df, keys):
    return df.filter("v IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.median("v").alias("median"))


@pytest.fixture(scope="module")
def skewed(spark):
    """A hot group of two thirds, one of equal values, one of heavy tails, small ones, NULL keys and values, clashing names."""
    kind = (
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 9 == 0, "equal").when(F.col("id") % 9 == 3, None)
        .when(F.col("id") % 2 == 0, "tails").otherwise(F.concat(F.lit("small-"), F.col("id") % 50))
    )
    r = F.pmod(F.xxhash64("id"), F.lit(100_003))
    value = (
        F.when(F.col("id") % 17 == 0, None).when(kind == "equal", F.when(F.col("id") % 4 > 0, 7.0).otherwise(r.cast("double")))
        .when(kind == "tails", F.pow(F.lit(10.0), (r % 600 - 300).cast("double"))).otherwise(r / 64 - 500)
    )
    return spark.range(30_000).select(kind.alias("found"), (F.col("id") % 2).alias("n"), value.alias("v")).cache()


@pytest.mark.parametrize("keys", [["found"], ["found", "n"]])
@pytest.mark.parametrize("few", [5, 300])
def test_equals_the_built_in_median(skewed, keys, few):
    named = [F.col(k).alias(f"g_{k}") for k in keys]
    df = skewed.select(*named, "v")
    keys = [f"g_{k}" for k in keys]
    got = {r[:-1]: r[-1] for r in rows_of(exact_medians(df, keys, "v", stored, few))}
    want = {r[:-1]: r[-1] for r in rows_of(built_in(df, keys))}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-15) for k in want)


def test_all_rows_as_one_group(skewed):
    (got,), (want,) = exact_medians(skewed, [], "v", stored, 100).collect(), built_in(skewed, []).collect()
    assert got == want


@pytest.mark.parametrize("end", [F.min, F.max])
def test_sketches_that_miss_cost_passes_only(skewed, monkeypatch, end):
    """First marks far off the ranks they stand for: counts put the interval right."""
    sketch, calls = medians._marks, []

    def marks(v):
        calls.append(v)
        return F.array_repeat(end(v), medians.GRID + 1) if len(calls) == 1 else sketch(v)

    monkeypatch.setattr(medians, "_marks", marks)
    hot = skewed.filter("found = 'hot'")
    (got,), (want,) = exact_medians(hot, ["found"], "v", stored, 400).collect(), built_in(hot, ["found"]).collect()
    assert got == want and len(calls) > 2


def test_even_groups_ties_and_special_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("b", 5.0), ("b", 9.0), ("c", None), ("d", 3.0), ("d", float("nan")),
            ("d", float("nan")), (None, -0.0), (None, 0.0)]
    got = exact_medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", stored, 1)
    found = {r["k"]: (r["n"], r["median"]) for r in got.collect()}
    assert math.isnan(found.pop("d")[1])
    assert found == {"a": (2, 1.5), "b": (4, 3.0), None: (2, 0.0)}


def test_empty(spark):
    assert exact_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v", stored).collect() == []


def test_few_must_be_positive(spark):
    with pytest.raises(ValueError):
        exact_medians(spark.range(1), [], "id", stored, 0)
