"""The heaviest keys by bounds of buckets against a plain aggregate."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows_of
from ledgerloom.operators.heavy_groups import heaviest_keys
from ledgerloom.plans.registry import stored


def plain(df, by, key, n, measure):
    order = Window.partitionBy(*by).orderBy(F.col("total_cost").desc_nulls_last(), F.col(key).asc_nulls_last())
    totals = df.groupBy(*by, key).agg(F.sum(measure).alias("total_cost"))
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(*by, "rank", key, "total_cost")


@pytest.fixture(scope="module")
def costs(spark):
    """A group of a third of the rows, a NULL one, one of credits only, small ones; keys of falling weight; clashing names.

    Amounts are multiples of 1/64, whose sums are exact in any order.
    """
    r = F.pmod(F.xxhash64("id"), F.lit(1_000_003))
    service = (
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 30 == 1, None).when(F.col("id") % 30 == 2, "credits")
        .otherwise(F.concat(F.lit("s"), F.col("id") % 7))
    )
    key = F.when(r % 101 == 0, None).otherwise(F.concat(F.lit("r"), F.floor(F.sqrt(r.cast("double")) * 3)))
    amount = F.when(r % 13 == 0, None).when(service == "credits", -(r % 90) / 64).when(r % 11 == 0, -(r % 500) / 64)
    amount = amount.when(r % 997 < 5, 4096.0).otherwise((r % 640) / 64)
    return spark.range(40_000).select(service.alias("rank"), key.alias("bucket"), amount.alias("v"), F.lit(1).alias("all")).cache()


@pytest.mark.parametrize("buckets", [1, 64, 4096])
@pytest.mark.parametrize("n", [1, 7, 100])
def test_equals_a_plain_aggregate(costs, n, buckets):
    df = costs.select(F.col("rank").alias("service"), F.col("bucket").alias("resource"), "v", "all")
    got = heaviest_keys(df, ["service"], "resource", n, "v", stored, buckets)
    assert got.columns == ["service", "rank", "resource", "total_cost"]
    assert rows_of(got) == rows_of(plain(df, ["service"], "resource", n, "v"))


def test_all_rows_as_one_group_and_clashing_names(costs):
    df = costs.select(F.col("rank").alias("group_0"), F.col("bucket").alias("k"), F.col("v").alias("bound"), "all")
    assert rows_of(heaviest_keys(df, [], "k", 9, "bound", stored, 128)) == rows_of(plain(df, [], "k", 9, "bound"))
    two = heaviest_keys(df, ["group_0", "all"], "k", 3, "bound", stored, 128)
    assert rows_of(two) == rows_of(plain(df, ["group_0", "all"], "k", 3, "bound"))


def sizes_of(df, *args):
    sizes = []

    def store(table):
        table = stored(table)
        sizes.append(table.count())
        return table

    return heaviest_keys(df, *args, store, 512), sizes


def test_heavy_keys_open_few_buckets(spark):
    """Of 20,000 keys, twenty hold most of the cost: bounds rule nearly all buckets out."""
    rows = spark.range(60_000).select(
        (F.col("id") % 20_000).alias("resource"), F.when(F.col("id") % 1_000 == 0, 1000.0).otherwise(0.25).alias("v"))
    got, (bounds, first, best, more) = sizes_of(rows, [], "resource", 5, "v")
    assert rows_of(got) == rows_of(plain(rows, [], "resource", 5, "v"))
    assert (bounds, first, best) == (512, 5, 5) and more <= 20


def test_even_costs_are_all_added_up(spark):
    rows = spark.range(20_000).select((F.col("id") % 5_000).alias("resource"), F.lit(1.0).alias("v"))
    got, (_, _, _, more) = sizes_of(rows, [], "resource", 5, "v")
    assert rows_of(got, "resource", "total_cost") == [(i, 4.0) for i in range(5)]
    assert more == 507


def test_ties_nulls_and_special_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", "x", 1.0), ("a", "y", 1.0), ("a", None, 1.0), ("a", "z", None), ("b", "p", None), ("b", "q", None), ("b", "r", -5.0),
            ("c", "f", inf), ("c", "g", inf), ("c", "g", -inf), ("c", "h", nan), ("c", "i", 1e300)]
    got = heaviest_keys(spark.createDataFrame(rows, "s string, k string, v double"), ["s"], "k", 3, "v", stored, 16)
    found = {(r["s"], r["rank"]): (r["k"], r["total_cost"]) for r in got.collect()}
    assert all(math.isnan(found.pop(("c", i))[1]) for i in (1, 2))
    assert found == {
        ("a", 1): ("x", 1.0), ("a", 2): ("y", 1.0), ("a", 3): (None, 1.0),
        ("b", 1): ("r", -5.0), ("b", 2): ("p", None), ("b", 3): ("q", None), ("c", 3): ("f", inf)}


def test_empty_and_bad_arguments(spark):
    empty = spark.createDataFrame([], "s string, k string, v double")
    assert heaviest_keys(empty, ["s"], "k", 3, "v", stored).collect() == []
    with pytest.raises(ValueError):
        heaviest_keys(empty, ["s"], "k", 0, "v", stored)
    with pytest.raises(ValueError):
        heaviest_keys(empty, ["s"], "k", 1, "v", stored, 0)
