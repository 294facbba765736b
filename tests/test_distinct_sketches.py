"""Distinct counts from sketches against exact ones."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.model import DAILY_SUMMARY, conform
from ledgerloom.sources import distinct_sketches as sketches, tables


def summary_of(spark, start, days, accounts):
    """Accounts in turn over the days, one day's overlapping the next day's; some NULL, some empty."""
    account = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, "").otherwise(F.concat(F.lit("a"), F.col("id") % accounts))
    return conform(spark.range(2 * accounts).select(
        F.date_add(F.lit(start), F.floor(F.col("id") * days / (2 * accounts)).cast("int")).alias("usage_date"),
        account.alias("usage_account_id"), F.concat(F.lit("p"), F.col("id") % 7).alias("product_code"),
        F.lit(None).cast("string").alias("region"), F.lit(1.0).alias("total_unblended_cost"), F.lit("cur").alias("data_source"),
    ), DAILY_SUMMARY)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sketches"))
    tables.write_rebuilt_summary(summary_of(spark, date(2025, 1, 1), 70, 20_000), root)
    assert sketches.store_sketches(spark, root) == 3 and sketches.store_sketches(spark, root) == 0
    return root


def exact(spark, root, *span):
    return tables.read_summary(spark, root, *span).agg(
        *[F.countDistinct(column).alias(name) for column, name in sketches.COUNTED.items()]).first()


@pytest.mark.parametrize("span", [(), (date(2025, 1, 10), date(2025, 2, 20)), (None, date(2025, 1, 3)), (date(2025, 2, 28), None)])
def test_ranges_within_the_error(spark, store, span):
    got, want = sketches.distinct_counts(spark, store, *span).first(), exact(spark, store, *span)
    assert want["accounts"] > 800
    assert abs(got["accounts"] - want["accounts"]) <= sketches.ERROR * want["accounts"]
    assert (got["services"], got["regions"]) == (want["services"], want["regions"]) == (7, 0)


def test_only_sketches_are_opened(spark, store):
    opened = sketches.distinct_counts(spark, store, date(2025, 1, 10), date(2025, 2, 20)).inputFiles()
    assert opened and all(f"/{sketches.SKETCH_TABLE}/" in path for path in opened)


def test_empty_text_is_a_value_and_null_is_none(spark, tmp_path, make_summary):
    root = str(tmp_path)
    day = date(2025, 1, 1)
    tables.write_rebuilt_summary(make_summary([(day, "", "p", None, 1), (day, "x", "p", None, 1), (day, None, "q", None, 1)]), root)
    for _ in range(2):
        assert tuple(sketches.distinct_counts(spark, root).first()) == (2, 2, 0)
        sketches.store_sketches(spark, root)


def test_a_rewritten_month_counts_as_of_its_commit(spark, tmp_path, make_summary):
    root = str(tmp_path)
    days = [date(2025, 1, 1), date(2025, 2, 1)]
    tables.write_rebuilt_summary(make_summary([(d, f"a{i}", "p", "r", 1) for d in days for i in range(5)]), root)
    sketches.store_sketches(spark, root)
    tables.write_rebuilt_days(make_summary([(days[1], f"b{i}", "q", "s", 1) for i in range(3)]), root, [days[1]])
    assert tuple(sketches.distinct_counts(spark, root).first()) == (8, 2, 2)
    assert tuple(sketches.distinct_counts(spark, root, days[1], days[1]).first()) == (3, 1, 1)
    assert sketches.store_sketches(spark, root) == 1
    assert tuple(sketches.distinct_counts(spark, root).first()) == (8, 2, 2)
    assert tuple(sketches.distinct_counts(spark, root, data_source="cost_explorer").first()) == (0, 0, 0)


def test_a_run_that_broke_off_is_passed_over(spark, tmp_path, make_summary):
    root = tmp_path
    tables.write_rebuilt_summary(make_summary([(date(2025, 1, 1), "a", "p", "r", 1)]), str(root))
    sketches.store_sketches(spark, str(root))
    (mark,) = (root / sketches.SKETCH_TABLE).glob("*/_SUCCESS")
    mark.unlink()
    assert tables.finished_runs(spark, str(root / sketches.SKETCH_TABLE)) == []
    assert tuple(sketches.distinct_counts(spark, str(root)).first()) == (1, 1, 1)
    assert sketches.store_sketches(spark, str(root)) == 1


def test_no_summary(spark, tmp_path):
    assert sketches.store_sketches(spark, str(tmp_path)) == 0
    assert tuple(sketches.distinct_counts(spark, str(tmp_path)).first()) == (0, 0, 0)
