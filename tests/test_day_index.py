"""Stored line items by days: which files are opened, and that nothing is missed."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.sources import day_index, tables

JAN, FEB, MAR = (date(2025, m, 1) for m in (1, 2, 3))


def items(make_line_items, *rows):
    """Rows of (period start, usage start, cost, export file)."""
    names = ("billing_period_start", "usage_start_date", "unblended_cost", "_source_file")
    return make_line_items([dict(zip(names, row)) for row in rows]).coalesce(1)


@pytest.fixture
def store(tmp_path, make_line_items):
    """Three periods; February's file holds a late row of January, one of March has no day in one row."""
    root = str(tmp_path / "tables")
    tables.append_line_items(items(
        make_line_items,
        (JAN, datetime(2025, 1, 5), 1.0, "a"), (JAN, datetime(2025, 1, 20, 23), 2.0, "a"),
        (FEB, datetime(2025, 1, 31, 23, 59), 4.0, "b"), (FEB, datetime(2025, 2, 10), 8.0, "b"),
        (MAR, datetime(2025, 3, 3), 16.0, "c"), (MAR, None, 32.0, "c"), (None, datetime(2025, 3, 9), 64.0, "d")), root)
    return root


def folders(df):
    return sorted(path.split("/")[-2].split("=")[1] for path in df.inputFiles())


def of_days(spark, store, first, last, undated=False):
    return day_index.read_line_items_of(spark, store, [(first, last)], undated)


def test_only_files_with_such_days_are_opened(spark, store):
    assert day_index.index_line_items(spark, store) == 4 and day_index.index_line_items(spark, store) == 0
    late = of_days(spark, store, date(2025, 1, 21), date(2025, 2, 9))
    assert folders(late) == ["2025-02-01"] and rows_of(late, "unblended_cost") == [(4.0,)]
    start = of_days(spark, store, date(2025, 1, 20), date(2025, 1, 20))
    assert folders(start) == ["2025-01-01"] and rows_of(start, "unblended_cost", "billing_period_start") == [(2.0, JAN)]
    none = day_index.read_line_items_of(spark, store, [], undated=True)
    assert folders(none) == ["2025-03-01"] and rows_of(none, "unblended_cost") == [(32.0,)]
    two = day_index.read_line_items_of(spark, store, [(JAN, date(2025, 1, 5)), (date(2025, 3, 9), date(2025, 3, 9))])
    assert folders(two) == ["2025-01-01", "__HIVE_DEFAULT_PARTITION__"] and rows_of(two, "unblended_cost") == [(1.0,), (64.0,)]
    empty = of_days(spark, store, date(2030, 1, 1), date(2030, 1, 2))
    assert empty.inputFiles() == [] and empty.isEmpty() and empty.columns == tables.LINE_ITEMS.names


def test_files_unknown_to_the_index_are_read(spark, store, make_line_items):
    assert len(folders(of_days(spark, store, JAN, JAN))) == 4
    day_index.index_line_items(spark, store)
    tables.append_line_items(items(make_line_items, (MAR, datetime(2025, 1, 2), 128.0, "e")), store)
    found = of_days(spark, store, date(2025, 1, 2), date(2025, 1, 2))
    assert folders(found) == ["2025-03-01"] and rows_of(found, "unblended_cost") == [(128.0,)]
    assert day_index.index_line_items(spark, store) == 1


def test_replaced_files_leave_the_index(spark, store, make_line_items):
    day_index.index_line_items(spark, store)
    held = tables.read_line_items(spark, store).filter("_source_file <> 'b'")
    tables.replace_line_items(spark, store, items(make_line_items, (FEB, datetime(2025, 2, 2), 256.0, "f")), held, [FEB])
    day_index.index_line_items(spark, store)
    assert rows_of(day_index.stored_counts(spark, store)) == [("a", 2), ("c", 2), ("d", 1), ("f", 1)]
    assert of_days(spark, store, date(2025, 1, 31), date(2025, 1, 31)).inputFiles() == []
    assert rows_of(of_days(spark, store, FEB, MAR), "unblended_cost") == [(256.0,)]


def test_equals_a_filter_of_all_rows(spark, store):
    day_index.index_line_items(spark, store)
    whole, day = tables.read_line_items(spark, store), F.to_date("usage_start_date")
    for first, last in ((JAN, MAR), (date(2025, 1, 5), date(2025, 1, 31)), (date(2025, 3, 3), date(2025, 3, 9))):
        assert rows_of(of_days(spark, store, first, last)) == rows_of(whole.filter(day.between(first, last)))


def test_a_table_that_is_not_there(spark, tmp_path):
    root = str(tmp_path / "none")
    assert day_index.index_line_items(spark, root) == 0
    assert of_days(spark, root, JAN, FEB).isEmpty() and day_index.stored_counts(spark, root).isEmpty()
