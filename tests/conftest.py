from __future__ import annotations

import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from ledgerloom.model import DAILY_SUMMARY, LINE_ITEMS, conform  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def days(start: date, count: int):
    return [start + timedelta(days=i) for i in range(count)]


@pytest.fixture(scope="session")
def make_summary(spark):
    """Summary rows from (date, account, product, region, net cost[, source])."""

    def make(rows):
        full = [
            (d, a, p, r, float(c), float(c), float(c), 10.0 * c, 1, source[0] if source else "cur")
            for d, a, p, r, c, *source in rows
        ]
        return spark.createDataFrame(full, DAILY_SUMMARY)

    return make


@pytest.fixture(scope="session")
def make_line_items(spark):
    """Line items from dicts of the columns that matter; the others are NULL."""

    def make(rows):
        names = sorted({k for row in rows for k in row})
        kinds = {f.name: f.dataType.simpleString() for f in LINE_ITEMS}
        schema = ", ".join(f"{n} {kinds[n]}" for n in names)
        df = spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)
        return conform(df, LINE_ITEMS)

    return make


def rows_of(df, *columns):
    """Rows as tuples of the given columns, in a comparable order."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
