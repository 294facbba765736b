"""Every named query against its SQL, bit by bit, on the smallest sample tables."""

from __future__ import annotations

import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as spark_entry
import oracle
from ledgerloom.plans import catalogue

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalogue.oracle_sql()
QUERIES = catalogue.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    result = spark_entry.entry(spark)
    assert result.columns and not result.isEmpty()


@pytest.mark.parametrize(
    "name, exchanges",
    [("total_daily_costs", 1), ("cost_trend", 1), ("daily_trends", 2), ("detect_anomalies", 2),
     ("scan_anomalies", 2), ("compare_periods", 2), ("attribute_change", 2), ("drill_down", 3)],
)
def test_plan_shape(spark, name, exchanges):
    """One scan per source, a known number of shuffles, no nested loops, no Python."""
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Exchange ") == exchanges, plan
    assert plan.count("FileScan parquet [l_") == 1
    for unwanted in ("NestedLoop", "Cartesian", "Python", "Arrow"):
        assert unwanted not in plan


def test_date_ranges_reach_the_scan(spark):
    plan = QUERIES["q_total_spend"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in plan
    assert "ReadSchema" in plan and "l_suppkey" not in plan and "l_partkey" not in plan


def test_library_collects_nothing_and_runs_no_python():
    """Operators stay lazy; the ingestion driver and lists of stored files and months are the exception. Language-model operators have tests of their own."""
    root = Path(spark_entry.__file__).parent / "ledgerloom"
    eager = {"collect", "toPandas", "toLocalIterator", "rdd", "localCheckpoint",
             "crossJoin", "udf", "pandas_udf", "applyInPandas", "mapInPandas", "foreach"}
    allowed = {"ingestion.py", "tables.py", "day_index.py", "distinct_sketches.py", "ingestion_queries.py"}
    for path in set(root.rglob("*.py")) - set((root / "llm").rglob("*.py")):
        used = {n.attr for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Attribute)}
        assert path.name in allowed or not used & eager, (path, used & eager)
