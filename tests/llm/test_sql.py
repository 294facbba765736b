"""Queries that SQL can express, against DuckDB on the smallest sample tables."""

from __future__ import annotations

import os

import pytest

import oracle
from ledgerloom.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, monkeypatch, name):
    monkeypatch.setattr(oracle, "ALLOWED", oracle.ALLOWED | {"INTEGER"})
    monkeypatch.setitem(oracle.SPARK_KIND, "int", "INTEGER")
    assert oracle.difference(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.ORACLES[name]) is None
