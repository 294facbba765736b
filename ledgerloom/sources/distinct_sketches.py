"""How many accounts, services and regions a range of days has, from mergeable sketches beside the summary.

Distinct counts cannot be added up over days, so an exact one reads every row of the range. Here each day and source has
one sketch per column, made by Spark's own aggregate; a range is answered by merging as many sketches as it has days. The
estimate is off by more than ``ERROR`` of the count about three times in a thousand.

Sketches belong to the version of a month that they were made from, and a reader asks for the versions its commit names. So
what it gets is as of that commit: months without sketches yet are read from the summary. A run that
broke off while it wrote sketches has left no mark of success and is passed over.

NULL counts for nothing, empty text is a value, a range without rows has none of each.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.dates import days_between
from ledgerloom.sources import tables
from ledgerloom.sources.tables import Month

SKETCH_TABLE = "daily_distincts"
COUNTED = {"usage_account_id": "accounts", "product_code": "services", "region": "regions"}
#: Two to this power registers, at most 4 KB a sketch, and three standard errors.
REGISTERS = 12
ERROR = 3 * 1.04 / math.sqrt(2**REGISTERS)

_VERSION = ["data_source", "usage_month", "version"]
_SKETCHES = T.StructType(
    [T.StructField("usage_date", T.DateType())]
    + [T.StructField(name, T.BinaryType()) for name in COUNTED.values()]
    + [T.StructField(name, T.StringType()) for name in _VERSION]
)


def _sketched(stored: DataFrame) -> DataFrame:
    """Sketches per day of the summary's rows; a sketch would pass over empty text, hence the mark before it."""
    sketches = [F.hll_sketch_agg(F.concat(F.lit("="), column), REGISTERS).alias(name) for column, name in COUNTED.items()]
    return stored.groupBy("usage_date", *_VERSION).agg(*sketches).select(_SKETCHES.names)


def _named(spark: SparkSession, months: dict[Month, str]) -> DataFrame:
    rows = [(*month, version) for month, version in sorted(months.items())]
    return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in _VERSION))


def _read(spark: SparkSession, root: str, sources: Iterable[str], spelled: Iterable[str]) -> DataFrame:
    """Sketches of all runs that ended well, of these sources and months."""
    runs = tables.finished_runs(spark, f"{root}/{SKETCH_TABLE}")
    if not runs:
        return spark.createDataFrame([], _SKETCHES)
    found = None
    for run in runs:
        rows = spark.read.schema(_SKETCHES).parquet(run).select(_SKETCHES.names)
        found = rows if found is None else found.unionByName(rows)
    return found.filter(F.col("data_source").isin(sorted(sources)) & F.col("usage_month").isin(sorted(spelled)))


def _kept(spark: SparkSession, root: str, months: dict[Month, str]) -> tuple[DataFrame, dict[Month, str]]:
    """The sketches of the given versions of months, and the months that have none."""
    sources, spelled = {source for source, _ in months}, {month for _, month in months}
    kept = _read(spark, root, sources, spelled).join(_named(spark, months), _VERSION, "left_semi")
    there = {tuple(row) for row in kept.select(_VERSION).distinct().toLocalIterator()}
    return kept, {month: version for month, version in months.items() if (*month, version) not in there}


def store_sketches(spark: SparkSession, root: str) -> int:
    """Make the sketches of those months of the summary that have none; returns the number of months."""
    _, months = tables.summary_commit(spark, root)
    if not months:
        return 0
    _, lacking = _kept(spark, root, months)
    if lacking:
        made = _sketched(tables.stored_months(spark, root, lacking)).hint("rebalance", "data_source", "usage_month")
        made.write.partitionBy(*_VERSION).parquet(f"{root}/{SKETCH_TABLE}/run-{uuid.uuid4().hex}")
    return len(lacking)


def distinct_counts(
    spark: SparkSession, root: str, start: date | None = None, end: date | None = None, data_source: str | None = None
) -> DataFrame:
    """One row: estimates of ``accounts``, ``services`` and ``regions`` within a range of days of the stored summary."""
    months = tables.months_of(tables.summary_commit(spark, root)[1], start, end, data_source)
    sketches = spark.createDataFrame([], _SKETCHES)
    if months:
        sketches, lacking = _kept(spark, root, months)
        if lacking:
            sketches = sketches.unionByName(_sketched(tables.stored_months(spark, root, lacking)))
    if start or end:
        sketches = sketches.filter(days_between("usage_date", start or date.min, end or date.max))
    estimates = [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(name)), F.lit(0)).alias(name) for name in COUNTED.values()]
    return sketches.agg(*estimates)
