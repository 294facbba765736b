"""Which days each stored file of line items holds, so that a range of days opens only files that have some.

Line items are partitioned by billing period, and usage may lie outside of it, so no folder can be ruled out by a range of
days. The index has one row per stored file and export file it holds rows of, found by one job over two columns of the
files it does not know yet. It is a help and never the truth: files it does not know are read, and what it says of
files that are gone is passed over. So a run that broke off before indexing loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.functions.dates import instants_between
from ledgerloom.model import LINE_ITEMS, conform
from ledgerloom.sources.tables import LINE_ITEM_TABLE, path_exists, read_table

INDEX_TABLE = "line_item_days"

INDEX = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("s3_key", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("first_day", T.DateType()),
        T.StructField("last_day", T.DateType()),
        T.StructField("undated", T.LongType()),
    ]
)


def _file(path: Column) -> Column:
    """A stored file by its partition's folder and its name; one write uses a name once per folder."""
    return F.substring_index(path, "/", -2)


def _stored_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, file) of the line items' files as they are now. Contents are not read."""
    table = f"{root}/{LINE_ITEM_TABLE}"
    if not path_exists(spark, table):
        return spark.createDataFrame([], "path string, file string")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return listed.load(table).select("path", _file(F.col("path")).alias("file"))


def _paths(files: DataFrame) -> list[str]:
    """As many as Spark's own listing of them holds on the driver."""
    return sorted(row["path"] for row in files.select("path").collect())


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The index of the files that are there, one row per file and export file."""
    return read_table(spark, f"{root}/{INDEX_TABLE}", INDEX).join(_stored_files(spark, root), "file", "left_semi")


def index_line_items(spark: SparkSession, root: str) -> int:
    """Add the files that the index does not know yet; returns their number."""
    known = read_table(spark, f"{root}/{INDEX_TABLE}", INDEX)
    paths = _paths(_stored_files(spark, root).join(known, "file", "left_anti"))
    if not paths:
        return 0
    start = F.col("usage_start_date")
    rows = spark.read.schema(LINE_ITEMS).parquet(*paths)
    found = rows.groupBy(_file(F.col("_metadata.file_path")).alias("file"), F.col("_source_file").alias("s3_key")).agg(
        F.count("*").alias("rows"),
        F.to_date(F.min(start)).alias("first_day"),
        F.to_date(F.max(start)).alias("last_day"),
        F.count_if(start.isNull()).alias("undated"),
    )
    conform(found, INDEX).write.mode("append").parquet(f"{root}/{INDEX_TABLE}")
    return len(paths)


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """(s3_key, rows_loaded): how many rows of each export file are stored, without reading them; index the files first."""
    return read_index(spark, root).groupBy("s3_key").agg(F.sum("rows").alias("rows_loaded"))


def read_line_items_of(
    spark: SparkSession, root: str, ranges: Sequence[tuple[date, date]], undated: bool = False
) -> DataFrame:
    """Line items whose usage starts within one of the ranges of days, and with ``undated`` those of no day.

    Only files that hold such days are opened, and files that are not in the index.
    """
    wanted, held = F.lit(False), F.lit(False)
    if undated:
        wanted, held = F.col("usage_start_date").isNull(), F.col("undated") > 0
    for first, last in ranges:
        wanted = wanted | instants_between("usage_start_date", first, last)
        held = held | ((F.col("first_day") <= F.lit(last)) & (F.col("last_day") >= F.lit(first)))
    index = read_table(spark, f"{root}/{INDEX_TABLE}", INDEX)
    without = index.groupBy("file").agg(F.max(F.coalesce(held, F.lit(False))).alias("held")).filter("NOT held")
    paths = _paths(_stored_files(spark, root).join(without, "file", "left_anti"))
    if not paths:
        return spark.createDataFrame([], LINE_ITEMS)
    rows = spark.read.schema(LINE_ITEMS).option("basePath", f"{root}/{LINE_ITEM_TABLE}").parquet(*paths)
    return conform(rows, LINE_ITEMS).filter(wanted)
