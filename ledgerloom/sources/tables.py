"""The model's tables as partitioned Parquet below one root.

Line items are partitioned by the start of their billing period, the summary by
source and month, its days in order, the log by billing period: what a restatement replaces is always
a set of whole partitions, and date filters prune directories. Plain Parquet has
no transaction over several tables; the ingestion orders its writes so that a
run that broke off can simply be run again.

The summary by itself is transactional. A write puts the months it changes into
folders of its own version beside the others, and then publishes one small commit
file that names the version of every month. A reader takes the latest whole commit
and reads the folders it names: the rows before a write or those after it, never
some of both, whatever the writer is doing and also if it broke off. Folders that
no kept commit names are removed by `expire_summary`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from datetime import date

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerloom.fixed_values import API_SOURCE, EXPORT_SOURCE
from ledgerloom.functions.dates import days_between, islands
from ledgerloom.model import DAILY_SUMMARY, INGESTION_LOG, LINE_ITEMS, conform

LINE_ITEM_TABLE = "cost_line_items"
SUMMARY_TABLE = "daily_cost_summary"
LOG_TABLE = "ingestion_log"
PENDING_TABLE = "pending_days"

REJECT_TABLE = "ingestion_rejects"
REJECTS = T.StructType([T.StructField(name, T.StringType()) for name in ("billing_period", "s3_key", "error")])

PENDING = T.StructType([T.StructField("day", T.DateType())])


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _path(spark, path)
    return files.exists(where)


def finished_runs(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the folders of a table below ``folder`` whose write has ended well."""
    files, pattern = _path(spark, f"{folder}/*/_SUCCESS")
    return sorted(status.getPath().getParent().toString() for status in files.globStatus(pattern) or [])


def drop_partitions(spark: SparkSession, table: str, column: str, values: Iterable) -> None:
    """Remove whole partitions of a table; partitions that do not exist are skipped."""
    for value in values:
        files, where = _path(spark, f"{table}/{column}={value}")
        files.delete(where, True)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table of the given columns, empty where it has not been written yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return conform(spark.read.schema(schema).parquet(path), schema)


def read_line_items(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/{LINE_ITEM_TABLE}", LINE_ITEMS)


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/{LOG_TABLE}", INGESTION_LOG)


def append_line_items(line_items: DataFrame, root: str, name: str = LINE_ITEM_TABLE) -> None:
    """Append by column name. Each task sorts its rows by day, so that row-group
    statistics prune; nothing is shuffled."""
    (
        conform(line_items, LINE_ITEMS)
        .sortWithinPartitions("billing_period_start", "usage_start_date")
        .write.mode("append")
        .partitionBy("billing_period_start")
        .parquet(f"{root}/{name}")
    )


def replace_line_items(
    spark: SparkSession, root: str, rows: DataFrame, stay: DataFrame, starts: list[date | None]
) -> None:
    """Store ``rows``; of what is stored, only ``stay`` stays in the partitions of ``starts``.

    Those partitions are written to a folder beside the table first, what stays and what comes, and then
    put in place by a rename each; the other rows are appended.
    """
    if not starts:
        append_line_items(rows, root)
        return
    start = F.col("billing_period_start")
    days = [day for day in starts if day is not None]
    affected = F.coalesce(start.isin(days), F.lit(False)) | (start.isNull() if None in starts else F.lit(False))
    fresh = conform(rows, LINE_ITEMS)
    aside = f"{root}/{LINE_ITEM_TABLE}_replacing"
    files_of, where = _path(spark, aside)
    files_of.delete(where, True)
    append_line_items(stay.filter(affected).unionByName(fresh.filter(affected)), root, name=f"{LINE_ITEM_TABLE}_replacing")
    append_line_items(fresh.filter(~affected), root)
    for day in starts:
        name = f"billing_period_start={'__HIVE_DEFAULT_PARTITION__' if day is None else day}"
        old, new = _path(spark, f"{root}/{LINE_ITEM_TABLE}/{name}")[1], _path(spark, f"{aside}/{name}")[1]
        files_of.delete(old, True)
        if files_of.exists(new):
            files_of.rename(new, old)
    files_of.delete(where, True)


def append_log(entries: DataFrame, root: str) -> None:
    (
        conform(entries, INGESTION_LOG)
        .hint("rebalance", "billing_period")
        .write.mode("append")
        .partitionBy("billing_period")
        .parquet(f"{root}/{LOG_TABLE}")
    )


def _by_day(summary: DataFrame) -> DataFrame:
    """Summary rows shuffled so that a month goes to few files, large months split, with days in order."""
    month = F.coalesce(F.date_format("usage_date", "yyyy-MM"), F.lit(_NO_MONTH))
    dealt = conform(summary, DAILY_SUMMARY).withColumn("usage_month", month).hint("rebalance", "data_source", "usage_month")
    return dealt.sortWithinPartitions("data_source", "usage_month", "usage_date")


#: A month's partition: source, and the month as its folder spells it.
Month = tuple[str, str]
_NO_MONTH = "none"
_STORED = T.StructType([*DAILY_SUMMARY, T.StructField("usage_month", T.StringType()), T.StructField("version", T.StringType())])
_COMMITS, _END = "_commits", "end"


def _spelled(day: date | None) -> str:
    return _NO_MONTH if day is None else f"{day:%Y-%m}"


def _month_path(root: str, month: Month, version: str) -> str:
    return f"{root}/{SUMMARY_TABLE}/data_source={month[0]}/usage_month={month[1]}/version={version}"


def _commit_numbers(spark: SparkSession, root: str) -> list[int]:
    files, where = _path(spark, f"{root}/{SUMMARY_TABLE}/{_COMMITS}")
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted((int(name) for name in names if name.isdigit()), reverse=True)


def _read_commit(spark: SparkSession, root: str, number: int) -> dict[Month, str] | None:
    """The version of every month as of a commit; None while it is still being written."""
    files, where = _path(spark, f"{root}/{SUMMARY_TABLE}/{_COMMITS}/{number:012d}")
    stream = files.open(where)
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    finally:
        stream.close()
    if lines[-1] != f"{_END} {len(lines) - 1}":
        return None
    return {(source, month): version for source, month, version in (line.split("\t") for line in lines[:-1])}


def summary_commit(spark: SparkSession, root: str) -> tuple[int, dict[Month, str]]:
    """Number and content of the latest whole commit; 0 and nothing before the first."""
    for number in _commit_numbers(spark, root):
        found = _read_commit(spark, root, number)
        if found is not None:
            return number, found
    return 0, {}


def _publish(spark: SparkSession, root: str, number: int, months: dict[Month, str]) -> None:
    """Write a commit file. The file is created exclusively, so of two writers that started from one commit one fails."""
    lines = ["\t".join((*month, version)) for month, version in sorted(months.items())]
    text = "\n".join([*lines, f"{_END} {len(lines)}"])
    files, where = _path(spark, f"{root}/{SUMMARY_TABLE}/{_COMMITS}/{number:012d}")
    stream = files.create(where, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def _replace(
    summary: DataFrame, root: str, data_source: str, months: Callable[[str], bool], stays: Column | None = None
) -> None:
    """Publish ``summary`` in place of the ``months`` of a source; of what these hold, rows that ``stays`` picks are carried over."""
    spark = summary.sparkSession
    numbers = _commit_numbers(spark, root)
    _, before = summary_commit(spark, root)
    changed = {month: version for month, version in before.items() if month[0] == data_source and months(month[1])}
    rows = conform(summary.withColumn("data_source", F.lit(data_source)), DAILY_SUMMARY)
    if stays is not None and changed:
        rows = rows.unionByName(_read_months(spark, root, changed).filter(stays))
    version = uuid.uuid4().hex
    written = _by_day(rows).withColumn("version", F.lit(version)).write.mode("append")
    written.partitionBy("data_source", "usage_month", "version").parquet(f"{root}/{SUMMARY_TABLE}")
    files, pattern = _path(spark, f"{root}/{SUMMARY_TABLE}/data_source=*/usage_month=*/version={version}")
    after = {month: held for month, held in before.items() if month not in changed}
    for status in files.globStatus(pattern):
        parts = dict(part.split("=", 1) for part in status.getPath().toString().split("/")[-3:])
        after[parts["data_source"], parts["usage_month"]] = version
    _publish(spark, root, (numbers[0] if numbers else 0) + 1, after)


def months_of(
    months: dict[Month, str], start: date | None = None, end: date | None = None, data_source: str | None = None
) -> dict[Month, str]:
    """Those months of a commit that may hold days of a range and rows of a source."""

    def wanted(month: Month) -> bool:
        if data_source and month[0] != data_source:
            return False
        if not (start or end):
            return True
        return month[1] != _NO_MONTH and _spelled(start or date.min) <= month[1] <= _spelled(end or date.max)

    return {month: version for month, version in months.items() if wanted(month)}


def read_summary(
    spark: SparkSession,
    root: str,
    start: date | None = None,
    end: date | None = None,
    data_source: str | None = None,
) -> DataFrame:
    """The summary as of now, pinned: later writes do not change what the result reads.

    A range of days or a source is looked up in the commit, so the folders of other months are not even listed.
    """
    rows = _read_months(spark, root, months_of(summary_commit(spark, root)[1], start, end, data_source))
    return rows.filter(days_between("usage_date", start or date.min, end or date.max)) if start or end else rows


def read_summary_as_of(spark: SparkSession, root: str, number: int) -> DataFrame:
    """The summary as a commit left it, as long as its folders are kept."""
    months = _read_commit(spark, root, number)
    if months is None:
        raise ValueError(f"commit {number} is not whole")
    return _read_months(spark, root, months)


def stored_months(spark: SparkSession, root: str, months: dict[Month, str]) -> DataFrame:
    """Rows of the given versions of months (at least one), with ``usage_month`` and ``version``."""
    paths = [_month_path(root, month, version) for month, version in sorted(months.items())]
    return spark.read.schema(_STORED).option("basePath", f"{root}/{SUMMARY_TABLE}").parquet(*paths)


def _read_months(spark: SparkSession, root: str, months: dict[Month, str]) -> DataFrame:
    if not months:
        return spark.createDataFrame([], DAILY_SUMMARY)
    return conform(stored_months(spark, root, months), DAILY_SUMMARY)


def write_rebuilt_summary(summary: DataFrame, root: str, data_source: str = EXPORT_SOURCE) -> int:
    """Replace every row of one source; other sources are not touched. Returns the rows written."""
    _replace(summary, root, data_source, lambda month: True)
    return count_summary(summary.sparkSession, root, data_source)


def write_rebuilt_days(summary: DataFrame, root: str, days: Iterable[date | None]) -> None:
    """Replace the export rows of the given days. Of their months, and of no other, the other days are carried over."""
    days = set(days)
    gone = F.col("usage_date").isNull() if None in days else F.lit(False)
    for first, last in islands(day for day in days if day is not None):
        gone = gone | F.coalesce(days_between("usage_date", first, last), F.lit(False))
    _replace(summary, root, EXPORT_SOURCE, {_spelled(day) for day in days}.__contains__, ~gone)


def write_summary_range(incoming: DataFrame, root: str, data_source: str = API_SOURCE) -> int:
    """Replace one source over the date range of ``incoming``; returns the rows written.

    Only the months of that range are rewritten. Dates in the range without an
    incoming row are dropped. The driver sees the first and last date.
    """
    spark = incoming.sparkSession
    day = F.col("usage_date")
    first, last, undated = incoming.agg(F.min(day), F.max(day), F.count_if(day.isNull())).first()
    if undated:
        raise ValueError("incoming costs without a usage_date")
    if first is None:
        return 0
    stays = ~F.coalesce(days_between("usage_date", first, last), F.lit(False))
    _replace(incoming, root, data_source, lambda month: month != _NO_MONTH and _spelled(first) <= month <= _spelled(last), stays)
    return count_summary(spark, root, data_source, first, last)


def expire_summary(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` commits and the folders none of them names; returns the folders removed.

    Not to be run while a write is under way, whose folders no commit names yet.
    """
    numbers = _commit_numbers(spark, root)
    kept = [number for number in numbers if _read_commit(spark, root, number) is not None][:keep]
    named = {
        _month_path("", month, version)
        for number in kept
        for month, version in (_read_commit(spark, root, number) or {}).items()
    }
    files, pattern = _path(spark, f"{root}/{SUMMARY_TABLE}/data_source=*/usage_month=*/version=*")
    removed = 0
    for status in files.globStatus(pattern):
        path = "/".join(["", SUMMARY_TABLE, *status.getPath().toString().split("/")[-3:]])
        if path not in named:
            removed += files.delete(status.getPath(), True)
    for number in set(numbers) - set(kept):
        files.delete(_path(spark, f"{root}/{SUMMARY_TABLE}/{_COMMITS}/{number:012d}")[1], False)
    return removed


def write_rejects(spark: SparkSession, root: str, rejected: list[tuple[str, str, str]]) -> None:
    """What the last run left out: (billing_period, s3_key, error) of manifests and files."""
    spark.createDataFrame(rejected, REJECTS).coalesce(1).write.mode("overwrite").parquet(f"{root}/{REJECT_TABLE}")


def read_rejects(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/{REJECT_TABLE}", REJECTS)


def note_pending(spark: SparkSession, root: str, days: Iterable[date | None]) -> None:
    """Remember days whose summary is about to be out of date."""
    noted = spark.createDataFrame([(day,) for day in days], PENDING)
    noted.coalesce(1).write.mode("append").parquet(f"{root}/{PENDING_TABLE}")


def read_pending(spark: SparkSession, root: str) -> list[date]:
    """Days noted by runs that broke off."""
    return [row["day"] for row in read_table(spark, f"{root}/{PENDING_TABLE}", PENDING).distinct().collect()]


def clear_pending(spark: SparkSession, root: str) -> None:
    files, where = _path(spark, f"{root}/{PENDING_TABLE}")
    files.delete(where, True)


def count_summary(
    spark: SparkSession, root: str, data_source: str = EXPORT_SOURCE, start: date | None = None, end: date | None = None
) -> int:
    """Rows stored of one source; Parquet answers a count from footers."""
    return read_summary(spark, root, start, end, data_source).count()
