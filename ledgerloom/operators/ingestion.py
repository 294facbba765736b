"""Deciding what to ingest, and ingesting it."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ledgerloom.checks import month_period
from ledgerloom.functions.dates import instant, islands, period_start
from ledgerloom.operators.summary import summarize_line_items
from ledgerloom.sources import day_index, tables
from ledgerloom.sources.billing_files import (
    Group,
    count_readable,
    examine_exports,
    group_by_types,
    list_files,
    read_footers,
    scan_exports,
)
from ledgerloom.sources.manifests import (
    latest_manifests,
    parse_manifests,
    read_manifest_files,
    rejected_manifests,
    report_keys,
)


def latest_assemblies(log: DataFrame) -> DataFrame:
    """(billing_period, assembly_id): the assembly ingested last, ties by id."""
    return log.groupBy("billing_period").agg(
        F.max_by("assembly_id", F.struct("ingested_at", "assembly_id")).alias("assembly_id")
    )


def ingest_plan(
    keys: DataFrame, log: DataFrame, *, month: str | None = None, full_refresh: bool = False
) -> DataFrame:
    """(billing_period, assembly_id, s3_key, action) for every file of a manifest.

    ``skip``: this file of this assembly is in the log. ``replace``: the period
    holds another assembly, whose rows go first, or a full refresh is wanted.
    ``load``: anything else, among it a file that failed before.
    """
    if month:
        keys = keys.filter(F.col("billing_period") == month_period(month))
    held = latest_assemblies(log).withColumnRenamed("assembly_id", "held_assembly")
    logged = (
        log.select("billing_period", "assembly_id", "s3_key")
        .distinct()
        .withColumn("logged", F.lit(True))
    )
    other = F.col("held_assembly").isNotNull() & (F.col("held_assembly") != F.col("assembly_id"))
    action = (
        F.when(F.lit(full_refresh) | other, "replace").when(F.col("logged"), "skip").otherwise("load")
    )
    return (
        keys.join(held, "billing_period", "left")
        .join(logged, ["billing_period", "assembly_id", "s3_key"], "left")
        .select("billing_period", "assembly_id", "s3_key", action.alias("action"))
    )


def replace_periods(line_items: DataFrame, loaded: DataFrame) -> DataFrame:
    """Line items with whole billing periods replaced by those in ``loaded``.

    What ``loaded`` covers is decided by its period starts: the rows of one
    assembly take the place of all earlier rows of the period.
    """
    covered = loaded.select("billing_period_start").distinct()
    kept = line_items.join(covered, "billing_period_start", "left_anti")
    return kept.unionByName(loaded)


def delete_period(line_items: DataFrame, billing_period: str) -> DataFrame:
    """Line items without those of one billing period."""
    start = period_start(F.lit(billing_period))
    return line_items.filter(~F.col("billing_period_start").eqNullSafe(start))


def log_entries(
    line_items: DataFrame, files: DataFrame, ingested_at: datetime | None = None
) -> DataFrame:
    """Log rows of ``files`` (billing_period, assembly_id, s3_key) with their row counts."""
    counts = line_items.groupBy(F.col("_source_file").alias("s3_key")).agg(
        F.count("*").alias("rows_loaded")
    )
    return counted_entries(counts, files, ingested_at)


def counted_entries(counts: DataFrame, files: DataFrame, ingested_at: datetime | None = None) -> DataFrame:
    """Log rows of ``files`` with the row counts of ``counts`` (s3_key, rows_loaded), 0 for files that are not there."""
    return files.join(counts, "s3_key", "left").select(
        "assembly_id",
        "billing_period",
        "s3_key",
        F.coalesce("rows_loaded", F.lit(0)).cast("long").alias("rows_loaded"),
        instant(ingested_at or datetime.now(timezone.utc)).alias("ingested_at"),
    )


def judge_exports(
    spark: SparkSession, keys: DataFrame, root: str
) -> tuple[list[Group], list[Row]]:
    """Groups of files, and a verdict on each file. Only files that tasks could not judge have their footer opened by the driver.

    ``keys`` holds the files that are to be loaded now; a scan needs their paths on the driver, as Spark's own listing does.
    """
    names = [row["s3_key"] for row in keys.select("s3_key").distinct().collect()]
    there = {
        row["s3_key"]
        for row in keys.join(list_files(spark, root).select(F.col("key").alias("s3_key")), "s3_key", "left_semi").collect()
    }
    groups = group_by_types(spark, [f"{root}/{name}" for name in sorted(names) if name in there])
    verdicts = {row["s3_key"]: row for row in examine_exports(spark, keys, root, groups).collect()}
    unclear = [name for name, row in verdicts.items() if row["error"] is None and row["generation"] is None]
    footers = read_footers(spark, [f"{root}/{name}" for name in unclear])
    part_of = {path: part for part, group in enumerate(groups) for path in group.paths}
    for name in unclear:
        footer, path = footers[f"{root}/{name}"], f"{root}/{name}"
        verdicts[name] = Row(
            s3_key=name, part=part_of.get(path), generation=footer.generation, rows=verdicts[name]["rows"] or 0, error=footer.error
        )
    return groups, [verdicts[name] for name in sorted(verdicts)]


def broken_files(spark: SparkSession, groups: Sequence[Group], verdicts: Iterable[Row], root: str) -> list[Row]:
    """The accepted files of which some column cannot be read to the end, with ``error``. Reads every mapped column."""
    expected = {row["s3_key"]: row for row in verdicts if row["error"] is None}
    broken = []
    for part, group in enumerate(groups):
        own = [f"{root}/{name}" for name, row in expected.items() if row["part"] == part]
        if not own or not group.schema.names:
            continue
        got = {row["s3_key"]: row["read"] for row in count_readable(spark, group, own, root).collect()}
        for path in own:
            name = path.removeprefix(f"{root}/")
            row = expected[name]
            if got.get(name, 0) < row["rows"]:
                error = f"only {got.get(name, 0)} of {row['rows']} rows can be read"
                broken.append(Row(**{**row.asDict(), "error": error}))
    return broken


def read_exports(spark: SparkSession, keys: DataFrame, root: str) -> DataFrame:
    """Line items of the given files (s3_key); raises if any of them is unusable."""
    groups, verdicts = judge_exports(spark, keys, root)
    for row in verdicts:
        if row["error"]:
            raise ValueError(f"cannot load {row['s3_key']}: {row['error']}")
    return scan_exports(spark, groups, verdicts, root)


@dataclass
class IngestReport:
    """Outcome of one ingestion run."""

    rows_loaded: int = 0
    summary_rows: int = 0
    periods: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    errors: list[tuple[str, str]] = field(default_factory=list)
    rejected_manifests: list[tuple[str, str, str]] = field(default_factory=list)


def ingest_exports(
    spark: SparkSession,
    export_root: str,
    table_root: str,
    *,
    month: str | None = None,
    full_refresh: bool = False,
) -> IngestReport:
    """Bring the tables up to date with the exports below ``export_root``.

    Bad manifests and files are reported, kept in the table of rejects until a run gets by without them, and
    left out. Whether a file is good is found out by tasks; all accepted files of all periods are loaded by
    one write, and only the days whose line items came or went are summarized again. The driver handles one
    short row per file that is to be loaded.

    The log is written last and is what makes a file count as loaded. A run that
    broke off leaves line items no log entry accounts for, and notes of the days
    it touched; the next run finds both, reloads those periods and summarizes
    those days.
    """
    root = export_root.rstrip("/")
    parsed = parse_manifests(latest_manifests(read_manifest_files(spark, root)))
    report = IngestReport()
    wanted = month_period(month) if month else None
    for row in rejected_manifests(parsed).collect():
        if wanted in (None, row["billing_period"]):
            report.rejected_manifests.append(tuple(row))
            report.errors.append((row["manifest_key"], row["error"]))
    log = tables.read_log(spark, table_root)
    plan = ingest_plan(report_keys(parsed), log, month=month, full_refresh=full_refresh).collect()

    todo = [row for row in plan if row["action"] != "skip"]
    clear = {row["billing_period"] for row in todo if row["action"] == "replace"}
    clear |= _unlogged_periods(spark, table_root, log, {r["billing_period"] for r in todo} - clear)
    todo = [row for row in plan if row["billing_period"] in clear or row["action"] == "load"]
    report.skipped = sorted({row["s3_key"] for row in plan} - {row["s3_key"] for row in todo})

    keys = spark.createDataFrame([(row["s3_key"],) for row in todo], "s3_key string")
    groups, verdicts = judge_exports(spark, keys, root) if todo else ([], [])
    try:
        _load(spark, root, table_root, log, todo, clear, groups, verdicts, report)
    except (PySparkException, Py4JJavaError):
        # Pages in the middle of a file may be damaged, which only reading them all shows: leave such files out.
        broken = {row["s3_key"]: row for row in broken_files(spark, groups, verdicts, root)}
        if not broken:
            raise
        verdicts = [broken.get(row["s3_key"], row) for row in verdicts]
        _load(spark, root, table_root, log, todo, clear, groups, verdicts, report)
    tables.clear_pending(spark, table_root)
    report.summary_rows = tables.count_summary(spark, table_root)
    return report


def _load(spark, root, table_root, log, todo, clear, groups, verdicts, report: IngestReport) -> None:
    """Load the accepted files of ``todo``; note the others as rejects."""
    judged = {row["s3_key"]: row for row in verdicts}
    files = [
        (row["billing_period"], row["assembly_id"], row["s3_key"]) for row in todo if judged[row["s3_key"]]["error"] is None
    ]
    rejected = [
        (row["billing_period"], row["s3_key"], judged[row["s3_key"]]["error"]) for row in todo if judged[row["s3_key"]]["error"]
    ]
    report.errors = [found for found in report.errors if found[0] not in judged] + [found[1:] for found in rejected]
    tables.write_rejects(spark, table_root, [*report.rejected_manifests, *rejected])
    if report.errors and not files:
        raise ValueError(f"nothing could be loaded: {report.errors}")

    touched = set(tables.read_pending(spark, table_root))
    if files:
        report.periods = sorted({period for period, _, _ in files})
        # a period of which no new file is usable keeps what it has
        replaced = sorted(clear & set(report.periods))
        listed = spark.createDataFrame(
            files, "billing_period string, assembly_id string, s3_key string"
        )
        rows = _with_period(scan_exports(spark, groups, verdicts, root), listed)
        # Rows go by the file they came from: a file may hold rows of another period than its manifest's.
        held = _marked(tables.read_line_items(spark, table_root), log, listed, replaced)
        stale = held.filter("stale")
        gone, come = _touched_days(stale), _touched_days(rows)
        tables.note_pending(spark, table_root, gone | come)
        starts = [row[0] for row in stale.select("billing_period_start").distinct().collect()]
        tables.replace_line_items(spark, table_root, rows, held.filter("NOT stale").drop("stale"), starts)
        tables.drop_partitions(spark, f"{table_root}/{tables.LOG_TABLE}", "billing_period", replaced)
        day_index.index_line_items(spark, table_root)
        touched |= gone | come
    if touched:
        _summarize_days(spark, table_root, touched)
    if files:
        # The index has counted what is stored: the exports are not read again.
        tables.append_log(counted_entries(day_index.stored_counts(spark, table_root), listed), table_root)
        logged = tables.read_log(spark, table_root).join(listed, listed.columns, "left_semi")
        report.rows_loaded = logged.agg(F.sum("rows_loaded")).first()[0]


def _touched_days(line_items: DataFrame) -> set[date | None]:
    """The usage days of line items; None stands for those without one. As many as the calendar has, at most."""
    day = F.to_date("usage_start_date").alias("day")
    return {row["day"] for row in line_items.select(day).distinct().collect()}


def _summarize_days(spark: SparkSession, table_root: str, days: set[date | None]) -> None:
    """Bring the summary of the given days up to date.

    What a day has now is added up anew from its line items; files without a line item of these days are not opened. Taking the old sums off again would leave
    rounding errors behind, and no sum tells whether a cost was NULL.
    """
    ranges = islands(day for day in days if day is not None)
    rows = day_index.read_line_items_of(spark, table_root, ranges, undated=None in days)
    tables.write_rebuilt_days(summarize_line_items(rows), table_root, days)


def _with_period(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Line items whose missing period start is taken from the manifest of their file.

    ``files`` is the driver's own list of files: it fits there, so it may be
    broadcast, and line items are not shuffled.
    """
    periods = files.select(
        F.col("s3_key").alias("_source_file"),
        period_start(F.col("billing_period")).alias("manifest_start"),
    )
    return rows.join(F.broadcast(periods), "_source_file", "left").withColumn(
        "billing_period_start", F.coalesce("billing_period_start", "manifest_start")
    )


def _first_days(periods) -> list[date]:
    return [datetime.strptime(period[:8], "%Y%m%d").date() for period in periods]


def _of_periods(line_items: DataFrame, periods) -> DataFrame:
    return line_items.filter(F.col("billing_period_start").isin(_first_days(periods)))


def _unlogged_periods(
    spark: SparkSession, table_root: str, log: DataFrame, periods: set[str]
) -> set[str]:
    """Periods among those given that hold rows of a file the log does not know."""
    if not periods:
        return set()
    stored = _of_periods(tables.read_line_items(spark, table_root), periods).select(
        F.date_format("billing_period_start", "yyyyMMdd").alias("first_day"),
        F.col("_source_file").alias("s3_key"),
    ).distinct()
    unlogged = stored.join(log.select("s3_key").distinct(), "s3_key", "left_anti").select("first_day")
    left = {row["first_day"] for row in unlogged.distinct().collect()}
    return {period for period in periods if period[:8] in left}


def _marked(line_items: DataFrame, log: DataFrame, listed: DataFrame, periods: list[str]) -> DataFrame:
    """Stored line items with ``stale``: whether they make way for the files ``listed``.

    Those of a listed file do, those of a file logged for a period that is replaced, and those a broken
    run left in such a period, whose file no log knows.
    """
    old = log.withColumn("old", F.col("billing_period").isin(periods)).select("s3_key", "old")
    files = old.unionByName(listed.select("s3_key", F.lit(True).alias("old")))
    files = files.groupBy(F.col("s3_key").alias("_source_file")).agg(F.max("old").alias("old"))
    of_period = F.coalesce(F.col("billing_period_start").isin(_first_days(periods)), F.lit(False))
    marked = line_items.join(files, "_source_file", "left")
    return marked.withColumn("stale", F.coalesce("old", of_period)).drop("old")
