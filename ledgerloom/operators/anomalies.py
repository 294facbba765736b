"""Point and drift anomalies of daily cost, for one day or for a range of days."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerloom.checks import dimensions, ordered_range, positive, sensitivity_threshold
from ledgerloom.fixed_values import MIN_DRIFT_DAYS, MIN_POINT_DAYS
from ledgerloom.functions import robust, rolling
from ledgerloom.functions.dates import date_range, utc_today
from ledgerloom.functions.labels import group_label, group_value
from ledgerloom.model import SUMMARY_MEASURE
from ledgerloom.operators.filters import from_source, in_range
from ledgerloom.operators.totals import daily_costs

#: Days from which a scan keeps order statistics from one window to the next.
LONG_WINDOW = 45

_FINDING = (
    "usage_date",
    "current_cost",
    "median_cost",
    "mad",
    "z_score",
    "severity",
    "direction",
    "kind",
)


def _point_array(present: Column | None = None) -> Column:
    point = F.struct("usage_date", "cost")
    return F.collect_list(point if present is None else F.when(present, point))


def score_windows(
    windows: DataFrame,
    *,
    sensitivity: str = "medium",
    min_daily_cost: float = 1.0,
    drift_threshold: float = 0.20,
) -> DataFrame:
    """Findings of windows that hold ``points``, an array of (usage_date, cost) by date.

    The last point is judged against the earlier ones (point anomaly), and the
    slope over all points against their median (trend anomaly). A window yields
    up to two rows, its other columns kept.
    """
    kept = [c for c in windows.columns if c != "points"]
    measured = (
        windows.filter(
            f"size(points) >= {MIN_POINT_DAYS} "
            f"AND element_at(points, -1).cost >= {float(min_daily_cost)!r}D"
        )
        .selectExpr(
            *kept,
            "element_at(points, -1).usage_date AS usage_date",
            "element_at(points, -1).cost AS current_cost",
            "points.cost AS costs",
            "slice(points.cost, 1, size(points) - 1) AS baseline",
        )
        .selectExpr("*", f"{robust.median_of('baseline')} AS median_cost")
        .selectExpr("*", f"{robust.mad_of('baseline', 'median_cost')} AS mad")
    )
    return _judged(
        measured,
        kept,
        "size(costs)",
        robust.theil_sen("costs"),
        sensitivity,
        min_daily_cost,
        drift_threshold,
    )


def _judged(
    measured: DataFrame,
    kept: list[str],
    points: str,
    slope: str,
    sensitivity: str = "medium",
    min_daily_cost: float = 1.0,
    drift_threshold: float = 0.20,
) -> DataFrame:
    """Findings of windows with their last point, median and deviation.

    ``points`` and ``slope`` are expressions; the slope is evaluated only where a drift can be found.
    """
    threshold = sensitivity_threshold(sensitivity)
    drift = (
        f"CASE WHEN {points} >= {MIN_DRIFT_DAYS} AND median_cost > {float(min_daily_cost)!r}D "
        f"THEN {slope} * {points} / median_cost END"
    )
    judged = measured.selectExpr(
        "*",
        f"{robust.robust_z('current_cost', 'median_cost', 'mad', min_daily_cost)} AS z",
        f"{drift} AS drift",
    )
    point = (
        f"CASE WHEN abs(z) >= {threshold}D THEN struct(z AS z_score, "
        f"{robust.point_severity('z')} AS severity, "
        f"{robust.direction('z', 'spike', 'drop')} AS direction, 'point' AS kind) END"
    )
    trend = (
        f"CASE WHEN abs(drift) >= {float(drift_threshold)!r}D THEN struct(drift AS z_score, "
        f"{robust.drift_severity('drift')} AS severity, "
        f"{robust.direction('drift', 'drift_up', 'drift_down')} AS direction, 'trend' AS kind) END"
    )
    return judged.selectExpr(
        *kept,
        "usage_date",
        "current_cost",
        "median_cost",
        "mad",
        f"inline(array_compact(array({point}, {trend})))",
    )


def _report(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings with their group spelled out, keys dropped."""
    return findings.select(
        "usage_date",
        F.lit(group_label(keys)).alias("group_by"),
        group_value(keys).alias("group_value"),
        *_FINDING[1:],
    )


def detect_anomalies(
    summary: DataFrame,
    *,
    reference_date: date | None = None,
    days: int = 14,
    group_by: str | Iterable[str] = "product_code",
    data_source: str | None = None,
    measure: str = SUMMARY_MEASURE,
    **scoring,
) -> DataFrame:
    """Anomalies of the last present day in ``[reference_date - days, reference_date]``.

    Rows are added up per group and day first; the array collected per group is
    bounded by the days of the window. ``scoring`` goes to `score_windows`.
    """
    keys = dimensions(group_by)
    end = reference_date or utc_today()
    rows = from_source(in_range(summary, end - timedelta(days=days), end), data_source)
    windows = (
        daily_costs(rows, keys, measure)
        .groupBy(*keys)
        .agg(F.sort_array(_point_array()).alias("points"))
    )
    return _report(score_windows(windows, **scoring), keys)


def sliding_windows(
    summary: DataFrame,
    scan_start: date,
    scan_end: date,
    *,
    days: int = 14,
    group_by: str | Iterable[str] = "product_code",
    data_source: str | None = None,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """(keys…, ref_date, points): the window ``[ref_date - days, ref_date]`` of each scan day.

    A window exists on every day the group has data and on the ``days`` days
    after that, for as long as it holds a point. Both window functions run on
    the one shuffle by group; a point is never copied per window it falls in
    before that shuffle.
    """
    ordered_range(scan_start, scan_end, "scan")
    keys = dimensions(group_by)
    positive(days, "days")
    rows = from_source(
        in_range(summary, scan_start - timedelta(days=days), scan_end), data_source
    )
    daily = daily_costs(rows, keys, measure)
    following = F.lead("usage_date").over(Window.partitionBy(*keys).orderBy("usage_date"))
    last_ref = F.least(
        F.date_sub(following, 1), F.date_add("usage_date", days), F.lit(scan_end)
    )
    with_refs = (
        daily.withColumn("last_ref", last_ref)
        .withColumn("ref_date", F.explode(date_range(F.col("usage_date"), F.col("last_ref"))))
        .withColumn("ref_day", F.unix_date("ref_date"))
    )
    frame = Window.partitionBy(*keys).orderBy("ref_day").rangeBetween(-days, 0)
    return (
        with_refs.withColumn(
            "points", _point_array(F.col("ref_date") == F.col("usage_date")).over(frame)
        )
        .filter(F.col("ref_date") >= F.lit(scan_start))
        .select(*keys, "ref_date", "points")
    )


def rolling_windows(
    summary: DataFrame,
    scan_start: date,
    scan_end: date,
    *,
    days: int = 14,
    group_by: str | Iterable[str] = "product_code",
    data_source: str | None = None,
    measure: str = SUMMARY_MEASURE,
) -> DataFrame:
    """The windows of `sliding_windows` that can be judged, with their order statistics instead of points.

    (keys…, ref_date, usage_date, current_cost, points, median_cost, mad, slope). Groups are sorted by day once and
    streamed through tasks; a step of the window costs the number of its points, not of their pairs.
    """
    ordered_range(scan_start, scan_end, "scan")
    keys = dimensions(group_by)
    positive(days, "days")
    rows = from_source(
        in_range(summary, scan_start - timedelta(days=days), scan_end), data_source
    )
    daily = daily_costs(rows, keys, measure).select(
        *keys, F.unix_date("usage_date").alias("day"), F.col("cost").cast("double").alias("cost")
    )
    ordered = daily.repartition(*keys).sortWithinPartitions(*keys, "day")
    measures = ("current_cost double", "points int", "median_cost double", "mad double", "slope double")
    found = T.StructType.fromDDL(", ".join(("ref_day int", "last_day int", *measures)))
    schema = T.StructType([*(daily.schema[k] for k in keys), *found])
    arrow = to_arrow_schema(schema)
    first, last = ((d - date(1970, 1, 1)).days for d in (scan_start, scan_end))
    count = len(keys)

    def scanned(batches):
        return rolling.scan_batches(batches, count, first, last, days, MIN_POINT_DAYS, arrow)

    return ordered.mapInArrow(scanned, schema).select(
        *keys,
        F.date_from_unix_date("ref_day").alias("ref_date"),
        F.date_from_unix_date("last_day").alias("usage_date"),
        *found.names[2:],
    )


def scan_anomalies(
    summary: DataFrame,
    scan_start: date,
    scan_end: date,
    *,
    days: int = 14,
    group_by: str | Iterable[str] = "product_code",
    data_source: str | None = None,
    measure: str = SUMMARY_MEASURE,
    **scoring,
) -> DataFrame:
    """Anomalies of every day in a range, each streak of scan days reported once.

    A streak is a run of consecutive scan days on which a group shows the same
    kind of anomaly; its finding of greatest absolute score is kept, the earliest
    on a tie. Streaks are found inside the partitioning by group.

    The slope takes all pairs of a window's points. From ``LONG_WINDOW`` days on, windows are therefore
    slid by `rolling_windows`, which gives the same findings.
    """
    keys = dimensions(group_by)
    place = dict(days=days, group_by=keys, data_source=data_source, measure=measure)
    if days < LONG_WINDOW:
        windows = sliding_windows(summary, scan_start, scan_end, **place)
        findings = score_windows(windows, **scoring)
    else:
        least = float(scoring.get("min_daily_cost", 1.0))
        windows = rolling_windows(summary, scan_start, scan_end, **place)
        windows = windows.filter(F.col("current_cost") >= least)
        findings = _judged(windows, [*keys, "ref_date"], "points", "slope", **scoring)
    return _report(merge_streaks(findings, keys), keys)


def merge_streaks(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The strongest finding of every run of consecutive ``ref_date`` per keys and kind."""
    run = Window.partitionBy(*keys, "kind").orderBy("ref_date")
    streak = Window.partitionBy(*keys, "kind", "streak").orderBy(
        F.abs("z_score").desc(), F.col("ref_date")
    )
    return (
        findings.withColumn("streak", F.date_sub("ref_date", F.row_number().over(run)))
        .withColumn("place", F.row_number().over(streak))
        .filter(F.col("place") == 1)
        .drop("streak", "place", "ref_date")
    )


def days_scanned(scan_start: date, scan_end: date) -> int:
    ordered_range(scan_start, scan_end, "scan")
    return (scan_end - scan_start).days + 1


def by_severity(anomalies: DataFrame) -> DataFrame:
    """Critical first, then warning, then info; the strongest first within each."""
    return anomalies.orderBy(
        F.expr(robust.severity_rank("severity")),
        F.abs("z_score").desc(),
        "group_value",
        "kind",
        "usage_date",
    )


def with_drift_pct(anomalies: DataFrame) -> DataFrame:
    """Adds the drift in percent, NULL for point anomalies."""
    return anomalies.withColumn(
        "drift_pct", F.when(F.col("kind") == "trend", F.col("z_score") * 100)
    )
