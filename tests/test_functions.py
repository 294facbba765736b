from __future__ import annotations

import random
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import checks
from ledgerloom.functions import amounts, dates, labels, robust


def one(spark, sql):
    return spark.range(1).selectExpr(f"{sql} AS v").first()["v"]


def array(values):
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


@pytest.mark.parametrize(
    "values, low, high",
    [
        ([10, 20, 30, 40, 50], 10, 10),
        ([50, 40, 30, 20, 10], -10, -10),
        ([7, 7, 7, 7], 0, 0),
        ([0, 1, 100, 3, 4], 0.5, 2),
        ([5, 15], 10, 10),
    ],
)
def test_theil_sen(spark, values, low, high):
    assert low <= one(spark, robust.theil_sen(array(values))) <= high


def test_theil_sen_needs_two_values(spark):
    assert one(spark, robust.theil_sen(array([3]))) is None


def test_statistics_agree_with_numpy(spark):
    rng = random.Random(3)
    series = [[rng.uniform(0, 1000) for _ in range(rng.randint(2, 40))] for _ in range(200)]
    got = (
        spark.createDataFrame([(i, s) for i, s in enumerate(series)], "i int, c array<double>")
        .selectExpr("*", f"{robust.median_of('c')} AS m")
        .selectExpr(
            "i", "m", f"{robust.mad_of('c', 'm')} AS mad", f"{robust.theil_sen('c')} AS slope"
        )
        .collect()
    )
    for row in got:
        c = np.array(series[row["i"]])
        j, i = np.triu_indices(len(c), k=1)
        assert row["m"] == np.median(c)
        assert row["mad"] == np.median(np.abs(c - np.median(c)))
        assert row["slope"] == np.median((c[j] - c[i]) / (j - i))


def test_robust_z(spark):
    def z(value, median, mad, least=1.0):
        return one(spark, robust.robust_z(f"{value}D", f"{median}D", f"{mad}D", least))

    assert z(10, 4, 2) == 0.6745 * 6 / 2
    assert z(200, 100, 0) == 10.0
    assert z(50, 100, 0) == -10.0
    assert z(101, 100, 0) == 0.0
    assert z(103, 100, 0, 5) == 0.0


@pytest.mark.parametrize(
    "score, point, drift",
    [(4.5, "critical", "critical"), (4.0, "warning", "critical"), (3.0, "info", "critical"),
     (1.0, "info", "warning"), (0.5, "info", "info"), (-4.1, "critical", "critical"),
     (-0.6, "info", "warning")],
)
def test_severity(spark, score, point, drift):
    assert one(spark, robust.point_severity(f"{score}D")) == point
    assert one(spark, robust.drift_severity(f"{score}D")) == drift


def test_display_round_is_exact(spark):
    rng = random.Random(5)
    values = [0.125, 0.375, 2.675, 1.005, -2.5, 0.5, 1e7 + 0.005, 0.0] + [
        rng.uniform(-1e6, 1e6) for _ in range(500)
    ]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 4):
        for row in df.select("v", amounts.display_round(F.col("v"), digits).alias("r")).collect():
            assert row["r"] == round(row["v"], digits)


def test_amounts(spark):
    df = spark.createDataFrame(
        [(1234.5, 12.34, 100.0, 110.0), (None, None, 0.0, 5.0), (-3.0, -0.26, 10.0, 4.0)],
        "m double, p double, a double, b double",
    )
    got = df.select(
        amounts.money_text(F.col("m")).alias("money"),
        amounts.pct_text(F.col("p")).alias("pct"),
        amounts.pct_change(F.col("b") - F.col("a"), F.col("a")).alias("change"),
        amounts.pct_of_total(F.col("b"), F.col("a")).alias("share"),
        amounts.change_text("Total", F.col("a"), F.col("b")).alias("text"),
    ).collect()
    assert [r["money"] for r in got] == ["$1,234.50", "—", "$-3.00"]
    assert [r["pct"] for r in got] == ["+12.3%", "—", "-0.3%"]
    assert [r["change"] for r in got] == [10.0, None, -60.0]
    assert [r["share"] for r in got] == [pytest.approx(110.0), 0.0, 40.0]
    assert got[0]["text"] == "Total cost changed from $100.00 to $110.00 (+$10.00, +10.0%)."
    assert got[1]["text"] == "Total cost changed from $0.00 to $5.00 (+$5.00)."


def test_dates(spark):
    df = spark.createDataFrame([(date(2024, 12, 15),)], "d date")
    day = F.col("d")
    row = df.select(
        dates.trunc_period(day, "week").alias("week"),
        dates.month_start(day).alias("month"),
        dates.billing_period(day).alias("period"),
        dates.period_start(dates.billing_period(day)).alias("start"),
        dates.date_range(day, F.date_add(day, 2)).alias("days"),
        dates.date_range(day, F.date_sub(day, 1)).alias("none"),
        dates.compact_period(F.lit("2025-01-01T00:00:00.000Z"), F.lit("2025-02-01")).alias("c"),
    ).first()
    assert row["week"] == date(2024, 12, 9)
    assert row["month"] == row["start"] == date(2024, 12, 1)
    assert row["period"] == "20241201-20250101"
    assert row["days"] == [date(2024, 12, 15), date(2024, 12, 16), date(2024, 12, 17)]
    assert row["none"] == []
    assert row["c"] == "20250101-20250201"


def test_instants_between_takes_whole_days(spark):
    stamps = [datetime(2025, 1, 1), datetime(2025, 1, 2, 23, 59, 59), datetime(2025, 1, 3)]
    df = spark.createDataFrame([(s,) for s in stamps], "t timestamp_ntz")
    kept = df.filter(dates.instants_between("t", date(2025, 1, 1), date(2025, 1, 2)))
    assert kept.count() == 2


def test_labels(spark):
    df = spark.createDataFrame([("a", None), ("", "b")], "x string, y string")
    got = df.select(
        labels.group_value(["x", "y"]).alias("g"), labels.unknown_label(F.col("y")).alias("u")
    ).collect()
    assert [tuple(r) for r in got] == [("a / None", "unknown"), ("unknown / b", "b")]
    names = spark.createDataFrame(
        [("AWS Lambda",), ("AWS Key Management Service",), ("Other",)], "n string"
    )
    codes = [r[0] for r in names.select(labels.service_code(F.col("n"))).collect()]
    assert codes == ["AWSLambda", "awskms", "Other"]


def test_checks():
    assert checks.dimensions("region") == ["region"]
    for wrong in ("resource_id", [], ["region", "x"]):
        with pytest.raises(ValueError):
            checks.dimensions(wrong)
    assert checks.sensitivity_threshold("low") == 3.0
    assert checks.sensitivity_threshold("whatever") == 2.5
    assert [checks.threshold_label(t) for t in (3.2, 3.0, 2.5, 2.4)] == [
        "low", "low", "medium", "high"]
    assert checks.month_period("2024-12") == "20241201-20250101"
    for wrong in ("2024-13", "2024-00", "24-01", "2024-1"):
        with pytest.raises(ValueError):
            checks.month_period(wrong)
    assert checks.group_columns("service+account") == ("product_code", "usage_account_id")
    assert checks.source_tag("all") is None and checks.source_tag("cost-explorer") == "cost_explorer"
    with pytest.raises(ValueError):
        checks.ordered_range(date(2025, 1, 2), date(2025, 1, 1))
