from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ledgerloom.functions import sentences

A, B = date(2025, 1, 1), date(2025, 1, 14)


def text(df, column):
    return [row["t"] for row in df.select(column.alias("t")).collect()]


def test_result_sentences(spark):
    stats = spark.sql("SELECT 2094.4D AS total, 149.6D AS average, 105.6D AS min_cost, 193.6D AS max_cost")
    assert text(stats, sentences.trend_sentence(A, B, "daily")) == [
        "Cost trend from 2025-01-01 to 2025-01-14 (daily): total $2,094.40, avg $149.60/period, "
        "range $105.60–$193.60."]
    drill = spark.sql("SELECT 305.0D AS total, 'BoxUsage' AS top UNION ALL SELECT 0.0D, NULL")
    assert text(drill, sentences.drill_down_sentence("AmazonEC2", A, B, F.col("total"), F.col("top"))) == [
        "$305.00 total for AmazonEC2 (2025-01-01 to 2025-01-14). Top usage type: BoxUsage.",
        "$0.00 total for AmazonEC2 (2025-01-01 to 2025-01-14). Top usage type: N/A."]
    change = spark.sql("SELECT 670.0D AS a, 1400.0D AS b, 1L AS c, 1L AS n, 2L AS g")
    assert text(change, sentences.attribution_sentence("AmazonEC2", *[F.col(c) for c in "abcng"])) == [
        "AmazonEC2 cost changed from $670.00 to $1,400.00 (+$730.00, +109.0%). "
        "1 changed, 1 new, 2 disappeared usage types."]
    count = spark.sql("SELECT 3L AS n")
    assert text(count, sentences.detection_sentence(F.col("n"), 14, "medium")) == [
        "3 anomalies detected over the last 14 days (sensitivity=medium)."]
    assert text(count, sentences.scan_sentence(F.col("n"), A, B)) == [
        "3 anomalies found scanning 2025-01-01 to 2025-01-14 (14 days)."]


def test_explanation_sentence(spark):
    rows = [("p", A, 440.0, 5.0, 88.0, 352.0, False, 3, 0), ("p", A, 440.0, 5.0, 88.0, 352.0, True, 7, 6),
            ("p", A, 88.0, 1.0, 88.0, 0.0, False, 0, 0)]
    df = spark.createDataFrame(
        rows, "service string, anomaly_date date, anomaly_cost double, cost_multiple double, "
        "baseline_median double, cost_vs_median double, is_ongoing boolean, days_after_checked int, "
        "elevated_days_after int")
    start = "p cost on 2025-01-01 was $440.00, which is 5.0x the baseline median of $88.00 (+$352.00)."
    assert text(df, sentences.explanation_sentence()) == [
        f"{start} Costs returned to normal within 3 days.",
        f"{start} Costs remained elevated for 6 of 7 days after.",
        "p cost on 2025-01-01 was $88.00, which is 1.0x the baseline median of $88.00 (+$0.00)."]
