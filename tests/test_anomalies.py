"""Detection and scans, against known series and against a day-by-day loop."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest

from conftest import days, rows_of
from ledgerloom.functions import rolling
from ledgerloom.operators import anomalies as ops

START, REF = date(2025, 1, 1), date(2025, 1, 15)


def linear(first, last, n=14):
    return np.linspace(first, last, n).tolist()


def found(make_summary, series, **options):
    rows = [(d, "111", "AmazonEC2", "r", c) for d, c in zip(days(START, len(series)), series)]
    return ops.detect_anomalies(make_summary(rows), reference_date=REF, **options).collect()


def only(rows, kind):
    (row,) = [r for r in rows if r["kind"] == kind]
    return row


def test_spike(make_summary):
    row = only(found(make_summary, [100] * 13 + [500]), "point")
    assert (row["direction"], row["current_cost"], row["median_cost"], row["z_score"], row["severity"]) == (
        "spike", 500.0, 100.0, 10.0, "critical")
    assert (row["usage_date"], row["group_by"], row["group_value"]) == (
        date(2025, 1, 14), "product_code", "AmazonEC2")


def test_drop(make_summary):
    row = only(found(make_summary, [500] * 13 + [50]), "point")
    assert (row["direction"], row["z_score"]) == ("drop", -10.0)


def test_below_least_cost(make_summary):
    assert found(make_summary, [0.01] * 13 + [0.5]) == []


def test_outlier_in_the_baseline_does_not_matter(make_summary):
    series = [100.0] * 13 + [300]
    series[10] = 500.0
    row = only(found(make_summary, series), "point")
    assert (row["direction"], row["median_cost"]) == ("spike", 100.0)


def test_flat_baseline(make_summary):
    row = only(found(make_summary, [100] * 13 + [200]), "point")
    assert (row["z_score"], row["mad"]) == (10.0, 0.0)


@pytest.mark.parametrize(
    "series, direction",
    [(linear(100, 140), "drift_up"), (linear(200, 100), "drift_down"), ([100] * 14, None),
     (linear(100, 110), None)],
)
def test_drift(make_summary, series, direction):
    trends = [r for r in found(make_summary, series) if r["kind"] == "trend"]
    assert [r["direction"] for r in trends] == ([direction] if direction else [])
    assert all(abs(r["z_score"]) > 0.20 for r in trends)


def test_spike_and_drift_of_one_group(make_summary):
    rows = found(make_summary, [100 + 2 * i for i in range(13)] + [300])
    assert sorted(r["kind"] for r in rows) == ["point", "trend"]
    with_pct = {r["kind"]: r["z_score"] for r in rows}
    assert with_pct["point"] > 2.5 and with_pct["trend"] > 0.2


def test_too_few_days(make_summary):
    assert found(make_summary, [100, 900]) == []
    rows = found(make_summary, [100, 100, 900])
    assert [r["kind"] for r in rows] == ["point"]
    # fewer than five days give no drift
    assert {r["kind"] for r in found(make_summary, [100, 200, 300, 400])} <= {"point"}


def test_no_data_and_invalid_group(make_summary):
    rows = make_summary([(START, "1", "p", "r", 1)])
    assert ops.detect_anomalies(rows, reference_date=date(2030, 1, 1)).isEmpty()
    with pytest.raises(ValueError):
        ops.detect_anomalies(rows, group_by="usage_type")


def test_several_dimensions(make_summary):
    rows = []
    for i, d in enumerate(days(START, 14)):
        rows += [(d, "111", "AmazonEC2", "r", 500 if i == 13 else 100),
                 (d, "222", "AmazonEC2", "r", 100), (d, "111", "AmazonS3", "r", 50)]
    (row,) = ops.detect_anomalies(
        make_summary(rows), reference_date=REF, group_by=["product_code", "usage_account_id"]
    ).collect()
    assert (row["group_by"], row["group_value"]) == (
        "product_code+usage_account_id", "AmazonEC2 / 111")


def test_masking(make_summary):
    rows = []
    for d, up, down in zip(days(START, 14), linear(100, 200), linear(100, 0.01)):
        rows += [(d, "111", "AmazonEC2", "r", up), (d, "222", "AmazonEC2", "r", down)]
    summary = make_summary(rows)
    assert ops.detect_anomalies(summary, reference_date=REF).isEmpty()
    finer = ops.detect_anomalies(
        summary, reference_date=REF, group_by=["product_code", "usage_account_id"])
    assert finer.count() >= 1


def test_null_measure_days_are_left_out(make_summary):
    from pyspark.sql import functions as F

    rows = make_summary([(d, "1", "p", "r", 100) for d in days(START, 10)])
    holed = rows.withColumn("total_net_amortized_cost", F.when(
        F.col("usage_date") < F.lit(date(2025, 1, 10)), F.col("total_net_amortized_cost")))
    assert ops.detect_anomalies(holed, reference_date=REF).isEmpty()


@pytest.fixture(scope="module")
def thirty_days(make_summary):
    rows = []
    for d in days(START, 30):
        rows += [(d, "1", "AmazonEC2", "r", 440 if d.day == 15 else 88), (d, "1", "AmazonS3", "r", 17.6)]
    return make_summary(rows)


def test_scan(thirty_days):
    got = ops.scan_anomalies(thirty_days, date(2025, 1, 10), date(2025, 1, 20)).collect()
    points = [r for r in got if r["kind"] == "point"]
    assert [(r["group_value"], r["usage_date"], r["direction"], r["z_score"], r["severity"]) for r in points] == [
        ("AmazonEC2", date(2025, 1, 15), "spike", 10.0, "critical")]
    later = ops.scan_anomalies(thirty_days, date(2025, 1, 20), date(2025, 1, 28))
    assert later.filter("kind = 'point'").isEmpty()
    assert ops.days_scanned(date(2025, 1, 10), date(2025, 1, 20)) == 11
    with pytest.raises(ValueError):
        ops.scan_anomalies(thirty_days, date(2025, 1, 20), date(2025, 1, 10))


def detect_loop(series, ref, window, threshold, least, drift_least):
    """One group on one day, straight from the definition."""
    points = sorted((d, c) for d, c in series.items() if ref - timedelta(window) <= d <= ref)
    if len(points) < 3 or points[-1][1] < least:
        return []
    costs = np.array([c for _, c in points])
    base, current = costs[:-1], costs[-1]
    median = float(np.median(base))
    mad = float(np.median(np.abs(base - median)))
    if mad < 1e-10:
        z = (10.0 if current > median else -10.0) if abs(current - median) > least else 0.0
    else:
        z = 0.6745 * (current - median) / mad
    out = [("point", points[-1][0], z)] if abs(z) >= threshold else []
    if len(costs) >= 5 and median > least:
        j, i = np.triu_indices(len(costs), k=1)
        drift = float(np.median((costs[j] - costs[i]) / (j - i))) * len(costs) / median
        if abs(drift) >= drift_least:
            out.append(("trend", points[-1][0], drift))
    return out


def scan_loop(groups, start, end, window=14, threshold=2.5, least=1.0, drift_least=0.2):
    active, finished = {}, []
    for n in range((end - start).days + 1):
        seen = set()
        for name, series in groups.items():
            for kind, day, score in detect_loop(series, start + timedelta(n), window, threshold, least, drift_least):
                seen.add((name, kind))
                held = active.get((name, kind))
                if held is None or abs(score) > abs(held[1]):
                    active[name, kind] = (day, score)
        for key in [k for k in active if k not in seen]:
            finished.append((*key, *active.pop(key)))
    return sorted(finished + [(*k, *v) for k, v in active.items()], key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_scan_against_a_day_loop(make_summary, seed):
    """Gaps, series that stop, negative and tiny costs, streaks that break."""
    rng = random.Random(seed)
    groups, rows = {}, []
    for g in range(8):
        series, level = {}, rng.uniform(0.5, 200)
        for n in range(rng.randint(20, 60)):
            if rng.random() < 0.25:
                continue
            level *= rng.uniform(0.9, 1.12)
            cost = round((level * (rng.choice([1, 1, 1, 6, 0.1])) - (3 if rng.random() < 0.05 else 0)) * 64) / 64
            series[START + timedelta(n)] = cost
        groups[f"g{g}"] = series
        rows += [(d, "1", f"g{g}", "r", c) for d, c in series.items()]
    span = (START + timedelta(5), START + timedelta(75))
    got = ops.scan_anomalies(make_summary(rows), *span)
    expected = scan_loop(groups, *span)
    assert rows_of(got, "group_value", "kind", "usage_date", "z_score") == expected
    assert len(expected) > 20


def test_rolling_window_against_all_pairs():
    """Gaps, ties, repeated costs; every measure equal to the last bit."""
    rng = random.Random(3)
    for days in (2, 7, 40):
        series = sorted({(n, rng.choice([0.1, 5.0, 5.0, rng.uniform(-9, 90)])) for n in rng.sample(range(150), 90)})
        series = list(dict(series).items())
        seen = {}
        for ref, day, cost, points, *measures in rolling.scan(series, 10, 160, days, 3):
            held = [(d, c) for d, c in series if ref - days <= d <= ref]
            costs = np.array([c for _, c in held])
            assert (day, cost, points) == (*held[-1], len(held))
            median = np.median(costs[:-1])
            j, i = np.triu_indices(len(costs), k=1)
            slope = np.median((costs[i] - costs[j]) / (i - j))
            assert measures == [median, np.median(np.abs(costs[:-1] - median)), slope]
            seen[ref] = True
        assert set(seen) == {r for r in range(10, 161) if sum(r - days <= d <= r for d, _ in series) >= 3}


@pytest.mark.parametrize("seed", range(2))
def test_rolling_scan_is_the_scan_by_arrays(make_summary, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(START + timedelta(n), "1", p, None if p == "b" else "r", round(rng.uniform(0.5, 200)) / 4)
            for p in "abc" for n in range(70) if rng.random() < 0.8]
    summary = make_summary(rows)
    span = (START + timedelta(5), START + timedelta(120))
    for by in ("product_code", ["region", "product_code"]):
        monkeypatch.setattr(ops, "LONG_WINDOW", 1000)
        expected = rows_of(ops.scan_anomalies(summary, *span, days=20, group_by=by, sensitivity="high"))
        monkeypatch.setattr(ops, "LONG_WINDOW", 1)
        got = rows_of(ops.scan_anomalies(summary, *span, days=20, group_by=by, sensitivity="high"))
        assert got == expected and got
    assert rows_of(ops.scan_anomalies(summary.limit(0), *span)) == []


def test_detection_is_the_scan_of_one_day(thirty_days):
    day = date(2025, 1, 15)
    assert rows_of(ops.detect_anomalies(thirty_days, reference_date=day)) == rows_of(
        ops.scan_anomalies(thirty_days, day, day))


def test_order_and_drift_pct(spark, make_summary):
    rows = []
    for i, d in enumerate(days(START, 14)):
        rows += [(d, "1", "a", "r", 100 + i % 3 if i < 13 else 104), (d, "1", "b", "r", 100 if i < 13 else 900),
                 (d, "1", "c", "r", 100 + 5 * i)]
    got = ops.with_drift_pct(ops.by_severity(ops.detect_anomalies(
        make_summary(rows), reference_date=REF, sensitivity="high"))).collect()
    rank = {"critical": 0, "warning": 1, "info": 2}
    order = [(rank[r["severity"]], -abs(r["z_score"])) for r in got]
    assert order == sorted(order) and len(got) >= 3
    for r in got:
        assert r["drift_pct"] == (r["z_score"] * 100 if r["kind"] == "trend" else None)
