"""Robust statistics over an array column, as SQL expressions.

Arguments and results are expression text, so that a whole kernel is handed to
Spark in one piece. Medians are the mean of the two middle values when the count
is even. Each builder binds its intermediate arrays once, so a sort is never
evaluated twice.
"""

from __future__ import annotations

from ledgerloom.fixed_values import (
    DRIFT_SEVERITY,
    FLAT_MAD,
    FLAT_Z,
    POINT_SEVERITY,
    Z_FACTOR,
)


def median_of(values: str) -> str:
    """Median of an array of doubles; NULL for an empty one."""
    return (
        f"get(transform(array(sort_array({values})), sorted -> "
        "(get(sorted, shiftright(size(sorted) - 1, 1)) + get(sorted, shiftright(size(sorted), 1)))"
        " / 2), 0)"
    )


def mad_of(values: str, median: str) -> str:
    """Median of the absolute deviations from ``median``, unscaled."""
    return median_of(f"transform({values}, v -> abs(v - {median}))")


def theil_sen(values: str) -> str:
    """Median slope over all pairs of positions; NULL below two values.

    Positions are ordinal: a missing day is not a gap of two.
    """
    slopes = (
        f"flatten(transform(sequence(0, size({values}) - 2), i -> "
        f"transform(sequence(i + 1, size({values}) - 1), j -> "
        f"(get({values}, j) - get({values}, i)) / (j - i))))"
    )
    return f"CASE WHEN size({values}) >= 2 THEN {median_of(slopes)} END"


def robust_z(value: str, median: str, mad: str, min_change: float) -> str:
    """Modified z-score; a jump off a flat baseline scores a fixed +-10."""
    return (
        f"CASE WHEN {mad} >= {FLAT_MAD!r} THEN {Z_FACTOR}D * ({value} - {median}) / {mad} "
        f"WHEN NOT abs({value} - {median}) > {float(min_change)!r}D THEN 0D "
        f"WHEN {value} > {median} THEN {FLAT_Z}D ELSE -{FLAT_Z}D END"
    )


def _severity(score: str, bounds: tuple[float, float]) -> str:
    critical, warning = bounds
    return (
        f"CASE WHEN abs({score}) > {critical}D THEN 'critical' "
        f"WHEN abs({score}) > {warning}D THEN 'warning' ELSE 'info' END"
    )


def point_severity(z: str) -> str:
    return _severity(z, POINT_SEVERITY)


def drift_severity(drift: str) -> str:
    return _severity(drift, DRIFT_SEVERITY)


def direction(score: str, up: str, down: str) -> str:
    return f"CASE WHEN {score} > 0 THEN '{up}' ELSE '{down}' END"


def severity_rank(severity: str) -> str:
    """0 for critical, 1 for warning, 2 for info."""
    return f"CASE {severity} WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
