"""Order statistics of a window that slides over a series, kept by insertion and removal.

The costs of the window and the slopes of all its pairs stay sorted while points come and go, so a
step sorts nothing: a new point adds its slopes to the others, the oldest takes its own away. Slopes
go by distance in positions, which sliding does not change. Values equal those of the array
expressions in `robust` to the last bit.

Shipped by value, so executors need numpy and pyarrow but not this package.
"""

from __future__ import annotations

import sys
from collections import deque

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def placed(ordered, values):
    """``ordered`` with the sorted ``values`` put in."""
    import numpy as np

    return np.insert(ordered, np.searchsorted(ordered, values), values)


def removed(ordered, values):
    """``ordered`` without the sorted ``values``, each of which it holds."""
    import numpy as np

    # Equal values are taken one after the other.
    repeat = np.arange(len(values)) - np.searchsorted(values, values)
    return np.delete(ordered, np.searchsorted(ordered, values) + repeat)


def middle(ordered) -> float:
    n = len(ordered)
    return float((ordered[(n - 1) >> 1] + ordered[n >> 1]) / 2)


def middle_deviation(ordered, center: float) -> float:
    """Median distance from ``center``; selected, not sorted."""
    import numpy as np

    n = len(ordered)
    low, high = (n - 1) >> 1, n >> 1
    chosen = np.partition(np.abs(ordered - center), (low, high))
    return float((chosen[low] + chosen[high]) / 2)


class Window:
    """The points of a window in order of time, with their sorted costs and slopes."""

    def __init__(self):
        import numpy as np

        self.points: deque = deque()
        self.costs, self.slopes = np.empty(0), np.empty(0)

    def _slopes_to(self, cost: float, sign: int):
        """Slopes between ``cost`` and the points held, which all come before it (1) or after it (-1)."""
        import numpy as np

        held = np.fromiter((c for _, c in self.points), float, len(self.points))
        if sign < 0:
            return np.sort((held - cost) / np.arange(1, len(held) + 1))
        return np.sort((cost - held) / np.arange(len(held), 0, -1))

    def push(self, day: int, cost: float) -> None:
        self.slopes = placed(self.slopes, self._slopes_to(cost, 1))
        self.costs = placed(self.costs, [cost])
        self.points.append((day, cost))

    def drop_before(self, day: int) -> None:
        while self.points and self.points[0][0] < day:
            _, cost = self.points.popleft()
            self.slopes = removed(self.slopes, self._slopes_to(cost, -1))
            self.costs = removed(self.costs, [cost])

    def measures(self) -> tuple[float, float, float]:
        """Median and median deviation of all but the last point, and the median slope of all."""
        baseline = removed(self.costs, [self.points[-1][1]])
        center = middle(baseline)
        return center, middle_deviation(baseline, center), middle(self.slopes)


def scan(series, start: int, end: int, days: int, least_points: int):
    """(ref day, last day, its cost, points, median, deviation, slope) of each scan day of one group.

    ``series`` holds (day, cost) by day. A window is judged on each day from ``start`` to ``end`` on which it
    holds ``least_points``, two at least.
    """
    window = Window()
    series = list(series)
    for at, (day, cost) in enumerate(series):
        window.drop_before(day - days)
        window.push(day, cost)
        following = series[at + 1][0] - 1 if at + 1 < len(series) else end
        known = None
        for ref in range(max(day, start), min(following, day + days, end) + 1):
            held = len(window.points)
            window.drop_before(ref - days)
            if len(window.points) < least_points:
                break
            if known is None or len(window.points) < held:
                known = window.measures()
            yield ref, day, cost, len(window.points), *known


def scan_batches(batches, keys: int, start: int, end: int, days: int, least_points: int, schema):
    """Arrow batches of ``keys`` columns, day number and cost, sorted by group and day, as batches of scans.

    A task holds one group's days at a time.
    """
    from itertools import groupby

    import pyarrow as pa

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    made = []
    for key, group in groupby(rows, key=lambda row: row[:keys]):
        for found in scan(((row[keys], row[keys + 1]) for row in group), start, end, days, least_points):
            made.append((*key, *found))
            if len(made) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
                made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)
