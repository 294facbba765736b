"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are put on an integer grid, ``x = floor(scale * c) + offset``, so that their number, sums and squared
deviations are exact. The centred rows make a tall matrix A that is never held: each step is one pass over the
stored rows, in which every task multiplies its rows by a few columns and adds up what comes back. Of a step's
right vector v, the pass gives A v, its products with all earlier left vectors, and their products with A
transposed; a left vector is always A times a short vector that the driver knows, so rows carry nothing from step to
step. Right and left vectors are orthogonalised against all earlier ones, a second time where a first one
cancels much. The small bidiagonal matrix's singular value decomposition gives components and deviations.

A run ends when the leading components have settled to rounding, or when its space is exhausted. As one start
vector shows only one component of each value that occurs several times, further runs start in the complement of
what is held, until one shows nothing larger than the last component wanted.

Sent to tasks: the sums and at most as many columns as steps were made, of the vectors' length. Sent to the driver: one
such row of sums per task, or per lane where there are many tasks.

Defined results: vectors that are null or hold a null or a non-finite entry are left out; entries beyond 2^62 on the grid stay there;
zero vectors, ties and repeated rows count as they are; vectors of each length are whitened by themselves; components whose
deviation is zero up to rounding (1e-10 of the whole) do not exist, so rows that are all alike have none; a null id is
an id; a sum of squares beyond a long is null; an empty table gives an empty table; further columns are kept, except that columns
named like a result are replaced.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Values below this share of the matrix's norm count as zero.
ZERO = 1e-10
#: Rows of partial sums that the driver gets at once; more tasks than that add up in lanes first.
LANES = 256
LIMIT = 2.0**62

RESULTS = ("n", "deviation", "whitened", "explained", "identity_error")


class Whitening(NamedTuple):
    """``values``: falling eigenvalues of the covariance; ``vectors``: its unit eigenvectors, as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int


def on_grid(df: DataFrame, vector: str, scale: int, offset: int) -> DataFrame:
    """Rows whose vector is usable, with ``__x``: its entries as longs."""
    entry = F.col(f"`{vector}`")
    finite = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    grid = F.transform(entry, lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale) + F.lit(float(offset)), F.lit(-LIMIT)), F.lit(LIMIT)).cast("long"))
    return df.filter(entry.isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("__x", grid)


def integers(batch, name: str = "__x") -> np.ndarray:
    """The rows' entries as a matrix; all rows have one length."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)


def deviations(x: np.ndarray, n: int, sums) -> np.ndarray:
    """``n * x - S`` exactly: as longs where they hold it, else as Python integers."""
    largest = int(max(x.max(initial=0), -x.min(initial=0))) * n + max((abs(s) for s in sums), default=0)
    if largest < 2**62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(np.float64)


def squares(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row; None beyond a long."""
    largest = max((abs(int(d.max())), abs(int(d.min())))) if d.size else 0
    if d.shape[1] * largest**2 >= 2**63:
        d = d.astype(object)
    return [int(v) if v < 2**63 else None for v in (d * d).sum(axis=1)]


def added(partial: DataFrame, tasks: int) -> np.ndarray:
    """The sum of the rows ``part, values`` of doubles, in the order of ``part``."""
    if tasks > LANES:

        def add(batches):
            total, lane = None, -1
            for batch in batches:
                for part, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total, lane = np.array(values) if total is None else total + values, part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([lane]), pa.array([total.tolist()])], ["part", "values"])

        lanes = partial.repartition(LANES, F.col("part") % LANES).sortWithinPartitions("part")
        partial = lanes.mapInArrow(add, "part long, values array<double>")
    rows = sorted((r["part"], r["values"]) for r in partial.collect())
    return sum((np.array(values) for _, values in rows[1:]), np.array(rows[0][1]))


def totals(fit: DataFrame) -> tuple[int, tuple[int, ...], int]:
    """How many rows, their sums by entry, and how many tasks had rows."""

    def add(batches):
        rows, total = 0, None
        for batch in batches:
            x = integers(batch)
            if len(x):
                exact = x if int(np.abs(x).max()) * len(x) < 2**62 else x.astype(object)
                part = [int(v) for v in exact.sum(axis=0)]
                rows, total = rows + len(x), part if total is None else [a + b for a, b in zip(total, part)]
        if rows:
            found = pa.array([[Decimal(v) for v in total]], pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.array([rows]), found], ["rows", "total"])

    parts = fit.mapInArrow(add, "rows long, total array<decimal(38,0)>")
    summed = parts.select("rows", F.posexplode("total").alias("at", "total")).groupBy("at").agg(
        F.sum("rows").alias("rows"), F.sum("total").alias("total"), F.count("*").alias("tasks")
    )
    found = sorted((r["at"], r["rows"], int(r["total"]), r["tasks"]) for r in summed.collect())
    return found[0][1], tuple(f[2] for f in found), found[0][3]


def passed(fit: DataFrame, n: int, sums, columns: np.ndarray, tasks: int, compute) -> np.ndarray:
    """One pass: what ``compute(C, C @ columns)`` gives for the centred rows C of each batch, added up."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                c = centred(integers(batch), n, sums)
                part = compute(c, c @ columns)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tolist()])], ["part", "values"])

    return added(fit.mapInArrow(run, "part long, values array<double>"), tasks)


def of_last(c, z):
    """Products of the last column with all columns, and with the rows."""
    return np.concatenate([z.T @ z[:, -1], c.T @ z[:, -1]])


def covariance_of(c, z):
    return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])


class Bidiagonalisation:
    """Singular values and right vectors of the centred rows, largest first."""

    def __init__(self, products, length: int, norm: float, components: int, seed: int = 0):
        self.products, self.length, self.norm, self.components = products, length, norm, components
        self.random = np.random.default_rng(seed)
        self.values, self.vectors = np.empty(0), np.empty((length, 0))
        self.passes = 0

    def orthogonal(self, v: np.ndarray, basis: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
        return v

    def run(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Values and vectors of a run in the complement of those held: the leading ones once ``wanted`` have settled, or all."""
        zero = ZERO * self.norm
        real = self.values > zero
        right = self.vectors
        # Left vectors are A times these columns; A transposed times left vectors.
        lefts, images = right[:, real] / self.values[real], right[:, real] * self.values[real]
        v = self.orthogonal(self.random.standard_normal(self.length), right)
        v /= np.linalg.norm(v)
        held, alphas, betas = right.shape[1], [], []
        while True:
            right = np.column_stack([right, v])
            w = v - betas[-1] * lefts[:, -1] if betas else v
            image, size = None, 0.0
            for _ in range(3):
                got = self.products(np.column_stack([lefts, w]))
                self.passes += 1
                along, before, image = got[: lefts.shape[1]], got[lefts.shape[1]], got[lefts.shape[1] + 1 :]
                w, image, size = w - lefts @ along, image - images @ along, before - along @ along
                if size >= before / 2:
                    break
            alpha = np.sqrt(max(size, 0.0))
            ended = alpha <= zero
            alphas.append(0.0 if ended else alpha)
            if not ended:
                lefts, images = np.column_stack([lefts, w / alpha]), np.column_stack([images, image / alpha])
                v = self.orthogonal(image / alpha - alpha * right[:, -1], right)
                beta = np.linalg.norm(v)
                ended = beta <= zero or right.shape[1] == self.length
            small = np.diag(alphas) + np.diag(betas, 1)
            q, values, z = np.linalg.svd(small)
            if ended:
                return values, right[:, held:] @ z.T
            settled = np.abs(q[-1]) * beta <= 2 * np.finfo(float).eps * max(values[0], self.values.max(initial=0.0))
            count = int(np.argmin(np.append(settled, False)))
            if count >= wanted:
                return values[:count], right[:, held:] @ z.T[:, :count]
            betas.append(beta)
            v = v / beta

    def find(self) -> None:
        while self.vectors.shape[1] < self.length:
            values, vectors = self.run(self.components if not len(self.values) else 1)
            enough = len(self.values) >= self.components and values[0] <= self.values[self.components - 1]
            vectors = self.orthogonal(vectors, self.vectors)
            order = np.argsort(-np.concatenate([self.values, values]), kind="stable")
            self.values = np.concatenate([self.values, values])[order]
            self.vectors = np.column_stack([self.vectors, vectors / np.linalg.norm(vectors, axis=0)])[:, order]
            if enough or values[0] <= ZERO * self.norm:
                break
        keep = min(self.components, int((self.values > ZERO * self.norm).sum()))
        self.values, self.vectors = self.values[:keep], self.vectors[:, :keep]


def fitted(fit: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float]:
    """The whitening of the rows ``__x``, none of another length, and the largest entry of |covariance of the whitened rows - identity|."""
    n, sums, tasks = totals(fit)
    length = len(sums)
    trace = passed(fit, n, sums, np.zeros((length, 0)), tasks, lambda c, z: np.array([(c * c).sum()]))[0]
    found = Bidiagonalisation(lambda columns: passed(fit, n, sums, columns, tasks, of_last), length, np.sqrt(trace), components)
    if trace > 0:
        found.find()
    vectors = found.vectors
    if vectors.size:
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, sums, found.values**2 / n, vectors, trace / n, found.passes)
    count = vectors.shape[1]
    if not count:
        return model, 0.0
    got = passed(fit, n, sums, vectors / np.sqrt(model.values), tasks, covariance_of)
    mean = got[:count] / n
    covariance = got[count:].reshape(count, count) / n - np.outer(mean, mean)
    return model, float(np.abs(covariance - np.eye(count)).max())


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` with ``deviation`` and ``whitened`` in place of ``__x``."""
    n, sums, columns = model.n, model.sums, model.vectors / np.sqrt(model.values)

    def run(batches):
        for batch in batches:
            x, at = integers(batch), batch.schema.get_field_index("__x")
            flat = (centred(x, n, sums) @ columns).ravel()
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * columns.shape[1], pa.int32()), pa.array(flat))
            deviation = pa.array(squares(deviations(x, n, sums)), pa.int64())
            others = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if i != at]
            yield pa.RecordBatch.from_arrays([c for _, c in others] + [deviation, whitened], [m for m, _ in others] + ["deviation", "whitened"])

    kept = [f for f in rows.schema.fields if f.name != "__x"]
    made = T.StructType([*kept, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, made)


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """The rows of ``df`` with a usable vector, and per row:

    ``n`` (rows fitted on), ``deviation`` (sum of ``(n * x - S)^2``), ``whitened`` (array of up to ``components`` doubles),
    ``explained`` (array: each component's share of the variance), ``identity_error``.
    """
    rows = on_grid(df.drop(*RESULTS), vector, scale, offset)
    length = F.size("__x")
    fit = stored(rows.select("__x"), "whitening")
    lengths = sorted(r[0] for r in fit.select(length).distinct().collect())
    results = []
    for d in lengths:
        own, own_fit = (x if len(lengths) == 1 else x.filter(length == d) for x in (rows, fit))
        if d:
            model, error = fitted(own_fit, components)
            done = transformed(own, model)
            explained = (model.values / model.trace).tolist() if len(model.values) else []
        else:
            model, error, explained = Whitening(own_fit.count(), (), np.empty(0), np.empty((0, 0)), 0.0, 0), 0.0, []
            done = own.drop("__x").withColumns({"deviation": F.lit(0).cast("long"), "whitened": F.array().cast("array<double>")})
        results.append(
            done.withColumns({"n": F.lit(model.n).cast("long"), "explained": F.lit(explained).cast("array<double>"), "identity_error": F.lit(error)})
        )
    if not results:
        none = {"n": "long", "deviation": "long", "whitened": "array<double>", "explained": "array<double>", "identity_error": "double"}
        return rows.drop("__x").filter("false").withColumns({c: F.lit(None).cast(kind) for c, kind in none.items()})
    whole = results[0]
    for more in results[1:]:
        whole = whole.unionByName(more)
    return whole
