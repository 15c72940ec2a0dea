"""Embedding whitening with a compensated covariance.

Entries become fixed-point integers, so the fit list (each distinct vector once), its size and
its sums are exact.  Tasks centre the vectors and add up their outer products in double-double
arithmetic: error-free transformations give each sum and product as a high and a low part, blocks
are added pairwise, and the parts of all tasks are merged, entry by entry, by the same sums.  What
reaches the driver is one matrix.  Its eigenvectors come from LAPACK's ``syevd`` (Householder
tridiagonalisation, then divide and conquer), which ``numpy.linalg.eigh`` calls, and are refined
against the low parts.

Edge cases: vectors that are null, or hold a null or non-finite entry, or one beyond what a long
can hold (a magnitude of 2 ** 62 after scaling), are dropped; a null id is kept; repeated rows are
each returned and count once in the fit; vectors of different lengths are fitted and whitened
apart; components without variance can't be whitened and give no rows (so a fit list of one
vector, or empty vectors, gives none); equal eigenvalues give any basis of their space, one for
all rows; a deviation beyond a long is an error; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash
from .runs import by_run

#: Elements of a block of outer products, so that its arrays stay in a core's cache.
BLOCK = 1 << 17
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error, exactly (factors are split into halves of 26 bits)."""

    def halves(x: np.ndarray) -> Pair:
        c = 134217729.0 * x
        high = c - (c - x)
        return high, x - high

    p, (a1, a2), (b1, b2) = a * b, halves(a), halves(b)
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add(x: Pair, y: Pair) -> Pair:
    """The double-double sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    e = e + (x[1] + y[1])
    high = s + e
    return high, e - (high - s)


def total(x: Pair) -> Pair:
    """The sum over the first axis, added pairwise."""
    while len(x[0]) > 1:
        half = len(x[0]) // 2
        rest = (x[0][2 * half :], x[1][2 * half :])
        x = add((x[0][:half], x[1][:half]), (x[0][half : 2 * half], x[1][half : 2 * half]))
        x = tuple(np.concatenate(p) for p in zip(x, rest))
    return x[0][0], x[1][0]


def outer_sums(c: Pair) -> Pair:
    """Sums of products of all pairs of columns (upper triangle) over the rows of a double-double matrix."""
    i, j = np.triu_indices(c[0].shape[1])
    out = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, BLOCK // max(len(i), 1))
    for at in range(0, len(c[0]), step):
        high, low = c[0][at : at + step], c[1][at : at + step]
        p, e = two_product(high[:, i], high[:, j])
        out = add(out, total((p, e + (high[:, i] * low[:, j] + low[:, i] * high[:, j]))))
    return out


def fixed_point(rows: DataFrame, vector: str, scale: int) -> DataFrame:
    """``rows`` whose vector takes part, with x: floor(scale * entry) as longs."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double") * scale) >= float(1 << 62)))
    return rows.where(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).withColumn("x", F.transform(v, lambda c: F.floor(c.cast("double") * scale)))


def matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, int64 matrix) for each length of vector in a batch; empty vectors are left out."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dims)
        some = column if len(at) == len(column) else column.take(pa.array(at))
        yield at, some.flatten().to_numpy().reshape(-1, dims)


@dataclass(frozen=True)
class Centre:
    """Size and sums of a fit list, and its mean as a double-double."""

    n: int
    sums: tuple[int, ...]

    def mean(self) -> Pair:
        exact = [Fraction(s, self.n) for s in self.sums]
        high = [float(m) for m in exact]
        return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high)])

    def centred(self, x: np.ndarray) -> Pair:
        high = x.astype(np.float64)
        low = (x - high.astype(np.int64)).astype(np.float64)
        mean = self.mean()
        return add((high, low), (-mean[0], -mean[1]))

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, exactly."""
        most = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        kind = np.int64 if x.shape[1] * most**2 < 2.0**62 else object
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        out = (d * d).sum(axis=1).tolist()
        if max(out, default=0) >= 1 << 63:
            raise OverflowError("a deviation doesn't fit a long")
        return out


@dataclass(frozen=True)
class Whitening:
    """What whitens vectors of one length: components as columns, by falling eigenvalue."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        return (high @ self.components + low @ self.components) / np.sqrt(self.values)


def centres(fit: DataFrame) -> dict[int, Centre]:
    """Exact sizes and sums of the fit list by length of vector; tasks return one row for each dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for at, x in matrices(batch.column(0)):
                upper, lower, n = held.get(x.shape[1], (0, 0, 0))
                held[x.shape[1]] = [upper + (x >> 32).sum(axis=0), lower + (x & 0xFFFFFFFF).sum(axis=0), n + len(at)]
        for dims, (upper, lower, n) in held.items():
            columns = [np.full(dims, dims), np.arange(dims), upper, lower, np.full(dims, n)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dims", "at", "upper", "lower", "n"])

    parts = fit.select("x").mapInArrow(sums, "dims long, at long, upper long, lower long, n long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("upper", "lower", "n")]
    out: dict[int, list] = {}
    for row in parts.groupBy("dims", "at").agg(*wide).orderBy("dims", "at").collect():  # one row for each dimension
        out.setdefault(row["dims"], []).append((int(row["upper"]) * (1 << 32) + int(row["lower"]), int(row["n"])))
    return {dims: Centre(s[0][1], tuple(v for v, _ in s)) for dims, s in out.items()}


def second_moments(fit: DataFrame, centred: dict) -> dict[int, Pair]:
    """Sums of outer products over the fit list, by length of vector; ``centred`` has a function for each length."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Pair] = {}
        for batch in batches:
            for _, x in matrices(batch.column(0)):
                dims = x.shape[1]
                if dims in centred:
                    found = outer_sums(centred[dims](x))
                    held[dims] = add(held[dims], found) if dims in held else found
        part = TaskContext.get().partitionId()
        for dims, (high, low) in held.items():
            named = [np.full(len(high), dims), np.arange(len(high)), np.full(len(high), part)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in named), pa.array(high), pa.array(low)], ["dims", "at", "part", "high", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in by_run(batches, ["dims", "at"]):
            high, low = total((run.column("high").to_numpy()[:, None], run.column("low").to_numpy()[:, None]))
            first = [run.column(c).slice(0, 1).combine_chunks() for c in ("dims", "at")]
            yield pa.RecordBatch.from_arrays([*first, pa.array(high), pa.array(low)], ["dims", "at", "high", "low"])

    parts = fit.select("x").mapInArrow(sums, "dims long, at long, part long, high double, low double")
    dealt = parts.repartition("dims", "at").sortWithinPartitions("dims", "at", "part")
    merged = dealt.mapInArrow(merge, "dims long, at long, high double, low double")
    out: dict[int, Pair] = {}
    for dims, rows in merged.toPandas().groupby("dims"):  # the entries of one triangle a length
        rows = rows.sort_values("at")
        out[int(dims)] = rows["high"].to_numpy(), rows["low"].to_numpy()
    return out


def symmetric(triangle: np.ndarray) -> np.ndarray:
    d = int((np.sqrt(8 * len(triangle) + 1) - 1) / 2)
    out = np.zeros((d, d), triangle.dtype)
    i, j = np.triu_indices(d)
    out[i, j] = out[j, i] = triangle
    return out


def eigen(v: np.ndarray, steps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a symmetric matrix of long doubles, by falling value.

    Each refinement step corrects the vectors by what is missing from orthogonality and from
    diagonality; vectors whose values are as near as the matrix is exact are only made orthogonal.
    """
    x = np.linalg.eigh(v.astype(np.float64))[1].astype(np.longdouble)
    unit = np.eye(len(v), dtype=np.longdouble)
    for _ in range(steps):
        r, s = unit - x.T @ x, x.T @ v @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        clear = np.abs(gap) > 2 * (np.abs(s - np.diag(values)).max() + np.abs(values).max() * np.abs(r).max() + np.finfo(np.float64).tiny)
        x = x + x @ np.where(clear, (s + values[None, :] * r) / np.where(clear, gap, 1), r / 2)
    values = np.diag(x.T @ v @ x)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def fit_whitening(rows: DataFrame, most: int) -> tuple[dict[int, Whitening], dict[int, float]]:
    """Whitenings of the distinct ``x`` of ``rows`` with up to ``most`` components, and their errors.

    The error is the largest entry of the whitened fit list's covariance minus the identity.
    """
    fit = stash(rows.select("x").distinct(), "fit")
    known = centres(fit)
    made = {}
    for dims, (high, low) in second_moments(fit, {d: c.centred for d, c in known.items()}).items():
        centre = known[dims]
        values, vectors = eigen(symmetric((high.astype(np.longdouble) + low) / centre.n))
        trace = values.sum()
        some = np.flatnonzero(values > trace * dims * np.finfo(np.float64).eps)[:most]
        if len(some):
            made[dims] = Whitening(centre, vectors[:, some].astype(np.float64), values[some].astype(np.float64), float(trace))

    def whitened(model: Whitening):
        def apply(x: np.ndarray) -> Pair:
            w = model.apply(x)
            return w, np.zeros_like(w)

        return apply

    errors = {}
    for dims, (high, _) in second_moments(fit, {d: whitened(m) for d, m in made.items()}).items():
        errors[dims] = float(np.abs(symmetric(high / made[dims].centre.n) - np.eye(len(made[dims].values))).max())
    discard(fit)
    return made, errors


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = fixed_point(rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), "v", scale).select("id", "x")
    models, errors = fit_whitening(rows, components)
    id_type = rows.schema["id"].dataType.simpleString()
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in matrices(batch.column(1)):
                if x.shape[1] not in models:
                    continue
                model = models[x.shape[1]]
                k = len(model.values)
                size = len(at) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(size, model.centre.n)),
                        pa.array(np.repeat(np.array(model.centre.deviations(x), np.int64), k)),
                        pa.array(model.apply(x).ravel()),
                        pa.array(np.tile(model.values / model.trace, len(at))),
                        pa.array(np.full(size, errors[x.shape[1]])),
                    ],
                    names,
                )

    kinds = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(apply, kinds)
