"""Embedding whitening by spectrum slicing.

Each entry c of a vector becomes the integer x = floor(256 c).  The fit list is each distinct x vector once; its
sums are exact integers, its covariance V is summed over centred vectors by partial matrices of the tasks.

The leading eigenvalues of V come from inertia counts: V - s I = L D L', and by Sylvester's law D has as many
positive entries as V has eigenvalues above s.  V is brought to tridiagonal form by reflections once, which leaves
every inertia as it is, so a count takes d steps.  Bisection by these counts isolates the k-th largest
eigenvalue in an interval of its own; a few steps of inverse iteration in its middle and then Rayleigh
quotient iteration on V itself, which converges cubically, give the eigenvector.  Counts on
both sides of the Rayleigh quotient certify that it is the k-th eigenvalue; if they don't, the
interval is halved again and the iteration repeated.  Eigenvalues too near to be told apart (within ``TIE`` of
the largest) share an interval, and their vectors are kept orthogonal to each other.

Bounds: the driver holds matrices of d x d numbers, d the length of a vector, never rows.  A task holds an Arrow
batch and one such matrix.

Cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; vectors of each length have a
fit of their own (n, sums and components); an empty vector has no component; an eigenvalue that is zero
(at most ``ZERO`` of the trace) has none either, so one distinct vector alone gives no rows; ids may be null or
repeated (a row each); an entry beyond 2^53 / 256 in size is taken as +-2^53; a deviation that is no
64-bit integer is null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics.llm.common import materialize

#: Components returned at most.
COMPONENTS = 4
#: Shares of the largest eigenvalue within which two count as equal, and of the trace under which one is zero.
TIE, ZERO = 1e-13, 1e-13
#: Largest size of an integer entry.
MOST = 1 << 53

FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def tridiagonal(v: np.ndarray) -> tuple[list[float], list[float]]:
    """The diagonals of T = Q' V Q (Householder reflections): T - s I has the inertia of V - s I for every s."""
    a = v.astype(np.float64).copy()
    for k in range(len(a) - 2):
        u = a[k + 1:, k].copy()
        size = float(np.linalg.norm(u))
        if size == 0.0:
            continue
        u[0] += np.copysign(size, u[0])
        u /= np.linalg.norm(u)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        w = 2 * (p - (u @ p) * u)
        rest -= np.outer(u, w) + np.outer(w, u)
        a[k + 1:, k] -= 2 * (u @ a[k + 1:, k]) * u
    return a.diagonal().tolist(), a.diagonal(-1).tolist()


def above(t: tuple[list[float], list[float]], s: float) -> int:
    """The number of eigenvalues greater than ``s``: the positive entries of D in T - s I = L D L'."""
    least = 2.0 ** -53 * max(map(abs, [*t[0], *t[1], 1e-300]))
    n, pivot = 0, 1.0
    for a, b in zip(t[0], [0.0, *t[1]]):
        pivot = a - s - b * b / pivot
        if abs(pivot) < least * 2.0 ** -20:
            pivot = -least * 2.0 ** -20
        n += pivot > 0
    return n


def rayleigh(v: np.ndarray, x: np.ndarray, shift: float, before: list[np.ndarray], steps: int = 30) -> tuple[float, np.ndarray]:
    """An eigenpair near ``shift``: inverse iteration first, then shifts by the Rayleigh quotient."""
    size, best = float(np.abs(v).max()), (np.inf, shift, x)
    for k in range(steps):
        m = v - shift * np.eye(len(v))
        try:
            y = np.linalg.solve(m, x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            y = np.linalg.solve(m + size * 2.0 ** -52 * np.eye(len(v)), x)
        for _ in range(2):
            for b in before:
                y = y - (b @ y) * b
            y = y / np.linalg.norm(y)
        rho = float(y @ (v @ y))
        off = float(np.linalg.norm(v @ y - rho * y))
        if off < best[0]:
            best = (off, rho, y)
        elif k > 6:
            break
        x = y
        if k >= 3:
            shift = rho
    return best[1], best[2]


def leading(v: np.ndarray, most: int = COMPONENTS) -> list[tuple[float, np.ndarray]]:
    """The ``most`` largest eigenvalues above zero with unit eigenvectors, largest first."""
    trace = float(np.trace(v))
    if not len(v) or not trace > 0:
        return []
    bound, floor, t = float(np.abs(v).sum(1).max()), ZERO * trace, tridiagonal(v)
    most = min(most, above(t, floor))
    found: list[tuple[float, np.ndarray]] = []
    counts: dict[float, int] = {}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = above(t, s)
        return counts[s]

    for k in range(1, most + 1):
        low, high = floor, bound * (1 + 1e-9)  # more than k - 1 eigenvalues lie above low, fewer than k above high
        for s in counts:
            low, high = (max(low, s), high) if counts[s] >= k and s < high else (low, min(high, s)) if counts[s] < k and s > low else (low, high)
        narrow = 0.1
        while True:
            own = count(low) == k and count(high) == k - 1
            if (own and high - low <= narrow * bound) or high - low <= TIE * bound:
                start = np.cos(np.arange(1, len(v) + 1) * (k + 0.5)) + 1.5
                value, vector = rayleigh(v, start, (low + high) / 2, [x for _, x in found])
                slack = max(64 * len(v) * 2.0 ** -53, TIE) * bound
                # Certified: fewer than k eigenvalues lie above it, at least k not below it.
                if low - slack <= value <= high + slack and count(value + slack) < k <= count(value - slack):
                    break
                if high - low <= TIE * bound:
                    raise ArithmeticError(f"no certified eigenvector {k} between {low} and {high}")
                narrow /= 16
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) >= k else (low, middle)
        found.append((value, vector))
    return found


def integers(entries: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(entries.astype(np.float64) * 256.0), -MOST, MOST).astype(np.int64)


def usable(column: pa.Array) -> np.ndarray:
    """A mask of the vectors that are neither null nor hold a null or non-finite entry."""
    entry = pc.list_flatten(column)
    bad = np.asarray(pc.fill_null(pc.invert(pc.is_finite(entry.cast(pa.float64()))), True)).astype(np.int64)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    end = np.cumsum(size)
    total = np.concatenate([[0], np.cumsum(bad)])
    return (total[end] - total[end - size] == 0) & ~np.asarray(column.is_null())


def by_length(column: pa.Array):
    """(rows, matrix of x) for the vectors of each length; unusable and empty vectors are in none."""
    size = np.where(usable(column), np.asarray(pc.fill_null(pc.list_value_length(column), 0)), 0)
    for d in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, integers(np.asarray(pc.list_flatten(column.take(pa.array(rows)))).reshape(len(rows), d))


def distinct_vectors(rows: DataFrame, vec_col: str) -> DataFrame:
    """``d``, ``x``: each distinct integer vector once, its entries as packed 64-bit numbers."""
    def run(batches):
        for b in batches:
            for _, x in by_length(b.column(0)):
                x = np.unique(x, axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["d", "x"])

    return rows.select(vec_col).mapInArrow(run, "d int, x binary").distinct()


def matrices(batches, d_at: int = 0, x_at: int = 1):
    """(d, matrix of x) from packed vectors."""
    for b in batches:
        d = np.asarray(b.column(d_at))
        for k in np.unique(d).tolist():
            packed = b.column(x_at).take(pa.array(np.flatnonzero(d == k))).to_pylist()
            yield k, np.frombuffer(b"".join(packed), np.int64).reshape(-1, k)


def sums_of(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """n and the exact sums of each dimension, for each length."""
    def run(batches):
        total: dict[int, list] = {}
        for d, x in matrices(batches):
            # Halves of 32 bits, so that no sum overflows.
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            n, s = total.setdefault(d, [0, [0] * d])
            total[d] = [n + len(x), [a + (int(h) << 32) + int(w) for a, h, w in zip(s, high, low)]]
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                                              "n": pa.array([n] * d, pa.int64()), "s": pa.array([str(a) for a in s])})

    parts = fit.mapInArrow(run, "d int, i int, n long, s string")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("d", "i").collect():
        out.setdefault(r["d"], (r["n"], []))[1].append(int(r["s"]))
    return out


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Matrices given by rows (d, i, values as packed doubles), summed; one row of a matrix at a time is added up in a task."""
    def run(batches):
        total, of = None, None
        for b in batches:
            for d, i, row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if of != (d, i):
                    if of:
                        yield pa.RecordBatch.from_pydict({"d": pa.array([of[0]], pa.int32()), "i": pa.array([of[1]], pa.int32()), "row": [total.tobytes()]})
                    total, of = np.zeros(len(row) // 8), (d, i)
                total = total + np.frombuffer(row)
        if of:
            yield pa.RecordBatch.from_pydict({"d": pa.array([of[0]], pa.int32()), "i": pa.array([of[1]], pa.int32()), "row": [total.tobytes()]})

    rows = parts.repartition("d", "i").sortWithinPartitions("d", "i", "row").mapInArrow(run, parts.schema)
    out: dict[int, list] = {}
    for r in rows.orderBy("d", "i").collect():
        out.setdefault(r["d"], []).append(np.frombuffer(r["row"]))
    return {d: np.array(m) for d, m in out.items()}


def second_moments(fit: DataFrame, means: dict[int, np.ndarray], project: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The sum of z z' over the fit list for each length, z the centred vector (projected on the rows of ``project``)."""
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for d, x in matrices(batches):
            if project is not None and d not in project:
                continue
            z = x.astype(np.float64) - means[d]
            z = z if project is None else z @ project[d].T
            total[d] = total[d] + z.T @ z if d in total else z.T @ z
        for d, m in total.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d] * len(m), pa.int32()), "i": pa.array(range(len(m)), pa.int32()),
                                              "row": [r.tobytes() for r in m]})

    return summed(fit.mapInArrow(run, "d int, i int, row binary"))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    far = max(n * int(np.abs(x).max()) + abs(s) for s in sums) if x.size else 0
    if x.shape[1] * far * far < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``id`` and ``FIELDS`` for every usable row and each of its first ``components`` components.

    ``whitened`` is the centred vector on the component, over the square root of its eigenvalue; ``explained``
    the eigenvalue's share of the trace; ``identity_error`` the largest absolute entry of the whitened fit
    list's covariance minus the identity."""
    fit = materialize(distinct_vectors(rows, vec_col))
    sums = sums_of(fit)
    means = {d: np.array([s / n for s in total]) for d, (n, total) in sums.items()}
    models, project = {}, {}
    for d, moment in second_moments(fit, means).items():
        v = (moment + moment.T) / (2 * sums[d][0])
        pairs = leading(v, components)
        if pairs:
            project[d] = np.array([x / e ** 0.5 for e, x in pairs])
            models[d] = [e / float(np.trace(v)) for e, _ in pairs]
    error = {d: float(np.abs(m / sums[d][0] - np.eye(len(m))).max()) for d, m in second_moments(fit, means, project).items()}

    def run(batches):
        for b in batches:
            for at, x in by_length(b.column(1)):
                d = x.shape[1]
                if d not in models:
                    continue
                k, (n, total) = len(models[d]), sums[d]
                w = (x.astype(np.float64) - means[d]) @ project[d].T
                size = k * len(at)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(size, n)), pa.array([e for e in deviations(x, n, total) for _ in range(k)], pa.int64()),
                    pa.array(w.reshape(-1)), pa.array(np.tile(models[d], len(at))), pa.array(np.full(size, error[d]))], names=names)

    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), *T._parse_datatype_string(FIELDS).fields])
    names = schema.names
    return rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, schema)
