"""Whitening of embeddings: the leading principal components of quantised vectors, each scaled to variance one.

Method.

* Entries become integers, so every sum over the distinct vectors is exact: products of centred entries are formed by blocks
  that stay below 2**53 in floating point and are added as integers. The covariance is rounded once, at the end, and does not
  depend on the order of rows or on retries. Only sums of the size of a vector's covariance leave the tasks.
* Spectrum slicing on that matrix: the LDL' factorisation of V - shift * I (symmetric pivoting, 1 x 1 and 2 x 2 pivots) has as
  many positive pivots as V has eigenvalues above the shift. Halving by such counts isolates each leading eigenvalue; inverse
  iteration from within its interval and Rayleigh quotient iteration find the eigenpair (cubic convergence). Two more counts
  beside the value found certify its number; otherwise its interval is halved further. Equal eigenvalues share an interval,
  and their vectors are kept orthogonal to those found before.
* The covariance of the whitened distinct vectors is summed by another pass and compared with the identity.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

SCALE, OFFSET = 64, 1_000_000  # of the integer made of an entry
COMPONENTS = 16
EXACT = 1 << 53  # integers below are exact in floating point
LEAST = 1e-11  # share of the first eigenvalue below which one is taken as zero
ROUND = 64 * np.finfo(float).eps  # of the matrix's size: how far eigenvalues are told apart


def inertia(matrix: np.ndarray, shift: float) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix lie above, at and below shift: the signs of the pivots of LDL'."""
    a = matrix - shift * np.eye(len(matrix))
    above = zero = k = 0
    alpha = (1 + 17**0.5) / 8  # the choice of pivot that bounds growth
    while k < len(a):
        two = False
        if k + 1 < len(a):
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax()) + k + 1
            most = column[r - k - 1]
            if abs(a[k, k]) < alpha * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                if abs(a[k, k]) * row.max() < alpha * most * most:
                    two = abs(a[r, r]) < alpha * row.max()
                    to = k + two
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        if two:  # one eigenvalue on each side
            rest = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(a[k : k + 2, k : k + 2], rest.T)
            above += 1
            k += 2
        else:
            if a[k, k]:
                rest = a[k + 1 :, k]
                a[k + 1 :, k + 1 :] -= np.outer(rest, rest / a[k, k])
            above += a[k, k] > 0
            zero += a[k, k] == 0
            k += 1
    return int(above), int(zero), len(a) - int(above) - int(zero)


def _solve(a: np.ndarray, shift: float, v: np.ndarray, size: float) -> np.ndarray:
    """(a - shift)^-1 v, of length one; a singular matrix is shifted by a rounding error more."""
    for more in (0.0, ROUND * size, 4 * ROUND * size):
        try:
            w = np.linalg.solve(a - (shift + more) * np.eye(len(a)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(w).all() and (n := np.linalg.norm(w)) > 0:
            return w / n
    return v


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors (rows) of a symmetric matrix."""
    d = len(matrix)
    reach = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    top, bottom = float((np.diag(matrix) + reach).max()), float((np.diag(matrix) - reach).min())
    size = max(abs(top), abs(bottom))
    values, vectors = [], np.empty((0, d))
    if not size:
        return np.zeros(min(count, d)), np.eye(d)[: min(count, d)]
    known: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = inertia(matrix, shift)[0]
        return known[shift]

    known[top + size * 1e-3], known[bottom - size * 1e-3] = 0, d
    random = np.random.default_rng(d)
    for number in range(1, min(count, d) + 1):
        lo = max(s for s, n in known.items() if n >= number)
        hi = min(s for s, n in known.items() if n < number)
        best = None
        while True:
            while hi - lo > ROUND * size and (above(lo) - above(hi) > 1 or best is not None):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if above(mid) >= number else (lo, mid)
                if best is not None:
                    break
            v = random.standard_normal(d)
            off = lambda w: w - vectors.T @ (vectors @ w)  # noqa: E731  orthogonal to those found
            shift = (lo + hi) / 2
            for step in range(14):
                v = off(off(_solve(matrix, shift, v, size)))
                v /= np.linalg.norm(v)
                shift = float(v @ matrix @ v) if step else shift
                wrong = np.linalg.norm(matrix @ v - shift * v)
                if step > 1 and wrong <= 4 * np.finfo(float).eps * size:
                    break
            # Counts beside the value certify its number.
            near = max(ROUND * size, 2 * wrong)
            best = float(shift)
            if lo - near <= best <= hi + near and above(best - near) >= number > above(best + near):
                break
            if hi - lo <= ROUND * size:
                raise ArithmeticError(f"eigenvalue {number} of {d} was not certified")
        values.append(best)
        vectors = np.vstack([vectors, v * np.sign(v[np.abs(v).argmax()])])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], vectors[order]


@dataclass
class Fit:
    """What whitening needs of the distinct vectors of one size; all integers are Python's, exact."""

    n: int
    sums: list[int]  # of the integers without OFFSET
    centre: list[int] = field(default_factory=list)
    values: np.ndarray | None = None
    vectors: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        """Of the entries less centre; small, so that nothing is lost."""
        return np.array([float(Fraction(s - self.n * c, self.n)) for s, c in zip(self.sums, self.centre, strict=True)])

    def scores(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows of integers."""
        return (y - np.array(self.centre) - self.mean) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n * x - sum) squared, exact; None where a long can't hold it."""
        z = [s - self.n * c for s, c in zip(self.sums, self.centre, strict=True)]
        far = int(np.abs(y - np.array(self.centre)).max(initial=0))
        if (far * self.n + max(map(abs, z), default=0)) ** 2 * len(z) < 1 << 62:
            gap = (y - np.array(self.centre)) * self.n - np.array(z)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((self.n * (int(a) - c) - b) ** 2 for a, b, c in zip(row, z, self.centre, strict=True)) for row in y]
        return [x if x < 1 << 63 else None for x in exact]


def _rows(batch: pa.RecordBatch):
    """(where, integers as a matrix) of the vectors of each size in a batch."""
    column = batch.column("y")
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def _total(y: np.ndarray) -> np.ndarray:
    """Sum of the rows as Python integers."""
    far = int(np.abs(y).max(initial=0))
    return y.sum(axis=0).astype(object) if far * len(y) < 1 << 62 else y.sum(axis=0, dtype=object)


def _products(z: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact Python integers or int64."""
    far = int(np.abs(z).max(initial=0))
    if far * far >= EXACT:
        z = z.astype(object)
        return z.T @ z
    step = max(1, EXACT // max(1, far * far))
    out = np.zeros((z.shape[1],) * 2, object if far * far * len(z) >= 1 << 62 else np.int64)
    for a in range(0, len(z), step):
        f = z[a : a + step].astype(float)
        out += (f.T @ f).astype(np.int64)
    return out


def _summed(vectors: DataFrame, sums, kind: str) -> dict[int, list]:
    """Per size of vectors the sum over all rows of sums(d, rows), a flat array: each task gives one array for each size."""
    whole = kind != "double"
    arrow = pa.decimal128(38, 0) if whole else pa.float64()

    def part(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, y in _rows(batch):
                new = sums(y.shape[1], y)
                held[y.shape[1]] = held[y.shape[1]] + new if y.shape[1] in held else new
        for d, v in held.items():
            values = pa.array([int(x) for x in v] if whole else v, arrow)
            yield pa.record_batch({"d": pa.array([d] * len(v), pa.int32()), "at": pa.array(range(len(v)), pa.int32()), "v": values})

    total = vectors.mapInArrow(part, f"d int, at int, v {kind}").groupBy("d", "at").agg(F.sum("v").alias("v"))
    table = total.orderBy("d", "at").toArrow()  # as many as a covariance has entries
    out: dict[int, list] = {}
    for d, v in zip(table.column("d").to_pylist(), table.column("v").to_pylist(), strict=True):
        out.setdefault(d, []).append(int(v) if whole else v)
    return out


def fitted(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit for each size of vectors; distinct has them once each, as integers without OFFSET, in the column y."""
    first = _summed(distinct, lambda d, y: np.append(_total(y), len(y)), "decimal(38,0)")
    fits = {d: Fit(v[-1], v[:-1]) for d, v in first.items()}
    for fit in fits.values():
        fit.centre = [(2 * s + fit.n) // (2 * fit.n) for s in fit.sums]
    centres = {d: np.array(f.centre) for d, f in fits.items()}
    squares = _summed(distinct, lambda d, y: _products(y - centres[d])[np.triu_indices(d)].astype(object), "decimal(38,0)")
    for d, fit in fits.items():
        z, v = [s - fit.n * c for s, c in zip(fit.sums, fit.centre, strict=True)], np.zeros((d, d))
        for i, j, c in zip(*np.triu_indices(d), squares[d], strict=True):
            v[i, j] = v[j, i] = (fit.n * c - z[i] * z[j]) / (fit.n * fit.n)  # of integers: rounded once
        fit.trace = float(np.trace(v))
        values, vectors = leading(v, components)
        some = values > max(LEAST * values[0], 0) if len(values) else []
        fit.values, fit.vectors = values[some], vectors[some]

    def moments(d, y):
        w = fits[d].scores(y)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    for d, v in _summed(distinct, moments, "double").items():
        k, n = len(fits[d].values), fits[d].n
        if k:
            mean, square = np.array(v[:k]) / n, np.array(v[k:]).reshape(k, k) / n
            fits[d].identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    return fits


def integers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, y) of the usable rows: y is floor(64 * entry), without OFFSET, which no covariance or deviation depends on.

    Vectors that are null or empty or hold null or non-finite entries are left out. Entries beyond 2**57 are held there.
    """
    vector = F.col(vector_column)
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.greatest(F.lit(-(2.0**57)), F.least(F.lit(2.0**57), x.cast("double") * SCALE))
    y = F.transform(vector, lambda x: F.floor(held(x)))
    return vectors.where(F.coalesce(good, F.lit(False)) & (F.size(vector) > 0)).select(F.col(id_column).cast("long").alias("vec_id"), y.alias("y"))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each usable row and leading component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    The fit is over each distinct integer vector once; vectors of different sizes are fitted apart. Rows that repeat an id or a
    vector and rows without an id are all returned. Components without variance have no whitened value and are left out, so
    a single distinct vector gives no rows. deviation is null where a long can't hold it.
    """
    rows = integers(vectors, id_column, vector_column)
    fits = fitted(stored(rows.select("y").distinct()), components)

    def apply(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, y in _rows(batch):
                fit = fits[y.shape[1]]
                k, m = len(fit.values), len(at)
                if k:
                    each = lambda v, kind: pa.array(np.repeat(v, k) if isinstance(v, np.ndarray) else [x for x in v for _ in range(k)], kind)
                    yield pa.record_batch({
                        "vec_id": ids.take(pa.array(np.repeat(at, k))), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), "n": pa.array(np.full(m * k, fit.n, np.int64)),
                        "deviation": each(fit.deviation(y), pa.int64()), "whitened": pa.array(fit.scores(y).ravel()), "explained": pa.array(np.tile(fit.values / fit.trace, m)),
                        "identity_error": pa.array(np.full(m * k, fit.identity_error)),
                    })

    return rows.mapInArrow(apply, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
