"""Embedding whitening: exact distributed covariance, float32 eigenvectors refined to double precision.

Vector entries c become integers x = floor(64 c) + 1,000,000.  Tasks add counts,
sums and products of the entries as integers, a shuffle on the matrix cell adds
the tasks' parts, so the covariance is exact: its n^2-fold n * sum(xx') - sum(x)sum(x)' is an
integer matrix (centring integers before or after multiplying gives the same).

:func:`eigenpairs` starts from numpy's float32 eigenvectors and corrects them by
Ogita-Aishima iterations: with R = I - X'X and S = X'AX, X becomes X + XE, where
e_ij = (s_ij + l_j r_ij) / (l_j - l_i).  The products are made in fixed-point numbers of over 110
bits whose limbs are multiplied exactly by float64 matrix products (:class:`Fixed`), so the error is squared every
time.  Eigenvalues nearer to each other than the bound delta of the iteration form clusters: inside one E only
restores orthogonality, and the small matrix X_c'(A - m I)X_c, taken with its
shift in high precision, is solved on its own and X_c turned by its
eigenvectors; the next iteration has a smaller delta, until all that differ are apart.

The driver gets dim x dim numbers (dim: entries of a vector) and solves them; rows never reach it.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
left out, and so are rows of another length than most rows have (ties: the longer one), as they have no
covariance with the rest.  Rows are treated one by one, so repeated rows and
repeated or null ids repeat and weigh.  Components of no variance (constant entries, one row) have no whitened
values (null) and do not enter the identity error; with no variance at all that and ``explained`` are null.  An empty table
gives an empty result.  Columns other than the id and the vector are ignored, whatever their
names.  Equal eigenvalues: any orthonormal basis of their space.  The entry of largest absolute value of a component is
positive (ties: the first).  Entries with |64 c| of 2^62 and more and deviations beyond 64 bits are refused (errors).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows whose products are added at a time.
SLICE_ROWS = 4096
#: Limbs of a high-precision number and iterations at most (about five are used).
LIMBS, ITERATIONS = 7, 40
#: Eigenvalues below this share of the largest are zero (the matrix is exact).
ZERO = 1e-26


class Fixed:
    """A matrix of fixed-point numbers: the sum over k of limb k (integers held as float64) times 2^(-bits k).

    ``bits`` is small enough for float64 products of limbs over the inner dimension, and their sums, to be exact.
    """

    def __init__(self, limbs: np.ndarray, bits: int):
        self.limbs, self.bits = limbs, bits

    @staticmethod
    def bits_for(dim: int) -> int:
        return (52 - int(np.ceil(np.log2(max(dim, 2) * LIMBS)))) // 2

    @classmethod
    def of(cls, a: np.ndarray, bits: int) -> Fixed:
        """From float64 numbers below 2^bits."""
        out, rest = [], np.asarray(a, np.float64)
        for _ in range(LIMBS):
            out.append(np.rint(rest))
            rest = np.ldexp(rest - out[-1], bits)
        return cls(np.stack(out), bits)

    @classmethod
    def of_ratio(cls, a: np.ndarray, shift: int, bits: int) -> Fixed:
        """From Python integers divided by 2^shift, which are below 1."""
        whole = bits * (LIMBS - 1)
        scaled = (a << (whole - shift)) if whole >= shift else (a >> (shift - whole))
        out = []
        for _ in range(LIMBS - 1):
            part = scaled & ((1 << bits) - 1)
            out.append(part.astype(np.float64))
            scaled = (scaled - part) >> bits
        return cls(np.stack([scaled.astype(np.float64), *out[::-1]]), bits)._carried()

    def _carried(self) -> Fixed:
        """Limbs of at most half of 2^bits, but for the first."""
        out = self.limbs.copy()
        for k in range(len(out) - 1, 0, -1):
            over = np.rint(np.ldexp(out[k], -self.bits))
            out[k] -= np.ldexp(over, self.bits)
            out[k - 1] += over
        return Fixed(out[:LIMBS], self.bits)

    def __matmul__(self, other: Fixed) -> Fixed:
        out = np.zeros((LIMBS + 1, self.limbs.shape[1], other.limbs.shape[2]))
        for i in range(LIMBS):
            for j in range(min(LIMBS, LIMBS + 1 - i)):
                out[i + j] += self.limbs[i] @ other.limbs[j]
        return Fixed(out, self.bits)._carried()

    def __add__(self, other: Fixed) -> Fixed:
        return Fixed(self.limbs + other.limbs, self.bits)._carried()

    def __sub__(self, other: Fixed) -> Fixed:
        return Fixed(self.limbs - other.limbs, self.bits)._carried()

    @property
    def T(self) -> Fixed:
        return Fixed(self.limbs.transpose(0, 2, 1), self.bits)

    def __getitem__(self, at) -> Fixed:
        return Fixed(self.limbs[(slice(None), *at)], self.bits)

    def floats(self) -> np.ndarray:
        out = np.zeros(self.limbs.shape[1:])
        for k in range(LIMBS - 1, -1, -1):
            out += np.ldexp(self.limbs[k], -self.bits * k)
        return out


def _clusters(order: np.ndarray, gap: np.ndarray, delta: float) -> list[np.ndarray]:
    """Indices of eigenvalues that lie in runs of neighbours at most ``delta`` apart, two at least; ``order``: falling."""
    cuts = np.flatnonzero(gap[order[1:], order[:-1]] > delta) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, unit of the eigenvalues) of a symmetric matrix of Python integers."""
    dim = len(a)
    most = max((abs(int(v)) for v in a.ravel()), default=0)
    if most == 0:
        return np.zeros(dim), np.eye(dim), 1
    shift, bits = most.bit_length(), Fixed.bits_for(dim)
    fixed, eye = Fixed.of_ratio(a, shift, bits), Fixed.of(np.eye(dim), bits)
    x = Fixed.of(np.linalg.eigh(fixed.floats().astype(np.float32))[1].astype(np.float64), bits)
    norm = np.linalg.norm(fixed.floats())
    noise = norm * 2.0 ** (-bits * (LIMBS - 1)) * dim * dim
    for _ in range(ITERATIONS):
        high_r, high_s = eye - x.T @ x, x.T @ (fixed @ x)
        r, s = high_r.floats(), high_s.floats()
        diagonal = Fixed(np.einsum("kii->ki", high_s.limbs)[:, :, None], bits)
        by_r = np.diag(s) * np.diag(r)
        value = np.diag(s) + by_r
        gap = (diagonal.T - diagonal).floats() + by_r[None, :] - by_r[:, None]  # l_j - l_i, exact but for tiny terms
        delta = 2 * (np.linalg.norm(s - np.diag(np.diag(s))) + norm * np.linalg.norm(r))
        near = np.abs(gap) <= max(delta, noise)
        np.fill_diagonal(near, True)
        e = np.where(near, r / 2, (s + value[None, :] * r) / np.where(near, 1.0, gap))
        x = x + x @ Fixed.of(e, bits)
        turned = False
        order = np.argsort((gap > 0).sum(axis=1), kind="stable")  # falling, also where float64 values are equal
        for c in _clusters(order, gap, max(delta, noise)):
            # the shifted matrix of the cluster; its diagonal is a difference of high-precision numbers
            t = s[np.ix_(c, c)] + value[c[0]] * r[np.ix_(c, c)]
            np.fill_diagonal(t, gap[c[0], c])
            t, width = (t + t.T) / 2, np.abs(t).max()
            if width > 4 * noise and np.abs(t - np.diag(np.diag(t))).max() > 1e-8 * width:
                part = x[:, c] @ Fixed.of(np.linalg.eigh(t / width)[1], bits)
                x.limbs[:, :, c] = part.limbs
                turned = True
        if not turned and np.abs(e).max() < 2.0 ** -64:
            break
    vectors = x.floats()[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors *= np.where(vectors[top, np.arange(dim)] < 0, -1.0, 1.0)
    return value[order], vectors, 1 << shift


@dataclass
class Whitening:
    """Count, sums of x - OFFSET, eigenvalues (falling, of the covariance), unit components as columns, trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    def projection(self, k: int) -> np.ndarray:
        """dim x (components of some variance, k at most): a centred vector times it is whitened."""
        there = int((self.values[:k] > ZERO * max(self.values.max(initial=0), 1e-300)).sum())
        return self.components[:, :there] / np.sqrt(self.values[:there])


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, y``: floor(scale * c) of the vectors whose entries are all there and finite (x is y + OFFSET)."""
    kept = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0)).filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    too_large = F.raise_error(F.lit("a scaled entry of 2^62 or more")).cast("long")
    return kept.select("id", F.transform("v", lambda c: F.when(F.abs(c * scale) < 2.0 ** 62, F.floor(c * scale)).otherwise(too_large)).alias("y"))


def common_length(vectors: DataFrame) -> int:
    """The length of most vectors (ties: the longer one), 0 without rows."""
    first = vectors.groupBy(F.size("y").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return first["dim"] if first else 0


def _flat(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _products(y: np.ndarray) -> np.ndarray:
    """y'y as Python integers, exact at any size of the entries."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    if most * most * len(y) < 1 << 63:
        return (y.T @ y).astype(object)
    return y.T.astype(object) @ y.astype(object)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE_ROWS):
            yield whole.slice(lo, SLICE_ROWS)


def _moments(dim: int):
    """Arrow function: vectors -> one row per cell (i <= j) of the sums of products, (-1, j) sums, (-1, -1) count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cells = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for b in _slices(batches):
            y = _flat(b.column("y"), dim)
            n += len(y)
            if np.abs(y).max(initial=0) * float(len(y)) < 2.0 ** 62:
                total += y.sum(axis=0).astype(object)
            else:
                total += y.astype(object).sum(axis=0)
            cells += _products(y)
        if n:
            i, j = np.triu_indices(dim)
            at_i = np.concatenate([[-1], np.full(dim, -1), i]).astype(np.int32)
            at_j = np.concatenate([[-1], np.arange(dim), j]).astype(np.int32)
            values = [Decimal(int(v)) for v in (n, *total, *cells[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(at_i), pa.array(at_j), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "s"])
    return run


def fit(vectors: DataFrame, dim: int) -> Whitening:
    """Of a table ``id, y`` of integer vectors of ``dim`` entries (see :func:`integer_vectors`)."""
    cells = vectors.select("y").mapInArrow(_moments(dim), "i int, j int, s decimal(38,0)")
    found = {(r["i"], r["j"]): int(r["s"]) for r in cells.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    n = found.get((-1, -1), 0)
    sums = np.array([found.get((-1, j), 0) for j in range(dim)], object)
    scatter = np.zeros((dim, dim), object)  # n^2 times the covariance
    for i in range(dim):
        for j in range(i, dim):
            scatter[i, j] = scatter[j, i] = n * found.get((i, j), 0) - sums[i] * sums[j]
    values, components, unit = eigenpairs(scatter)
    square = max(n * n, 1)
    trace = sum(int(scatter[i, i]) for i in range(dim))
    return Whitening(n, sums, values * (unit / square), components, trace / square)


def _whitened(model: Whitening, y: np.ndarray, projection: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x - S as integers, whitened values)."""
    most = max(int(np.abs(y).max(initial=0)), 1) * model.n + max((abs(int(s)) for s in model.sums), default=0)
    if most * most * model.dim < 1 << 63:
        centred = model.n * y - model.sums.astype(np.int64)
    else:
        centred = model.n * y.astype(object) - model.sums
    return centred, (centred.astype(np.float64) / model.n) @ projection


def transform(vectors: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """``id, deviation, whitened`` (array of the components of some variance, k at most); deviation: sum of (n x - S)^2."""
    projection = model.projection(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            centred, w = _whitened(model, _flat(b.column("y"), model.dim), projection)
            offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            deviation = (centred * centred).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(deviation.tolist(), pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))],
                                             names=["id", "deviation", "whitened"])

    kind = dict(vectors.dtypes)["id"]
    return vectors.select("id", "y").mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, k: int = COMPONENTS) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all rows."""
    projection = model.projection(k)
    width = projection.shape[1]
    if width == 0:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((width + 1, width))
        for b in _slices(batches):
            w = _whitened(model, _flat(b.column("y"), model.dim), projection)[1]
            cells[:-1] += w.T @ w
            cells[-1] += w.sum(axis=0)
        i, j = np.indices(cells.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(cells.ravel())],
                                         names=["i", "j", "s"])

    rows = vectors.select("y").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    cells = np.zeros((width + 1, width))
    for r in rows:  # (k + 1) x k
        cells[r["i"], r["j"]] = r["s"] / model.n
    return float(np.abs(cells[:-1] - np.outer(cells[-1], cells[-1]) - np.eye(width)).max())


def report(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    vectors = integer_vectors(df, id_col, vector)
    dim = common_length(vectors)
    kind = dict(vectors.dtypes)["id"]
    if dim == 0:
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                   "explained double, identity_error double")
    vectors = vectors.filter(F.size("y") == dim)
    model = fit(vectors, dim)
    error = identity_error(vectors, model, k)
    shares = [F.lit(float(v / model.trace) if model.trace else None).cast("double") for v in model.values[:k]]
    each = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.get("whitened", i)))
    rows = transform(vectors, model, k).select(F.col("id").alias("vec_id"), "deviation", each.alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(F.array(*shares), F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
