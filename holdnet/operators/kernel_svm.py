"""Support vector machines with exact kernels: a distributed block solver of the dual.

Several problems (kernel, C, left-out fold) over the same training rows are solved side by side.  The rows stay distributed; each
carries its multiplier and its score sum_j a_j y_j K(x, x_j) for every problem.  A round is one Spark job:

1. tasks add the last round's changes to their rows' scores, through kernel blocks of a batch of rows times at most
   ``working`` rows;
2. the rows that violate optimality most (``working / 2`` on either side) are chosen for every problem, first in
   each task, then over all;
3. one task a problem solves the dual restricted to these rows, by pairwise steps, from interior-point ones for the linear kernel; what changed
   (at most ``working`` rows a problem) goes to the next round.

A problem ends when no pair violates optimality by more than ``tol``, as in the usual solvers.  Nothing of
the size of the table is ever held in one place: batches, working rows and blocks of support vectors are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdnet.operators.ranks import row_numbers
from holdnet.session import pin

#: Rows of a problem that are solved together.
WORKING = 1024
#: Rows of a kernel block, and support vectors that travel in one closure.
BLOCK_ROWS, SUPPORT_ROWS = 2048, 8192
#: Rounds between two checkpoints of the rows' state.
CUT = 8
TOL = 1e-3


@dataclass(frozen=True)
class Kernel:
    """``linear``: x'z; ``rbf``: exp(-gamma |x - z|^2)."""

    name: str
    gamma: float = 0.0

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        inner = a @ b.T
        if self.name == "linear":
            return inner
        far = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * inner
        return np.exp(-self.gamma * np.maximum(far, 0))


@dataclass(frozen=True)
class Problem:
    kernel: Kernel
    c: float
    fold: int | None = None  # rows of this fold take no part


@dataclass
class Change:
    """Rows whose multiplier changed: their ids (ascending), features, change of a y, and new multiplier."""

    rows: np.ndarray
    x: np.ndarray
    step: np.ndarray
    alpha: np.ndarray


@dataclass
class Solution:
    """``state``: row, y, fold, x, alpha, score (one entry per problem); offsets and remaining violation per problem."""

    problems: list[Problem]
    state: DataFrame
    bias: list[float]
    violation: list[float]
    rounds: int


STATE = "row long, y int, fold int, x array<double>, alpha array<double>, score array<double>"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK_ROWS):
            yield whole.slice(lo, BLOCK_ROWS)


def _update(problems: Sequence[Problem], changes: dict[int, Change], dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            row = b.column("row").to_numpy()
            x = _matrix(b.column("x"), dim)
            alpha, score = (_matrix(b.column(k), len(problems)).copy() for k in ("alpha", "score"))
            for p, c in changes.items():
                score[:, p] += problems[p].kernel(x, c.x) @ c.step
                at = np.minimum(np.searchsorted(c.rows, row), len(c.rows) - 1)
                own = c.rows[at] == row
                alpha[own, p] = c.alpha[at[own]]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("y"), b.column("fold"), b.column("x"), _lists(alpha), _lists(score)],
                                             names=["row", "y", "fold", "x", "alpha", "score"])
    return run


CANDIDATE = "problem int, up boolean, key double, row long, y int, alpha double, error double, x array<double>"


def _candidates(problems: Sequence[Problem], active: Sequence[int], half: int, dim: int) -> Callable:
    """Arrow function: per active problem and side the task's ``half`` rows that may move and violate most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bool], list[np.ndarray]] = {}
        for b in _slices(batches):
            row, y, fold = (b.column(k).to_numpy() for k in ("row", "y", "fold"))
            x = _matrix(b.column("x"), dim)
            alpha, score = (_matrix(b.column(k), len(problems)) for k in ("alpha", "score"))
            for p in active:
                a, error = alpha[:, p], y - score[:, p]
                part = np.ones(len(y), bool) if problems[p].fold is None else fold != problems[p].fold
                below, above = a < problems[p].c, a > 0
                for up in (True, False):
                    may = part & np.where((y > 0) == up, below, above)
                    at = np.flatnonzero(may)
                    new = [(error if up else -error)[at], row[at], y[at], a[at], error[at], x[at]]
                    if (p, up) in best:
                        new = [np.concatenate(pair) for pair in zip(best[p, up], new, strict=True)]
                    top = np.lexsort((new[1], -new[0]))[:half]
                    best[p, up] = [v[top] for v in new]
        for (p, up), (key, row, y, a, error, x) in best.items():
            if len(key):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(key), p, np.int32)), pa.array(np.full(len(key), up)), pa.array(key), pa.array(row),
                    pa.array(y.astype(np.int32)), pa.array(a), pa.array(error), _lists(x)],
                    names=["problem", "up", "key", "row", "y", "alpha", "error", "x"])
    return run


def pairwise(kernel: np.ndarray, y: np.ndarray, alpha: np.ndarray, error: np.ndarray, c: float, tol: float,
             steps: int = 100_000) -> np.ndarray:
    """Multipliers that solve the dual restricted to these rows, by pairwise steps; ``error``: y minus the score.

    Each step moves the pair of the largest error that may rise and the row that may fall with the largest
    gain by second order, as far as the box allows.
    """
    up, low, error = np.where(y > 0, c - alpha, alpha), np.where(y > 0, alpha, c - alpha), error.astype(float).copy()
    diagonal, tiny = np.diag(kernel).copy(), 1e-12 * c
    for _ in range(steps):
        i = int(np.argmax(np.where(up > 0, error, -np.inf)))
        gap = np.where(low > 0, error[i] - error, -np.inf)
        if up[i] <= 0 or gap.max() <= tol:
            break
        curve = np.maximum(diagonal[i] + diagonal - 2 * kernel[i], 1e-12)
        j = int(np.argmax(np.where(gap > 0, gap * gap / curve, -1)))
        step = min(gap[j] / curve[j], up[i], low[j])
        error -= step * (kernel[i] - kernel[j])
        for at, sign in ((i, -1), (j, 1)):
            up[at] += sign * step
            low[at] -= sign * step
            if up[at] < tiny:
                up[at], low[at] = 0.0, c
            elif low[at] < tiny:
                up[at], low[at] = c, 0.0
    return np.where(y > 0, low, up)


def interior(x: np.ndarray, y: np.ndarray, alpha: np.ndarray, error: np.ndarray, c: float) -> np.ndarray:
    """The same for the linear kernel by Mehrotra's interior-point steps, however badly conditioned it is.

    The system of a step is a diagonal plus a product of rank ``dim``, so it is solved through dim x dim matrices.  Entries at the
    box's sides are put on them and the sum of y a is restored: the result is close to the solution, but may violate
    optimality a little.
    """
    n = len(y)
    u = x * y[:, None]
    linear = -y * error - u @ (u.T @ alpha)  # gradient at 0, the other rows' scores included
    total = y @ alpha
    a, low, high, lam = np.full(n, c / 2), np.ones(n), np.ones(n), 0.0
    for _ in range(60):
        room = c - a
        dual, primal = u @ (u.T @ a) + linear + lam * y - low + high, y @ a - total
        mu = (a @ low + room @ high) / (2 * n)
        if max(np.abs(dual).max(), abs(primal), mu) < 1e-10 * max(1.0, c):
            break
        diagonal = low / a + high / room
        scaled = u / diagonal[:, None]
        small = np.linalg.inv(np.eye(u.shape[1]) + u.T @ scaled)

        def solve_for(rhs):
            return rhs / diagonal - scaled @ (small @ (scaled.T @ rhs))

        by_y = solve_for(y.astype(float))

        def direction(target_low, target_high):
            free = solve_for(-dual + target_low / a - target_high / room)
            step_lam = (y @ free + primal) / (y @ by_y)
            step = free - step_lam * by_y
            return step, step_lam, (target_low - low * step) / a, (target_high + high * step) / room

        def longest(step, step_low, step_high, most):
            sizes = [1.0]
            for value, change in ((a, step), (room, -step), (low, step_low), (high, step_high)):
                falling = change < 0
                if falling.any():
                    sizes.append(most * float((-value[falling] / change[falling]).min()))
            return min(sizes)

        step, step_lam, step_low, step_high = direction(-low * a, -high * room)
        size = longest(step, step_low, step_high, 1.0)
        ahead = ((a + size * step) @ (low + size * step_low) + (room - size * step) @ (high + size * step_high)) / (2 * n)
        centre = mu * (ahead / mu) ** 3
        step, step_lam, step_low, step_high = direction(centre - low * a - step * step_low, centre - high * room + step * step_high)
        size = longest(step, step_low, step_high, 0.995)
        a, lam, low, high = a + size * step, lam + size * step_lam, low + size * step_low, high + size * step_high
    a = np.where((a < 1e-6 * c) & (low > a), 0.0, np.where((c - a < 1e-6 * c) & (high > c - a), c, a))
    for i in np.argsort(np.abs(a - c / 2)):  # put what the rounding took from the sum into the freest rows
        missing = (total - y @ a) * y[i]
        if missing == 0:
            break
        a[i] = min(max(a[i] + missing, 0.0), c)
        if 0 < a[i] < c:
            break
    return a


def block_solution(kernel: Kernel, x: np.ndarray, y: np.ndarray, alpha: np.ndarray, error: np.ndarray, c: float, tol: float) -> np.ndarray:
    """Pairwise steps; for the linear kernel from where interior-point steps end, if those can be made."""
    k, start = kernel(x, x), alpha
    if kernel.name == "linear":
        try:
            new = interior(x, y, alpha, error, c)
            if np.isfinite(new).all() and abs((y * (new - alpha)).sum()) <= 1e-9 * c * len(y):
                start = new
        except np.linalg.LinAlgError:
            pass  # the pairwise steps then do it all
    return pairwise(k, y, start, error - k @ (y * (start - alpha)), c, tol)


MOVED = "problem int, row long, x array<double>, step double, alpha double, violation double"


def _solve(problems: Sequence[Problem], dim: int, tol: float) -> Callable:
    """Arrow group function: one problem's chosen rows -> the rows whose multiplier changed; a null row: the problem is solved."""
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        p = group.column("problem")[0].as_py()
        row, first = np.unique(group.column("row").to_numpy(), return_index=True)
        y, a, error = (group.column(k).to_numpy()[first] for k in ("y", "alpha", "error"))
        x = _matrix(group.column("x").combine_chunks(), dim)[first]
        c = problems[p].c
        up, low = np.where(y > 0, a < c, a > 0), np.where(y > 0, a > 0, a < c)
        violation = float(error[up].max() - error[low].min()) if up.any() and low.any() else 0.0
        moved = np.zeros(len(row), bool)
        if violation > tol:
            new = block_solution(problems[p].kernel, x, y, a, error, c, tol / 2)
            moved = new != a
        if not moved.any():
            return pa.table({"problem": [p], "row": [None], "x": [None], "step": [None], "alpha": [None], "violation": [violation]},
                            schema=pa.schema([("problem", pa.int32()), ("row", pa.int64()), ("x", pa.list_(pa.float64())),
                                              ("step", pa.float64()), ("alpha", pa.float64()), ("violation", pa.float64())]))
        n = int(moved.sum())
        return pa.table({"problem": pa.array(np.full(n, p, np.int32)), "row": pa.array(row[moved]), "x": _lists(x[moved]),
                         "step": pa.array((y * (new - a))[moved]), "alpha": pa.array(new[moved]),
                         "violation": pa.array(np.full(n, violation))})
    return run


def solve(rows: DataFrame, problems: Sequence[Problem], dim: int, tol: float = TOL, working: int = WORKING,
          max_rounds: int = 1000) -> Solution:
    """Of a written table ``row long, y int (1 or -1), fold int, x array<double>`` with different row ids."""
    problems = list(problems)
    n = len(problems)
    zero = F.array_repeat(F.lit(0.0), n)
    state = rows.select("row", "y", "fold", "x", zero.alias("alpha"), zero.alias("score"))
    active, changes, violation, rounds, held = list(range(n)), {}, [0.0] * n, 0, None
    while active and rounds < max_rounds:
        rounds += 1
        if changes:
            new = state.mapInArrow(_update(problems, changes, dim), STATE)
            new = pin(new) if rounds % CUT == 0 else new.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            new = state
        found = new.mapInArrow(_candidates(problems, active, working // 2, dim), CANDIDATE)
        nth = F.row_number().over(Window.partitionBy("problem", "up").orderBy(F.desc("key"), "row"))
        chosen = found.withColumn("nth", nth).filter(F.col("nth") <= working // 2)
        moved = chosen.drop("nth").groupBy("problem").applyInArrow(_solve(problems, dim, tol), MOVED).collect()
        if held is not None:
            held.unpersist()
        held, state = (new if changes else None), new
        grouped: dict[int, list] = {}
        for r in moved:  # at most ``working`` rows a problem
            violation[r["problem"]] = r["violation"]
            if r["row"] is not None:
                grouped.setdefault(r["problem"], []).append(r)
        changes = {}
        for p, found_rows in grouped.items():
            found_rows.sort(key=lambda r: r["row"])
            changes[p] = Change(np.array([r["row"] for r in found_rows]), np.array([r["x"] for r in found_rows]),
                                np.array([r["step"] for r in found_rows]), np.array([r["alpha"] for r in found_rows]))
        active = sorted(changes)
    if changes:
        state = state.mapInArrow(_update(problems, changes, dim), STATE)
    state = pin(state)
    if held is not None:
        held.unpersist()
    return Solution(problems, state, _biases(state, problems), violation, rounds)


def _biases(state: DataFrame, problems: Sequence[Problem]) -> list[float]:
    """Per problem the mean error of the rows inside the box, else the middle between the sides; +-1 for one class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(problems)
        total, count, top, least = np.zeros(n), np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)
        for b in batches:
            y, fold = (b.column(k).to_numpy() for k in ("y", "fold"))
            alpha, score = (_matrix(b.column(k), n) for k in ("alpha", "score"))
            for p, problem in enumerate(problems):
                part = np.ones(len(y), bool) if problem.fold is None else fold != problem.fold
                a, error = alpha[:, p], y - score[:, p]
                free = part & (a > 0) & (a < problem.c)
                total[p] += error[free].sum()
                count[p] += free.sum()
                top[p] = error[part & np.where(y > 0, a < problem.c, a > 0)].max(initial=top[p])
                least[p] = error[part & np.where(y > 0, a > 0, a < problem.c)].min(initial=least[p])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, (total, count, top, least))],
                                         names=["problem", "total", "n", "top", "least"])

    parts = state.select("y", "fold", "alpha", "score").mapInArrow(run, "problem int, total double, n double, top double, least double")
    out = [0.0] * len(problems)
    for r in parts.groupBy("problem").agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("top").alias("top"),
                                          F.min("least").alias("least")).collect():
        both = np.isfinite(r["top"]) and np.isfinite(r["least"])
        middle = (r["top"] + r["least"]) / 2 if both else (1.0 if np.isfinite(r["top"]) else -1.0 if np.isfinite(r["least"]) else 0.0)
        out[r["problem"]] = r["total"] / r["n"] if r["n"] else middle
    return out


def support_table(solution: Solution, problem: int) -> DataFrame:
    """Support vectors of a problem: ``block, x, weight`` (a y), at most SUPPORT_ROWS rows a block."""
    alpha = F.element_at("alpha", problem + 1)
    found = solution.state.filter(alpha > 0).select("row", "x", (alpha * F.col("y")).alias("weight"))
    numbered = row_numbers(found, [], ["row"], out="nth")
    return pin(numbered.select(F.floor((F.col("nth") - 1) / SUPPORT_ROWS).cast("int").alias("block"), "x", "weight"))


def decision(df: DataFrame, x: str, support: DataFrame, kernel: Kernel, bias: float, out: str) -> DataFrame:
    """Add ``out``: sum of weight * kernel over the support vectors, block by block, plus the offset; ``x``: array<double>."""
    blocks = sorted(r["block"] for r in support.select("block").distinct().collect())
    df = df.withColumn(out, F.lit(float(bias)))
    for k, block in enumerate(blocks):
        held = support.filter(F.col("block") == block).select("x", "weight").collect()  # at most SUPPORT_ROWS
        vectors, weights = np.array([r["x"] for r in held]), np.array([r["weight"] for r in held])
        df = df.withColumn(out, F.col(out) + _block_decision(kernel, vectors, weights)(F.col(x)))
        if k % CUT == CUT - 1:
            df = pin(df)  # the blocks before it are done with
    return df


def _block_decision(kernel: Kernel, vectors: np.ndarray, weights: np.ndarray):
    @F.pandas_udf("double")
    def value(xs: pd.Series) -> pd.Series:
        out = [kernel(np.stack(xs.iloc[lo:lo + BLOCK_ROWS].to_numpy()), vectors) @ weights for lo in range(0, len(xs), BLOCK_ROWS)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return value
