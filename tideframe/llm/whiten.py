"""Leading principal components by Jacobi-Davidson, and whitened rows.

The covariance is never formed. Its product with a few vectors is one job over
the distinct integer vectors: each task centres its rows, multiplies, and adds
up one block. From a random subspace, Rayleigh-Ritz gives approximate pairs; for
each that is not yet good the correction equation, projected off the found
vectors, is solved by some steps of MINRES (all pairs side by side, so a step is
one job), and the corrections enlarge the subspace. The largest pair is locked
when its residual is at double precision.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q

SCALE = 256
SPARE = 4           # pairs followed beyond those wanted, so that none hides behind another
BASIS = 48          # vectors at which the subspace is cut back
INNER = 8           # steps of MINRES a correction
OUTER = 200
LARGEST = float(1 << 62)
EPS = float(np.finfo(float).eps)
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"

Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(_id, _x) with _x the floors of the scaled entries; rows whose vector is null, empty,
    or holds an entry that is null, not finite or 2^62 and more once scaled are left out."""
    scaled = F.transform(F.col(q(vec_col)), lambda c: c.cast("double") * scale)
    fit = F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return rows.select(F.col(q(id_col)).alias("_id"), scaled.alias("_v")).where(F.coalesce((F.size("_v") > 0) & fit, F.lit(False))) \
        .select("_id", F.transform("_v", lambda c: F.floor(c).cast("long")).alias("_x"))


def common_length(rows: DataFrame) -> int:
    """The commonest length of ``_x`` (the larger of two), 0 for an empty table."""
    row = rows.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The rows of ``_x``, the last column of a batch, as int64."""
    return np.asarray(batch.column(batch.num_columns - 1).flatten(), dtype=np.int64).reshape(-1, dims)


def summed(rows: DataFrame, dims: int, shape: tuple[int, ...], block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``block``, of this shape, over Arrow batches of rows: one block a task is shuffled."""
    cells = int(np.prod(shape))

    def fold(batches):
        total = np.zeros(cells)
        for batch in batches:
            total += block(matrix(batch, dims)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells), pa.int32()), pa.array(total)], names=["at", "value"])

    out = np.zeros(cells)
    for r in rows.select("_x").mapInArrow(fold, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out.reshape(shape)


@dataclass(frozen=True)
class Fit:
    """The distinct vectors: how many, their exact sums, and the leading components."""

    n: int
    sums: list[int]
    values: np.ndarray          # falling
    vectors: np.ndarray         # dims x components
    trace: float
    identity_error: float | None

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(value), NaN where the value is 0 to rounding."""
        floor = self.dims * EPS * max(self.values[0], 0.0)
        return np.where(self.values > floor, 1 / np.sqrt(np.where(self.values > floor, self.values, 1.0)), np.nan)


def exact_sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each entry, in whole numbers of any size."""
    def fold(batches):
        n, high, low = 0, np.zeros(dims, dtype=np.int64), np.zeros(dims, dtype=np.int64)
        for batch in batches:
            x = matrix(batch, dims)
            n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims), pa.int32()), pa.array(np.full(dims, n)), pa.array(high), pa.array(low)],
                                         names=["at", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    got = rows.select("_x").mapInArrow(fold, "at int, n long, high long, low long").groupBy("at").agg(*wide).collect()
    sums = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in got}
    return int(got[0]["n"]) if got else 0, [sums.get(i, 0) for i in range(dims)]


def minres(apply: Product, b: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Columns x that lessen ``b - apply(x)``, for a symmetric ``apply``; all columns step together."""
    x, v_before, w_before, w = (np.zeros_like(b) for _ in range(4))
    start = np.linalg.norm(b, axis=0)
    beta, eta = start.copy(), start.copy()
    v = b / np.where(start > 0, start, 1.0)
    c_before, c, s_before, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    live = start > 0
    for step in range(steps):
        y = apply(v)
        alpha = (v * y).sum(0)
        y = y - alpha * v - (beta * v_before if step else 0.0)
        over = np.linalg.norm(y, axis=0)
        was = beta if step else np.zeros_like(beta)
        delta, third = c * alpha - c_before * s * was, s_before * was
        second, first = s * alpha + c_before * c * was, np.hypot(delta, over)
        live &= first > 0
        c_before, s_before = c, s
        safe = np.where(first > 0, first, 1.0)
        c, s = delta / safe, over / safe
        w_before, w = w, (v - third * w_before - second * w) / safe
        x = x + np.where(live, c * eta * w, 0.0)
        eta = -s * eta
        live &= (over > 0) & (np.abs(eta) > tolerance * start)
        if not live.any():
            break
        v_before, v, beta = v, y / np.where(over > 0, over, 1.0), over
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to those before."""
    kept = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(3):
            for basis in (*against, np.array(kept).T if kept else new[:, :0]):
                column = column - basis @ (basis.T @ column)
            left = np.linalg.norm(column)
            if left < 1e-10:
                break
            column = column / left
        else:
            kept.append(column)
    return np.array(kept).T if kept else new[:, :0]


def leading_pairs(product: Product, dims: int, wanted: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator.

    A pair is locked at a residual of ``dims`` roundings of the largest value, or
    when it has not halved for three rounds and is within a hundred times that.
    """
    wanted = min(wanted, dims)
    many = min(dims, wanted + SPARE)
    locked, values = np.zeros((dims, 0)), []
    basis = _orthonormal(product(_orthonormal(np.random.default_rng(seed).normal(size=(dims, many)))))
    if basis.shape[1] < many:
        basis = np.hstack((basis, _orthonormal(np.random.default_rng(seed + 1).normal(size=(dims, many - basis.shape[1])), basis)))
    image = product(basis)
    top, best, idle = 0.0, np.inf, 0
    for _ in range(OUTER):
        theta, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        top = max(top, float(np.abs(theta).max(initial=0.0)))
        rest = image - basis * theta
        rest -= locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        full = locked.shape[1] + basis.shape[1] >= dims
        if len(size):
            idle, best = (0, size[0]) if size[0] < best / 2 else (idle + 1, best)
        done = 0
        while done < len(size) and len(values) + done < wanted and (
                size[done] <= dims * EPS * top or full or (idle >= 3 and size[done] <= 100 * dims * EPS * top)):
            done += 1
        if done:
            values += theta[:done].tolist()
            locked = np.hstack((locked, _orthonormal(basis[:, :done], locked)))
            basis, image, theta, rest, size = basis[:, done:], image[:, done:], theta[done:], rest[:, done:], size[done:]
            best, idle = np.inf, 0
        if len(values) >= wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        if basis.shape[1] > BASIS:
            keep = max(many, BASIS // 2)
            basis, image = basis[:, :keep], image[:, :keep]
        follow = min(many - len(values), basis.shape[1])
        near = np.hstack((locked, basis[:, :follow]))

        def off(z: np.ndarray) -> np.ndarray:
            return z - near @ (near.T @ z)

        shift = theta[:follow]
        step = minres(lambda z: off(product(off(z)) - off(z) * shift), -off(rest[:, :follow]), INNER, 1e-3)
        new = _orthonormal(np.hstack((step, rest[:, :follow])) if not step.any() else step, locked, basis)
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + basis.shape[1]).normal(size=(dims, 1)), locked, basis)
        basis, image = np.hstack((basis, new)), np.hstack((image, product(new))) if new.shape[1] else image
    raise ArithmeticError(f"{wanted - len(values)} components did not settle in {OUTER} rounds")


def fit(rows: DataFrame, components: int = 4) -> Fit | None:
    """Components of the distinct vectors of ``rows`` (_id, _x), all of one length; None without rows."""
    dims = common_length(rows)
    if not dims:
        return None
    distinct = staging.store(rows.select("_x").distinct(), "whiten_fit")
    n, sums = exact_sums(distinct, dims)
    mean = np.array([s / n for s in sums])

    def product(z: np.ndarray) -> np.ndarray:
        def block(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ z)

        return summed(distinct, dims, z.shape, block) / n

    values, vectors = leading_pairs(product, dims, components)
    trace = float(summed(distinct, dims, (dims,), lambda x: ((x - mean) ** 2).sum(0)).sum() / n)
    found = Fit(n, sums, values, vectors, trace, None)
    use = np.isfinite(found.scale)
    if not use.any():
        return found
    turn = (vectors * found.scale)[:, use]
    k = turn.shape[1]
    middle = summed(distinct, dims, (k,), lambda x: ((x - mean) @ turn).sum(0)) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - middle
        return w.T @ w

    error = float(np.abs(summed(distinct, dims, (k, k), spread) / n - np.eye(k)).max())
    return Fit(n, sums, values, vectors, trace, error)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Per row the sum of (n * x - sum)^2, exact; null beyond 64 bits."""
    dims = len(sums)
    reach = int(np.abs(x).max(initial=0)) * n + max(abs(s) for s in sums)
    if reach * reach * dims < 1 << 63:
        return ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
    out = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def whitened(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: int = SCALE) -> DataFrame:
    """Per remaining row and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the sum of (n * x - S)^2 over the entries, ``whitened`` the
    centred row along the component in units of its standard deviation,
    ``explained`` the component's share of the variance. Rows as in
    ``integer_vectors``; of vectors of several lengths only those of the
    commonest take part. Repeated rows all return, the fit takes each vector
    once; null ids are kept. Without variance along a component ``whitened`` is
    null, without any ``explained`` and ``identity_error`` are too; fewer entries
    than components give as many components as entries. An empty table gives no
    row. Other columns are ignored.
    """
    kept = integer_vectors(rows, id_col, vec_col, scale)
    schema = f"`{id_col.replace('`', '``')}` {rows.schema[id_col].dataType.simpleString()}, {SCHEMA}"
    kept = staging.store(kept, "whiten_rows")
    found = fit(kept.where(F.size("_x") == common_length(kept)), components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    dims, k = found.dims, len(found.values)
    turn, mean = found.vectors * found.scale, found.mean
    share = [float(v / found.trace) if found.trace > 0 else None for v in found.values]

    def project(batches):
        for batch in batches:
            x = matrix(batch, dims)
            w = ((x - mean) @ turn).ravel()
            many = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(many), k))), pa.array(np.tile(np.arange(1, k + 1), many), pa.int32()),
                 pa.array(np.full(many * k, found.n)), pa.array(np.repeat(np.array(deviations(x, found.n, found.sums), dtype=object), k), pa.int64()),
                 pa.array(w, mask=np.isnan(w)), pa.array(share * many, pa.float64()), pa.array([found.identity_error] * many * k, pa.float64())],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.where(F.size("_x") == dims).mapInArrow(project, schema)
