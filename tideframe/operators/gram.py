"""Pairwise-complete cross moments of many columns in one pass.

Each task folds its Arrow batches into one block of masked sums, so the shuffle
carries one block per task, never rows. Correlation, covariance, lag scans and
normal equations all read from these sums.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import q
from tideframe.functions.stats import clean_double

MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")
_SCHEMA = "x string, y string, " + ", ".join(f"{m} double" for m in MOMENTS)


@dataclass(frozen=True)
class ColumnSummary:
    """What one pass tells about a column."""

    shift: float
    nulls: int
    rows: int
    variance: float | None


def centres(df: DataFrame, cols: list[str]) -> dict[str, ColumnSummary]:
    """Per column: a shift near its mean (exact for a constant), nulls, rows, population variance."""
    if not cols:
        return {}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = clean_double(F.col(q(c)))
        aggs += [F.when(F.min(x) == F.max(x), F.min(x)).otherwise(F.avg(x)).alias(f"m{i}"),
                 F.count(x).alias(f"k{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    return {c: ColumnSummary(row[f"m{i}"] or 0.0, row["rows"] - row[f"k{i}"], row["rows"], row[f"v{i}"])
            for i, c in enumerate(cols)}


def cross_moments(df: DataFrame, xs: list[str], ys: list[str], shift: dict[str, float]) -> DataFrame:
    """Sums over rows where both columns are known, one row per (x, y) pair."""
    cols = list(dict.fromkeys([*xs, *ys]))
    work = df.select(*[(clean_double(F.col(q(c))) - F.lit(float(shift.get(c, 0.0)))).alias(f"c{i}")
                       for i, c in enumerate(cols)])
    xi, yi = [cols.index(c) for c in xs], [cols.index(c) for c in ys]

    def fold(batches):
        total = np.zeros((len(MOMENTS), len(xi), len(yi)))
        for pdf in batches:
            a = pdf.to_numpy(dtype=float)
            known = ~np.isnan(a)
            v = np.where(known, a, 0.0)
            kx, ky, vx, vy = known[:, xi].astype(float), known[:, yi].astype(float), v[:, xi], v[:, yi]
            total += np.stack([kx.T @ ky, vx.T @ ky, kx.T @ vy, (vx * vx).T @ ky, kx.T @ (vy * vy), vx.T @ vy])
        flat = total.reshape(len(MOMENTS), -1)
        yield pd.DataFrame({"x": np.repeat(xs, len(ys)), "y": np.tile(ys, len(xs)),
                            **{m: flat[k] for k, m in enumerate(MOMENTS)}})

    return work.mapInPandas(fold, _SCHEMA).groupBy("x", "y").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def correlation() -> Column:
    """Pearson r from summed moments; NULL when a side does not vary."""
    n, sx, sy, sxx, syy, sxy = (F.col(m) for m in MOMENTS)
    vx, vy = sxx * n - sx * sx, syy * n - sy * sy
    return F.when((n > 1) & (vx > 0) & (vy > 0), (sxy * n - sx * sy) / F.sqrt(vx * vy))


def correlations(df: DataFrame, xs: list[str], ys: list[str] | None = None) -> DataFrame:
    """(x, y, n, r) for every pair."""
    ys = xs if ys is None else ys
    info = centres(df, list(dict.fromkeys([*xs, *ys])))
    sums = cross_moments(df, xs, ys, {c: s.shift for c, s in info.items()})
    return sums.select("x", "y", F.col("n").cast("bigint").alias("n"), correlation().alias("r"))


def correlation_matrix(df: DataFrame, cols: list[str], null_mode: str = "pairwise",
                       info: dict[str, ColumnSummary] | None = None) -> np.ndarray:
    """p x p matrix on the driver. ``strict`` voids a column that has any null."""
    p = len(cols)
    out = np.full((p, p), np.nan)
    if not p:
        return out
    info = info or centres(df, cols)
    at = {c: i for i, c in enumerate(cols)}
    sums = cross_moments(df, cols, cols, {c: info[c].shift for c in cols})
    for r in sums.select("x", "y", correlation().alias("r")).collect():
        if r["r"] is not None:
            out[at[r["x"]], at[r["y"]]] = min(1.0, max(-1.0, r["r"]))
    if null_mode == "strict":
        for c in cols:
            if info[c].nulls:
                out[at[c], :] = out[:, at[c]] = math.nan
    return out
