"""Ridge models of many ordinal ranges from one pass over the rows.

The bounds of all ranges cut the ordinal into segments. One pass gives the
pairwise-complete cross moments of every segment, and a range's are the sums of
its segments'. Filling missing values with constants, centring, scaling, dropping
correlated columns and the ridge itself are then arithmetic on matrices of the
number of columns, however many folds share the rows. Ranges that begin together
share one forward fill, too. Medians of all ranges come
from counts of values between cut points per segment, closed in on exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import q
from tideframe.functions.stats import GAP_ROWS, bucketed, clean_double
from tideframe.operators import axis, gram, models as M, prep as P, select as S, split as SP
from tideframe.operators.axis import ORD, Series
from tideframe.operators.scores import REGRESSION

IMPUTERS, SCALERS = ("ffill", "median", "mean", "zero", "interpolate"), ("standard", "none")
FIRST_CUTS = sorted({*(i / 32 for i in range(1, 32)), *(0.5 + i / 200 for i in range(-10, 11))})
NEXT_CUTS = [i / 64 for i in range(1, 64)]
ALL, LABELLED = 0, 1


@dataclass(frozen=True)
class RangeModel:
    """What was learnt on one range: preprocessing, the columns kept, and the line through them."""

    rng: SP.Range
    prep: P.FittedPrep
    names: list[str]
    coefficients: list[float]
    intercept: float
    rows: int

    def expression(self) -> Column:
        """The prediction of a raw row."""
        total = F.lit(self.intercept)
        for c, w in zip(self.names, self.coefficients):
            filled = F.coalesce(clean_double(F.col(q(c))), F.lit(self.prep.fill[c]))
            ready = (filled - F.lit(self.prep.centre[c])) / F.lit(self.prep.scale[c]) if c in self.prep.centre else filled
            total = total + F.lit(w) * ready
        return total


def applies(series: Series, features: list[str], cfg: M.FitConfig, ranges: list[SP.Range]) -> bool:
    """Whether moments say all: numeric columns, fills that ranges share, no clipping, no cut by mutual information."""
    p = cfg.prep
    if not ranges or not all(len(r) for r in ranges) or p.impute_numeric == "ffill" and len({r.lo for r in ranges}) > 1:
        return False
    numeric, categorical = P.column_types(series, features)
    return (cfg.task == REGRESSION and bool(numeric) and not categorical and not cfg.top_k and not p.clip_outliers
            and p.impute_numeric in IMPUTERS and p.scaler in SCALERS)


def _segments(ranges: list[SP.Range]) -> tuple[list[int], list[list[int]]]:
    """Cut points, and the segments of each range; segment i ends before cut i."""
    cuts = sorted({b for r in ranges for b in (r.lo, r.hi)})
    return cuts, [[i for i in range(1, len(cuts)) if r.lo <= cuts[i - 1] and cuts[i] <= r.hi] for r in ranges]


def _segment(cuts: list[int]) -> Column:
    return sum((F.when(F.col(ORD) >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def segment_moments(rows: DataFrame, p: int) -> DataFrame:
    """(seg, kind, x, y, moments) of rows (seg, c0 .. cp): column p is the target; kind
    ``ALL`` sums over all rows, ``LABELLED`` over those that have it."""
    def fold(batches):
        totals: dict[int, np.ndarray] = {}
        for pdf in batches:
            seg, a = pdf["seg"].to_numpy(), pdf.iloc[:, 1:].to_numpy(dtype=float)
            for s in np.unique(seg):
                v = a[seg == s]
                known = ~np.isnan(v)
                sums = []
                for rows_ in (np.ones(len(v), dtype=bool), known[:, p]):
                    k, x = known[rows_].astype(float), np.where(known[rows_], v[rows_], 0.0)
                    sums.append(np.stack([k.T @ k, x.T @ k, k.T @ x, (x * x).T @ k, k.T @ (x * x), x.T @ x]))
                new = np.append(np.stack(sums).reshape(2, len(gram.MOMENTS), -1).ravel(), [len(v), known[:, p].sum()])
                totals[s] = totals.get(s, 0.0) + new
        for s, total in totals.items():
            yield pd.DataFrame({"seg": np.full(len(total), s, dtype="int32"), "at": np.arange(len(total), dtype="int32"), "v": total})

    return rows.mapInPandas(fold, "seg int, at int, v double").groupBy("seg", "at").agg(F.sum("v").alias("v"))


def range_medians(rows: DataFrame, cols: list[str], members: list[list[int]]) -> list[dict[str, float | None]]:
    """Per range the exact median of each column of rows (seg, cols...), nulls skipped; a range is a list of segments."""
    inside = {r: F.col("seg").isin([int(s) for s in segs]) if segs else F.lit(False) for r, segs in enumerate(members)}
    first = rows.agg(*[F.percentile_approx(c, F.array(*[F.lit(float(p)) for p in FIRST_CUTS]), 10_000).alias(c) for c in cols]).first()
    cuts = {c: sorted(set(first[c] or [])) for c in cols}
    out: list[dict[str, float | None]] = [dict.fromkeys(cols) for _ in members]
    found: dict[tuple[int, str], dict[int, float]] = {}
    todo: dict[tuple[int, str], tuple[float, float, int, list[int]]] = {}     # low, high, rows at or under low, ranks
    begun = False
    while not begun or todo:
        live = [c for c in cols if cuts[c]]
        counts: dict[str, dict[int, dict[int, int]]] = {c: {} for c in cols}
        if live:
            cut = bucketed(rows.select("seg", *[(F.col(c) + 0.0).alias(c) for c in live]), {c: cuts[c] for c in live}, {c: f"b_{c}" for c in live}, equal=True)
            tall = cut.select("seg", *[F.when(F.col(c).isNotNull(), F.col(f"b_{c}").cast("int")).alias(c) for c in live]).unpivot(["seg"], live, "c", "bin")
            for r in tall.where("bin is not null").groupBy("seg", "c", "bin").count().collect():
                counts[r["c"]].setdefault(r["seg"], {})[r["bin"]] = r["count"]
        ranked = {}
        for r, segs in enumerate(members):
            for c in live:
                per = np.zeros(2 * len(cuts[c]) + 1, dtype=np.int64)
                for s in segs:
                    for b, n in counts[c].get(s, {}).items():
                        per[b] += n
                upto = np.cumsum(per)
                if not begun and upto[-1]:
                    ranks = sorted({(int(upto[-1]) - 1) // 2, int(upto[-1]) // 2})
                elif (r, c) in todo:
                    ranks = todo[r, c][3]
                else:
                    continue
                for rank in ranks:
                    b = int(np.searchsorted(upto, rank, "right"))
                    if b % 2:
                        found.setdefault((r, c), {})[rank] = cuts[c][b // 2]
                    else:
                        low = cuts[c][b // 2 - 1] if b else -math.inf
                        high = cuts[c][b // 2] if b // 2 < len(cuts[c]) else math.inf
                        ranked.setdefault((r, c), {}).setdefault((low, high, int(upto[b] - per[b]), int(per[b])), []).append(rank)
        begun, todo, cuts = True, {}, {c: [] for c in cols}
        gaps = [(r, c, *gap, ranks) for (r, c), per in ranked.items() for gap, ranks in per.items()]
        for r, c, low, high, before, size, ranks in [g for g in gaps if g[5] <= GAP_ROWS]:
            part = rows.where(inside[r] & (F.col(c) > F.lit(low)) & (F.col(c) < F.lit(high))).select(c).collect()     # GAP_ROWS at most
            values = sorted(x[0] for x in part)
            found.setdefault((r, c), {}).update({rank: values[rank - before] for rank in ranks})
        large = [g for g in gaps if g[5] > GAP_ROWS]
        if large:
            grid = F.array(*[F.lit(p) for p in NEXT_CUTS])
            got = rows.agg(*[F.percentile_approx(F.when(inside[r] & (F.col(c) > F.lit(low)) & (F.col(c) < F.lit(high)), F.col(c)), grid, 10_000).alias(f"g{i}")
                             for i, (r, c, low, high, *_) in enumerate(large)]).first()
            for i, (r, c, low, high, before, size, ranks) in enumerate(large):
                old = todo.get((r, c))
                todo[r, c] = (low, high, before, sorted({*ranks, *(old[3] if old else [])}))
                cuts[c] = sorted({*cuts[c], *got[i]})
    for (r, c), values in found.items():
        out[r][c] = sum(values.values()) / len(values)
    return out


def ridge_ranges(series: Series, target: str, features: list[str], ranges: list[SP.Range], cfg: M.FitConfig = M.FitConfig(),
                 alpha: float = 1.0) -> list[RangeModel]:
    """What ``prepare`` and the ridge would learn on each range, from shared sums."""
    if not applies(series, features, cfg, ranges):
        raise ValueError("these settings need the rows themselves; fit each range by itself")
    cuts, members = _segments(ranges)
    p = len(features)
    inner = series.df.where((F.col(ORD) >= F.lit(cuts[0])) & (F.col(ORD) < F.lit(cuts[-1])))
    names = [f"c{i}" for i in range(p + 1)]
    raw = rows = inner.select(ORD, _segment(cuts).alias("seg"), *[clean_double(F.col(q(c))).alias(n) for n, c in zip(names, [*features, target])])
    if cfg.prep.impute_numeric == "ffill":
        rows = axis.last_seen(series.with_df(raw), {c: F.col(c) for c in names[:p]})
    middle = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([middle[c] or 0.0 for c in names])
    shifted = rows.select("seg", *[(F.col(c) - F.lit(float(s))).alias(c) for c, s in zip(names, shift)])
    width = 2 * len(gram.MOMENTS) * (p + 1) ** 2
    sums = np.zeros((len(cuts), width + 2))
    for r in segment_moments(shifted, p).collect():        # a few matrices of the number of columns per segment
        sums[r["seg"], r["at"]] = r["v"]
    if cfg.prep.impute_numeric in ("ffill", "median", "interpolate"):
        fills = [[m[c] for c in names[:p]] for m in range_medians(raw, names[:p], members)]
    else:
        fills = None
    out = []
    for k, (rng, segs) in enumerate(zip(ranges, members)):
        total = sums[segs].sum(0)
        moments = total[:width].reshape(2, len(gram.MOMENTS), p + 1, p + 1)
        n_all, n = total[width:]
        known, first = np.diag(moments[ALL, 0])[:p], np.diag(moments[ALL, 1])[:p]
        if cfg.prep.impute_numeric == "zero":
            fill = np.zeros(p)
        elif fills is None:
            fill = np.where(known > 0, first / np.maximum(known, 1) + shift[:p], 0.0)
        else:
            fill = np.array([0.0 if f is None else f for f in fills[k]])
        mean, cross = _filled(moments[ALL], n_all, np.append(fill - shift[:p], 0.0), p)
        spread = np.sqrt(np.maximum(np.diag(cross), 0.0))
        flat = spread <= 1e-9 * np.maximum(1e-300, np.abs(mean + shift[:p]))
        spread[flat] = 0.0
        fitted = P.FittedPrep(list(features), [], cfg.prep, dict(zip(features, fill.tolist())))
        scale = np.ones(p)
        if cfg.prep.scaler == "standard":
            scale = np.where(spread > 0, spread, 1.0)
            fitted.centre, fitted.scale = dict(zip(features, (mean + shift[:p]).tolist())), dict(zip(features, scale.tolist()))
        kept = list(range(p))
        if cfg.fold_selection:
            kept = [i for i in kept if (spread[i] / scale[i]) ** 2 > cfg.min_variance]
            if len(kept) > 1:
                matrix = cross[np.ix_(kept, kept)] / np.outer(spread[kept], spread[kept])
                gone = S.correlated_away(matrix, cfg.corr_threshold)
                kept = [c for i, c in enumerate(kept) if i not in gone]
            kept = kept or list(range(p))
        centre, both = _filled(moments[LABELLED], n, np.append(fill - shift[:p], 0.0), p + 1)
        own = both[np.ix_(kept, kept)] / np.outer(scale[kept], scale[kept]) * n
        right = both[kept, p] / scale[kept] * n
        coef = np.linalg.lstsq(own + alpha * np.eye(len(kept)), right, rcond=None)[0] if n else np.zeros(len(kept))
        used = (centre[:p] + shift[:p])[kept]
        offset = (mean + shift[:p])[kept] if cfg.prep.scaler == "standard" else np.zeros(len(kept))
        intercept = centre[p] + shift[p] - coef @ ((used - offset) / scale[kept]) if n else 0.0
        out.append(RangeModel(rng, fitted, [features[i] for i in kept], coef.tolist(), float(intercept), int(n)))
    return out


def _filled(m: np.ndarray, n: float, fill: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances of the first ``width`` columns, their missing values filled by constants."""
    if not n:
        return np.zeros(width), np.zeros((width, width))
    pair, sx, sxy = m[0], m[1], m[5]            # rows both know; sums of x over them; of x * y
    known, whole, f = np.diag(pair), np.diag(sx), fill
    mean = (whole + f * (n - known)) / n
    x_alone = whole[:, None] - sx                               # x where y is missing
    neither = n - known[:, None] - known[None, :] + pair
    cross = sxy + x_alone * f[None, :] + x_alone.T * f[:, None] + neither * np.outer(f, f)
    return mean[:width], (cross / n - np.outer(mean, mean))[:width, :width]


def predict_ranges(series: Series, target: str, fits: list[tuple[int, RangeModel, SP.Range]]) -> DataFrame:
    """(ord, ts, label, fold, prediction) of each test range by its model, in one scan; a row in
    several ranges has several. A forward fill starts anew with each range."""
    folds = F.explode(F.array_compact(F.array(*[F.when(test.where(), F.lit(k)) for k, _, test in fits]))).alias("fold")
    rows = series.df.select("*", clean_double(F.col(q(target))).alias("label"), folds)
    carried = sorted({c for _, m, _ in fits if m.prep.cfg.impute_numeric == "ffill" for c in m.names})
    if carried:
        rows = axis.last_seen(series.with_df(rows), {c: clean_double(F.col(q(c))) for c in carried}, by=["fold"])
    answer = F.coalesce(*[F.when(F.col("fold") == k, m.expression()) for k, m, _ in fits])
    return rows.select(ORD, series.ts, "label", "fold", answer.alias("prediction"))
