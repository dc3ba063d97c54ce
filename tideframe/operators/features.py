"""Backward-looking features with a ledger of where each came from."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec, functions as F, types as T

from tideframe.functions import names as N
from tideframe.functions.names import q
from tideframe.functions.stats import clean_double
from tideframe.operators import axis, timeaxis
from tideframe.operators.axis import ORD, Series

TIME_ORIGIN = "__time__"
STATS = ("mean", "std", "min", "max", "median", "sum", "var", "count")


WIDE = 32       # rows from which a window is put together from blocks


class TargetLeakage(RuntimeError):
    """A feature derived from the target would enter the inputs."""


@dataclass(frozen=True)
class FeatureConfig:
    lags: tuple[int, ...] = (1, 2, 3, 6, 12)
    lag_minutes: tuple[float, ...] = ()
    rolling_minutes: tuple[float, ...] = ()
    rolling_windows: tuple[int, ...] = (6, 12, 24)
    rolling_stats: tuple[str, ...] = ("mean", "std")
    ewm_spans: tuple[int, ...] = (12,)
    diffs: tuple[int, ...] = (1,)
    rate_of_change: bool = False
    time_features: bool = True
    cyclical: bool = True
    interactions: tuple[tuple[str, str], ...] = ()
    interaction_ops: tuple[str, ...] = ("ratio", "diff")
    allow_target_derived: bool = False


@dataclass(frozen=True)
class Origin:
    """One ledger line."""

    feature: str
    origins: tuple[str, ...]
    transform: str
    lookback: int = 0


@dataclass
class Generated:
    series: Series
    ledger: list[Origin]
    config: FeatureConfig

    @property
    def features(self) -> list[str]:
        return [o.feature for o in self.ledger if o.transform != "target"]

    def provenance(self) -> DataFrame:
        return ledger_frame(self.series.df.sparkSession, self.ledger)


def ledger_frame(spark, ledger: list[Origin]) -> DataFrame:
    rows = [(o.feature, list(o.origins), o.transform, o.lookback) for o in ledger]
    return spark.createDataFrame(rows, "feature string, origins array<string>, transform string, lookback int")


def minutes_to_rows(minutes, step_min: float | None) -> list[int]:
    """Row counts for physical minutes; nothing without a known step, nothing under a row."""
    if not step_min or step_min <= 0:
        return []
    rows = {int(round(float(m) / step_min)) for m in minutes or ()}
    return sorted(r for r in rows if r >= 1)


def resolve(cfg: FeatureConfig, step_min: float | None) -> FeatureConfig:
    """Fold minute specs into the row specs, leaving the given config as it was."""
    return replace(
        cfg,
        lags=tuple(sorted({*cfg.lags, *minutes_to_rows(cfg.lag_minutes, step_min)})),
        rolling_windows=tuple(sorted({*cfg.rolling_windows, *minutes_to_rows(cfg.rolling_minutes, step_min)})),
    )


def resolve_for(series: Series, cfg: FeatureConfig) -> FeatureConfig:
    if not cfg.lag_minutes and not cfg.rolling_minutes:
        return cfg
    return resolve(cfg, timeaxis.step_minutes(series))


def time_spec(series: Series, cfg: FeatureConfig) -> DataFrame:
    """How each minute spec was turned into rows."""
    step = timeaxis.step_minutes(series)
    rows = []
    for label, minutes in (("lag", cfg.lag_minutes), ("rolling", cfg.rolling_minutes)):
        for m in minutes:
            got = minutes_to_rows([m], step)
            rows.append((label, float(m), got[0] if got else None,
                         round(got[0] * step, 2) if got else None))
    return series.df.sparkSession.createDataFrame(
        rows, "kind string, minutes double, rows int, actual_minutes double")


def warmup_rows(cfg: FeatureConfig) -> int:
    """The longest look back of a resolved config."""
    return max([0, *cfg.lags, *cfg.rolling_windows, *cfg.ewm_spans, *cfg.diffs])


def drop_warmup(series: Series, cfg: FeatureConfig) -> Series:
    """Cut the first rows, whose features lack a past; a short series stays whole."""
    k = warmup_rows(resolve_for(series, cfg))
    return axis.rebase(series, k) if 0 < k < series.n else series


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    return w.rowsBetween(-(rows - 1), 0)


def rolling(name: str, col: Column, w: WindowSpec, rows: int, stat: str, min_rows: int, once) -> Column:
    """A trailing statistic, NULL until ``min_rows`` known values are in the window.

    Windows of ``WIDE`` rows and more cost the same for any number of rows,
    medians excepted.
    """
    if rows >= WIDE and stat != "median":
        return _rolling_blocks(name, col, w, rows, stat, min_rows, once)
    frame = trailing(w, rows)
    aggregate = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": lambda c: F.percentile(c, 0.5),
                 "sum": F.sum, "var": F.var_samp, "count": F.count}[stat]
    known = once(f"{name}|count|{rows}", F.count(col).over(frame))
    return F.when(known >= min_rows, once(f"{name}|{stat}|{rows}", aggregate(col).over(frame)))


def _rolling_blocks(name: str, col: Column, w: WindowSpec, rows: int, stat: str, min_rows: int, once) -> Column:
    part = axis.blocks(w, rows, once)

    def sides(what: str, e: Column) -> tuple[Column, Column]:
        return axis.both_sides(f"{name}|{what}", e, part, w, once)

    zero = F.lit(0.0)
    n1, n2 = (F.coalesce(n, F.lit(0)) for n in sides("n", F.count(col)))
    known = n1 + n2
    if stat in ("min", "max"):
        pick = F.least if stat == "min" else F.greatest
        out = pick(*sides(stat, F.min(col) if stat == "min" else F.max(col)))       # nulls are skipped
    elif stat == "count":
        out = known
    elif stat in ("mean", "sum"):
        total = sum((F.coalesce(s, zero) for s in sides("sum", F.sum(col))), zero)
        out = total / known if stat == "mean" else total
    else:
        m1, m2 = (F.coalesce(m, zero) for m in sides("mean", F.avg(col)))
        v1, v2 = (F.coalesce(v, zero) for v in sides("var", F.var_pop(col)))
        squares = v1 * n1 + v2 * n2 + F.when((n1 > 0) & (n2 > 0), (m2 - m1) * (m2 - m1) * n1 * n2 / known).otherwise(zero)
        out = F.when(known > 1, squares / (known - 1))
        out = F.sqrt(out) if stat == "std" else out
    return F.when(known >= min_rows, out)


def column_features(name: str, cfg: FeatureConfig, w: WindowSpec, once) -> list[tuple[Column, Origin]]:
    x = clean_double(F.col(q(name)))

    def back(k: int) -> Column:
        return once(f"{name}|lag|{k}", F.lag(x, k).over(w))

    out: list[tuple[Column, Origin]] = []

    def add(label: str, e: Column, transform: str, lookback: int) -> None:
        out.append((e.alias(label), Origin(label, (name,), transform, lookback)))

    for k in cfg.lags:
        add(N.lag_name(name, k), back(k), f"lag({k})", k)
    for rows in cfg.rolling_windows:
        for stat in cfg.rolling_stats:
            if stat in STATS:
                add(N.rolling_name(name, rows, stat), rolling(name, x, w, rows, stat, max(2, rows // 2), once),
                    f"rolling({rows},{stat})", rows)
    for k in cfg.diffs:
        add(N.diff_name(name, k), x - back(k), f"diff({k})", k)
    if cfg.rate_of_change:
        add(N.pct_name(name), F.try_divide(x, back(1)) - 1, "pct_change(1)", 1)
    return out


def interaction_features(cfg: FeatureConfig, known: list[str]) -> list[tuple[Column, Origin]]:
    out = []
    for a, b in cfg.interactions:
        if a not in known or b not in known:
            continue
        xa, xb = clean_double(F.col(q(a))), clean_double(F.col(q(b)))
        if "ratio" in cfg.interaction_ops:
            label = N.ratio_name(a, b)
            out.append((F.try_divide(xa, xb).alias(label), Origin(label, (a, b), "ratio")))
        if "diff" in cfg.interaction_ops:
            label = N.minus_name(a, b)
            out.append(((xa - xb).alias(label), Origin(label, (a, b), "difference")))
    return out


def calendar_features(ts: str, cyclical: bool = True) -> list[tuple[Column, Origin]]:
    when = F.col(ts)
    hour, dow, month = F.hour(when), F.weekday(when), F.month(when)
    made = {"tf__hour": (hour, "hour"), "tf__dayofweek": (dow, "dayofweek"), "tf__month": (month, "month"),
            "tf__is_weekend": ((dow >= 5), "is_weekend")}
    if cyclical:
        for label, value, cycle in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
            angle = value.cast("double") * F.lit(2 * np.pi / cycle)
            made[f"tf__{label}_sin"] = (F.sin(angle), f"{label}_sin")
            made[f"tf__{label}_cos"] = (F.cos(angle), f"{label}_cos")
    return [(e.cast("double").alias(label), Origin(label, (TIME_ORIGIN,), how)) for label, (e, how) in made.items()]


def generate(series: Series, target: str, columns: list[str], cfg: FeatureConfig | None = None) -> Generated:
    """Kept columns, the target, and every derived column, in that order.

    Columns not asked for do not come back. All chunk-window features share one
    window node; calendar and interaction terms are plain expressions.
    """
    cfg = resolve_for(series, cfg or FeatureConfig())
    base = [c for c in columns if c != target and c in series.columns]
    numeric = [c for c in base if c in timeaxis.numeric(series)]
    ledger = [Origin(c, (c,), "raw") for c in base] + [Origin(target, (target,), "target")]
    kept = [series.ts, ORD, *base, *([target] if target in series.columns else [])]
    paired = [c for pair in cfg.interactions for c in pair if c in series.columns]
    extra = [c for c in dict.fromkeys(paired) if c not in kept]
    narrow = series.with_df(series.df.select(*[F.col(q(c)) for c in [*kept, *extra]]))

    ewm_lines = [Origin(N.ewm_name(c, s), (c,), f"ewm({s})", s) for c in numeric for s in cfg.ewm_spans]
    if ewm_lines:
        narrow = narrow.with_df(ewm(narrow, numeric, list(cfg.ewm_spans)))
    windowed: list[Origin] = []

    def build(w: WindowSpec, once) -> list[Column]:
        made = [f for c in numeric for f in column_features(c, cfg, w, once)]
        windowed[:] = [o for _, o in made]
        return [e for e, _ in made]

    lookback = max([0, *cfg.lags, *[r - 1 for r in cfg.rolling_windows], *cfg.diffs, int(cfg.rate_of_change)])
    df = axis.with_windows(narrow, build, lookback=lookback) if numeric else narrow.df
    plain = interaction_features(cfg, [*kept, *extra])
    if cfg.time_features:
        plain += calendar_features(series.ts, cfg.cyclical)
    df = df.select("*", *[e for e, _ in plain]).drop(*extra)
    ledger += _interleave(windowed, ewm_lines, numeric) + [o for _, o in plain]
    made = Generated(series.with_df(df), list({o.feature: o for o in reversed(ledger)}.values())[::-1], cfg)
    assert_no_target_derived(made.features, target, made.ledger, cfg.allow_target_derived)
    return made


def _interleave(windowed: list[Origin], ewm_lines: list[Origin], order: list[str]) -> list[Origin]:
    return [o for c in order for o in [*windowed, *ewm_lines] if o.origins == (c,)]


def target_derived(features: list[str], target: str, ledger: list[Origin]) -> list[str]:
    origins = {o.feature: o.origins for o in ledger}
    return [f for f in features if target in origins.get(f, ())]


def assert_no_target_derived(features: list[str], target: str, ledger: list[Origin], allow: bool = False) -> None:
    bad = [] if allow else target_derived(features, target, ledger)
    if bad:
        raise TargetLeakage("derived from the target: " + ", ".join(bad[:10]))


# --- exponentially weighted mean ------------------------------------------
#
# y is carried along the known values only: at a gap of g rows the old mean has
# weight w = (1 - alpha)^g and the new value weight alpha. Given the first known
# value of a block, its last mean is affine in that first mean, so a block is
# summed up by five numbers and blocks chain from left to right. No look-back is
# cut off, whatever the length of an outage.

_BLOCK = "series_key string, first bigint, x double, gain double, shift double, last bigint"


def _block_end(ords: np.ndarray, x: np.ndarray, alpha: float):
    """(first position, its value, gain, shift, last position) of a block, or None."""
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return None
    tail = x[known[0]:known[-1] + 1]
    zero, unit = tail.copy(), np.where(np.isnan(tail), np.nan, 0.0)
    zero[0], unit[0] = 0.0, 1.0
    end = [pd.Series(v).ewm(alpha=alpha, adjust=False).mean().iloc[-1] for v in (unit, zero)]
    return int(ords[known[0]]), float(x[known[0]]), end[0], end[1], int(ords[known[-1]])


def _enter(state, first: int, x: float, alpha: float) -> float:
    """The mean at a block's first known value, given the state before the block."""
    if state is None:
        return x
    mean, last = state
    w = (1.0 - alpha) ** (first - last)
    return (w * mean + alpha * x) / (w + alpha)


def ewm(series: Series, cols: list[str], spans: list[int]) -> DataFrame:
    """Adds ``{col}__ewm{span}``: the recursive mean with weight 2 / (span + 1)."""
    chunk = series.chunk_rows()
    keys = {f"{i}|{s}": (c, s, 2.0 / (s + 1.0)) for i, c in enumerate(cols) for s in spans}
    alphas = {k: a for k, (_, _, a) in keys.items()}
    df = series.df.withColumns({c: clean_double(F.col(q(c))) for c in cols}) \
                  .withColumn("_chunk", F.floor(F.col(ORD) / F.lit(chunk)))

    def blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ORD)
        ords = pdf[ORD].to_numpy()
        rows = []
        for k, (c, _, alpha) in keys.items():
            end = _block_end(ords, pdf[c].to_numpy(dtype=float), alpha)
            if end is not None:
                rows.append((int(pdf["_chunk"].iloc[0]), k, *end))
        return pd.DataFrame(rows, columns=["block", "series_key", "first", "x", "gain", "shift", "last"])

    ends = (df.select("_chunk", ORD, *[F.col(q(c)) for c in cols]).groupBy("_chunk")
            .applyInPandas(blocks, "block bigint, " + _BLOCK))
    states = _entry_states(ends, alphas, -(-series.n // chunk))
    packed = states.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("series_key", F.struct("mean", "last")))).alias("_states")) \
        .withColumnRenamed("block", "_chunk")
    names = {k: N.ewm_name(c, s) for k, (c, s, _) in keys.items()}
    schema = T.StructType([*df.drop("_chunk").schema.fields,
                           *[T.StructField(label, T.DoubleType()) for label in names.values()]])
    out_cols = schema.names

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(ORD).reset_index(drop=True)
        given = dict(right["_states"].iloc[0]) if len(right) else {}
        ords = left[ORD].to_numpy()
        made = {}
        for k, (c, _, alpha) in keys.items():
            st = given.get(k)
            state = None if st is None else (st["mean"], st["last"])
            x = left[c].to_numpy(dtype=float).copy()
            known = np.flatnonzero(~np.isnan(x))
            y = np.full(len(x), np.nan if state is None else state[0])
            if len(known):
                i = known[0]
                x[i] = _enter(state, int(ords[i]), float(x[i]), alpha)
                y[i:] = pd.Series(x[i:]).ewm(alpha=alpha, adjust=False).mean().to_numpy()
            made[names[k]] = y
        return left.assign(**made)[out_cols]

    return df.groupBy("_chunk").cogroup(packed.groupBy("_chunk")).applyInPandas(apply, schema)


_BLOCKS_PER_SCAN = 4_096


def _entry_states(ends: DataFrame, alphas: dict[str, float], n_blocks: int) -> DataFrame:
    """(block, series_key, mean, last): the state each block starts from.

    Blocks are chained inside runs of 4096; the runs themselves are blocks of a
    shorter series and are chained the same way.
    """
    runs = ends.withColumn("_run", F.floor(F.col("block") / F.lit(_BLOCKS_PER_SCAN)))
    given = None
    if n_blocks > _BLOCKS_PER_SCAN:
        def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
            alpha = alphas[key[1]]
            pdf = pdf.sort_values("block")
            gain, shift = 1.0, 0.0
            first, x, last = int(pdf["first"].iloc[0]), float(pdf["x"].iloc[0]), None
            for r in pdf.itertuples():
                if last is not None:
                    w = (1.0 - alpha) ** (r.first - last)
                    gain, shift = gain * w / (w + alpha), (w * shift + alpha * r.x) / (w + alpha)
                gain, shift, last = r.gain * gain, r.gain * shift + r.shift, r.last
            return pd.DataFrame([(int(key[0]), key[1], first, x, gain, shift, last)],
                                columns=["block", "series_key", "first", "x", "gain", "shift", "last"])

        merged = runs.groupBy("_run", "series_key").applyInPandas(merge, "block bigint, " + _BLOCK)
        given = _entry_states(merged, alphas, -(-n_blocks // _BLOCKS_PER_SCAN)).select(
            F.col("block").alias("_run"), "series_key", F.col("mean").alias("in_mean"), F.col("last").alias("in_last"))
    else:
        given = runs.sparkSession.createDataFrame(
            [], "_run bigint, series_key string, in_mean double, in_last bigint")
    # A run without any known value still hands its incoming state to its blocks.
    joined = runs.join(given, ["_run", "series_key"], "full")

    def chain(key, pdf: pd.DataFrame) -> pd.DataFrame:
        alpha = alphas[key[1]]
        pdf = pdf.sort_values("block")
        mean, last = pdf["in_mean"].iloc[0], pdf["in_last"].iloc[0]
        state = None if pd.isna(last) else (float(mean), int(last))
        by_block = {int(r.block): r for r in pdf.itertuples() if not pd.isna(r.block)}
        top = min((int(key[0]) + 1) * _BLOCKS_PER_SCAN, n_blocks)
        rows = []
        for b in range(int(key[0]) * _BLOCKS_PER_SCAN, top):
            if state is not None:
                rows.append((b, key[1], state[0], state[1]))
            r = by_block.get(b)
            if r is not None:
                state = (r.gain * _enter(state, int(r.first), float(r.x), alpha) + r.shift, int(r.last))
        return pd.DataFrame(rows, columns=["block", "series_key", "mean", "last"])

    return joined.groupBy("_run", "series_key").applyInPandas(
        chain, "block bigint, series_key string, mean double, last bigint")
