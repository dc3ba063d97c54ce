"""From a table with a time column to an ordered series; step, gaps, resampling."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import kinds, numeric_columns, q
from tideframe.operators import axis
from tideframe.operators.axis import ORD, Series
from tideframe.operators.layout import time_of
from tideframe.operators.quantiles import grouped_quantiles

UNIT_SECONDS = {"s": 1, "min": 60, "h": 3600, "d": 86_400, "D": 86_400, "w": 604_800}
RESAMPLERS = ("mean", "sum", "min", "max", "median", "std", "var", "first", "last", "count")


@dataclass
class Cleaned:
    series: Series
    dropped_bad_times: int


def seconds_of(rule: str) -> int:
    """Seconds in a rule such as ``5min``, ``1h`` or ``D``."""
    m = re.fullmatch(r"\s*(\d*)\s*(s|min|h|d|D|w)\s*", rule)
    if not m:
        raise ValueError(f"cannot read the interval {rule!r}")
    return int(m.group(1) or 1) * UNIT_SECONDS[m.group(2)]


def one_row_per_instant(df: DataFrame, time_col: str, tiebreak: str | list[str] | None = None,
                        ts: str = "ts", tz: str | None = None) -> DataFrame:
    """Readable instants only, the last row of each kept.

    Row order means nothing in a distributed table, so "last" is the greatest
    ``tiebreak``; without one it is the greatest row by its columns.
    """
    when = time_of(df, time_col)
    if tz:
        when = F.to_utc_timestamp(when, tz)
    rest = [c for c in df.columns if c != time_col]
    ties = [tiebreak] if isinstance(tiebreak, str) else list(tiebreak or rest)
    rows = df.select(when.alias(ts), *[F.col(q(c)) for c in rest]).where(F.col(ts).isNotNull())
    if not rest:
        return rows.distinct()
    packed = rows.groupBy(ts).agg(F.max_by(F.struct(*[F.col(q(c)) for c in rest]),
                                           F.struct(*[F.col(q(c)) for c in ties])).alias("_row"))
    return packed.select(ts, *[F.col("_row")[c].alias(c) for c in rest])


def to_timeseries(df: DataFrame, time_col: str, tiebreak: str | list[str] | None = None,
                  resample_rule: str | None = None, agg: str = "mean", tz: str | None = None,
                  ts: str = "ts", chunk: int | None = None) -> Cleaned:
    """Sorted series with unique instants and a dense ordinal."""
    if time_col not in df.columns:
        raise KeyError(time_col)
    bad = df.agg(F.count_if(time_of(df, time_col).isNull())).first()[0]
    rows = one_row_per_instant(df, time_col, tiebreak, ts, tz)
    if resample_rule:
        rows = resample(rows, resample_rule, agg, ts)
    return Cleaned(axis.ordinal(rows, [ts], ts, chunk=chunk), bad)


def _bin_aggregate(name: str, agg: str, ts: str) -> Column:
    c = F.col(q(name))
    known = F.when(c.isNotNull(), F.col(ts))
    return {"mean": F.avg(c), "sum": F.sum(c), "min": F.min(c), "max": F.max(c),
            "std": F.stddev_samp(c), "var": F.var_samp(c), "count": F.count(c),
            "first": F.min_by(c, known), "last": F.max_by(c, known)}[agg]


def resample(df: DataFrame, rule: str, agg: str = "mean", ts: str = "ts") -> DataFrame:
    """Fixed bins counted from the first day's midnight; numbers by ``agg``, the
    rest by their last known value; bins without rows appear with NULLs."""
    if agg not in RESAMPLERS:
        raise ValueError(f"unknown aggregate {agg}")
    step = seconds_of(rule)
    types = kinds(df, (ts,))
    bounds = df.agg(F.unix_micros(F.date_trunc("day", F.min(ts))), F.unix_micros(F.min(ts)),
                    F.unix_micros(F.max(ts))).first()
    if bounds[0] is None:
        return df.select(ts, *[F.col(q(c)) for c in types])
    origin, width = bounds[0], step * 1_000_000
    first, last = (bounds[1] - origin) // width, (bounds[2] - origin) // width
    number = F.floor((F.unix_micros(F.col(ts)) - F.lit(origin)) / F.lit(width))
    numbered = df.withColumn("_bin", number)
    plain = {c: k for c, k in types.items() if agg != "median" or k != "numeric"}
    binned = numbered.groupBy("_bin").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[_bin_aggregate(c, agg if k == "numeric" else "last", ts).alias(c) for c, k in plain.items()])
    for c in [c for c in types if c not in plain]:
        binned = binned.join(grouped_quantiles(numbered, ["_bin"], F.col(q(c)), {c: 0.5}), "_bin", "left")
    bins = df.sparkSession.range(first, last + 1).select(F.col("id").alias("_bin"))
    out = bins.join(binned, "_bin", "left")
    empty_is_zero = agg in ("sum", "count")
    cols = [(F.coalesce(F.col(q(c)), F.lit(0)) if empty_is_zero and k == "numeric" else F.col(q(c))).alias(c)
            for c, k in types.items()]
    return out.select(F.timestamp_micros(F.col("_bin") * F.lit(width) + F.lit(origin)).alias(ts), *cols)


def deltas(series: Series) -> DataFrame:
    """Microseconds since the previous instant, one row per instant but the first."""
    narrow = series.with_df(series.df.select(series.ts, ORD))
    with_prev = axis.with_windows(
        narrow, lambda w, once: [once("previous", F.lag(series.ts, 1).over(w)).alias("previous")], lookback=1)
    gap = F.unix_micros(F.col(series.ts)) - F.unix_micros(F.col("previous"))
    return with_prev.where(F.col("previous").isNotNull()).withColumn("gap_us", gap)


def step_table(series: Series) -> DataFrame:
    """How often each spacing occurs, the commonest first, the smaller first on a tie."""
    return (deltas(series).groupBy((F.col("gap_us") / 1e6).alias("step_seconds"))
            .agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "step_seconds"))


def step_seconds(series: Series) -> float | None:
    """The commonest spacing; None under three rows."""
    if series.n < 3:
        return None
    top = step_table(series).limit(1).collect()
    return top[0]["step_seconds"] if top and top[0]["step_seconds"] > 0 else None


def step_minutes(series: Series) -> float | None:
    s = step_seconds(series)
    return None if s is None else s / 60.0


def gap_report(series: Series, step: float | None = None) -> DataFrame:
    """Spacings longer than twice the step (seconds)."""
    step = step if step is not None else step_seconds(series)
    limit = float("inf") if not step else 2.0 * step
    d = deltas(series)
    return (d.where(F.col("gap_us") / 1e6 > F.lit(limit))
            .select(F.col("previous").alias("start"), F.col(series.ts).alias("end"),
                    (F.col("gap_us") / 1e6).alias("duration_seconds")))


def period(df: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``end``, both included. The bounds take the
    column's own type, so that the filter reaches the file scan."""
    c, dtype = F.col(ts), df.schema[ts].dataType
    if start is not None:
        df = df.where(c >= F.lit(start).cast(dtype))
    if end is not None:
        df = df.where(c <= F.lit(end).cast(dtype))
    return df


def last_days(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """From ``days`` before the last instant's day on, up to the end of that day."""
    latest = df.agg(F.max(ts)).first()[0]
    if latest is None:
        return df
    day = F.date_trunc("day", F.lit(latest))
    return df.where((F.col(ts) >= day - F.expr(f"interval {int(days)} days"))
                    & (F.col(ts) < day + F.expr("interval 1 day")))


def with_target(series: Series, target: str) -> Series:
    """Rows whose target is known, renumbered: splits count only these."""
    known = series.df.where(F.col(q(target)).isNotNull()).drop(ORD)
    return axis.ordinal(known, [series.ts], series.ts, chunk=series.chunk, settled=True)


def stride(series: Series, cap: int) -> DataFrame:
    """Every k-th row when there are more than ``cap``."""
    k = max(1, series.n // cap) if series.n > cap else 1
    return series.df.where(F.col(ORD) % F.lit(k) == 0)


def sample_rows(series: Series, size: int, seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows without replacement, the same ones on every run."""
    if series.n <= size:
        return series.df
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ORD).cast("string")))
    return series.df.orderBy(lot, ORD).limit(size)


def numeric(series: Series) -> list[str]:
    return numeric_columns(series.df, (series.ts, ORD))
