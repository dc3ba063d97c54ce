"""Residuals over time: local statistics, drift, outliers, autocorrelation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tideframe.functions.names import numeric_columns, q
from tideframe.functions.stats import clean_double, floor_segment, medians
from tideframe.operators import axis
from tideframe.operators.advice import MAD_SCALE, known_only, lagged_moments
from tideframe.operators.axis import ORD, Series
from tideframe.operators.features import rolling
from tideframe.operators.quantiles import grouped_quantiles


@dataclass(frozen=True)
class ResidualConfig:
    window: int = 96
    n_segments: int = 6
    outlier_sigma: float = 3.0
    max_lag: int = 24


def residuals(actual: DataFrame, predicted: DataFrame, ts: str = "ts", value: str = "label",
              prediction: str = "prediction") -> DataFrame:
    """actual - predicted at the rows both have: by ordinal if both are numbered, so that
    repeated instants do not multiply, else by instant."""
    key = ORD if ORD in actual.columns and ORD in predicted.columns else ts
    a = actual.select(*dict.fromkeys((key, ts)), F.col(q(value)).alias("actual"))
    p = predicted.select(key, F.col(q(prediction)).alias("predicted"))
    both = a.join(p, key).select(ts, "actual", "predicted").withColumn("residual", F.col("actual") - F.col("predicted"))
    return both.where(F.col("residual").isNotNull())


def residual_series(scored: DataFrame, ts: str = "ts", chunk: int | None = None) -> Series:
    """(ts, ord, residual) from a table with ``label`` and ``prediction``."""
    res = scored.select(ts, (F.col("label") - F.col("prediction")).alias("residual"))
    return axis.ordinal(res.where(F.col("residual").isNotNull()), [ts], ts, chunk=chunk)


def rolling_stats(res: Series, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """Trailing mean, std and mean size of the residual."""
    rows = max(int(cfg.window), 2)
    least = max(2, rows // 4)
    x = F.col("residual")
    return axis.with_windows(res, lambda w, once: [
        rolling("residual", x, w, rows, "mean", least, once).alias("roll_mean"),
        rolling("residual", x, w, rows, "std", least, once).alias("roll_std"),
        rolling("size", F.abs(x), w, rows, "mean", least, once).alias("roll_mae")], lookback=rows - 1)


def drift_table(res: Series, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """Statistics of equal runs of rows, and their ratio to the first run."""
    k = max(int(cfg.n_segments), 2)
    spark = res.df.sparkSession
    if res.n < 2 * k:
        return spark.createDataFrame([], "segment int, start timestamp, end timestamp, rows bigint, mean double, "
                                         "std double, MAE double, p95_abs double, MAE_ratio double, std_ratio double")
    x = F.col("residual")
    cut = res.df.withColumn("segment", floor_segment(F.col(ORD), res.n, k) + 1)
    stats = cut.groupBy("segment").agg(
        F.min(res.ts).alias("start"), F.max(res.ts).alias("end"), F.count(F.lit(1)).alias("rows"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(F.abs(x)).alias("MAE"))
    p95 = grouped_quantiles(cut, ["segment"], F.abs(x), {"p95_abs": 0.95})
    out = stats.join(F.broadcast(p95), "segment")
    first = out.where("segment = 1").select(F.col("MAE").alias("_mae"), F.col("std").alias("_std"))
    out = out.crossJoin(F.broadcast(first))             # one row on the right
    ratio = {n: F.when(F.col(b) > 0, F.bround(F.col(c) / F.col(b), 3))
             for n, c, b in (("MAE_ratio", "MAE", "_mae"), ("std_ratio", "std", "_std"))}
    return out.withColumns(ratio).drop("_mae", "_std").orderBy("segment")


def drift_verdict(table: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(drift, worst_ratio, worst_segment, last_ratio), one row."""
    r = F.col("MAE_ratio")
    known = F.when(r.isNotNull(), F.struct(r, -F.col("segment")))
    return table.agg(F.coalesce(F.max(r) >= threshold, F.lit(False)).alias("drift"),
                     F.max(r).alias("worst_ratio"), F.max_by("segment", known).alias("worst_segment"),
                     F.max_by("MAE_ratio", F.when(r.isNotNull(), F.col("segment"))).alias("last_ratio"))


def robust_scale(df: DataFrame, col: str, rows_at_most: int | None = None) -> tuple[float | None, float | None]:
    """Median and 1.4826 MAD; the standard deviation where the MAD is 0."""
    x = F.col(q(col))
    mid = medians(df, {"m": x}, rows_at_most=rows_at_most)["m"]
    if mid is None:
        return None, None
    mad = medians(df, {"m": F.abs(x - F.lit(mid))}, rows_at_most=rows_at_most)["m"]
    scale = mad * MAD_SCALE if mad > 0 else df.agg(F.stddev_samp(x)).first()[0]
    return mid, scale if scale and scale > 0 else None


def outliers(res: Series, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """Rows whose robust z reaches the limit, the farthest first."""
    mid, scale = robust_scale(res.df, "residual", res.n)
    if scale is None:
        return res.df.where(F.lit(False)).select(
            res.ts, "residual", F.lit(0.0).alias("robust_z"), F.lit("").alias("direction"))
    z = (F.col("residual") - F.lit(mid)) / F.lit(scale)
    return (res.df.withColumn("z", z).where(F.abs("z") >= cfg.outlier_sigma)
            .select(res.ts, F.bround("residual", 4).alias("residual"), F.bround("z", 3).alias("robust_z"),
                    F.when(F.col("z") > 0, "under-predicted").otherwise("over-predicted").alias("direction"))
            .orderBy(F.desc(F.abs("robust_z")), res.ts))


def autocorrelation(res: Series, max_lag: int = 24, value: str = "residual") -> DataFrame:
    """(lag, acf): sums of products of centred values over their total square."""
    dense = known_only(res, F.col(q(value)))
    lags = list(range(1, min(max_lag, dense.n - 1) + 1))
    spark = res.df.sparkSession
    empty = spark.createDataFrame([], "lag int, acf double")
    if not lags:
        return empty
    mean = dense.df.agg(F.avg("_v")).first()[0]
    square = dense.df.agg(F.sum((F.col("_v") - F.lit(mean)) ** 2)).first()[0]
    if not square or square <= 0:
        return empty
    return (lagged_moments(dense, lags, mean)
            .select("lag", F.bround(F.col("sxy") / F.lit(square), 4).alias("acf")).orderBy("lag"))


def series_autocorr(series: Series, col: str, lag: int = 1) -> float | None:
    """One lag of the same, unrounded."""
    dense = known_only(series, clean_double(F.col(q(col))))
    if dense.n <= lag + 1:
        return None
    mean = dense.df.agg(F.avg("_v")).first()[0]
    square = dense.df.agg(F.sum((F.col("_v") - F.lit(mean)) ** 2)).first()[0]
    return lagged_moments(dense, [lag], mean).first()["sxy"] / square if square and square > 0 else None


def distribution_drift(series: Series, target: str, cols: list[str] | None = None, n_segments: int = 3) -> DataFrame:
    """(y_shift_sd, x_shift_sd, x_shift_max): head against tail, in standard deviations."""
    spark = series.df.sparkSession
    schema = "y_shift_sd double, x_shift_sd double, x_shift_max double"
    if series.n < n_segments * 10:
        return spark.createDataFrame([(None, None, None)], schema)
    k = series.n // n_segments
    cols = cols if cols is not None else [c for c in numeric_columns(series.df, (series.ts, ORD)) if c != target]
    head, tail = axis.in_range(0, k), axis.in_range(series.n - k, series.n)
    aggs = []
    for i, c in enumerate([target, *cols]):
        x = clean_double(F.col(q(c)))
        aggs += [F.abs(F.avg(F.when(tail, x)) - F.avg(F.when(head, x))).alias(f"d{i}"), F.stddev_samp(x).alias(f"s{i}")]
    r = series.df.agg(*aggs).first()
    y = r["d0"] / (r["s0"] or 1.0) if r["d0"] is not None else None
    xs = [r[f"d{i}"] / r[f"s{i}"] for i in range(1, len(cols) + 1) if r[f"s{i}"] and r[f"d{i}"] is not None]
    row = (round(y, 4) if y is not None else None, round(sum(xs) / len(xs), 4) if xs else None,
           round(max(xs), 4) if xs else None)
    return spark.createDataFrame([row], schema)


def split_gap_causes(gap: float, series: Series, target: str, cols: list[str] | None = None,
                     threshold: float = 0.15, acf_threshold: float = 0.5, drift_threshold: float = 0.5) -> DataFrame:
    """(cause, value, limit): what may explain a random split scoring better than a time split."""
    acf = series_autocorr(series, target, 1)
    shift = distribution_drift(series, target, cols).first()
    found = []
    for cause, value, limit in (("autocorrelation", acf, acf_threshold),
                                ("target drift", shift["y_shift_sd"], drift_threshold),
                                ("input drift", shift["x_shift_max"], 2 * drift_threshold)):
        if value is not None and value >= limit:
            found.append((cause, float(value), float(limit)))
    if gap >= threshold and not found:
        found.append(("lag mismatch", float(gap), float(threshold)))
    return series.df.sparkSession.createDataFrame(found, "cause string, value double, limit double")


def summary(res: Series, cfg: ResidualConfig = ResidualConfig()) -> DataFrame:
    """One row: n, mean, std, MAE, bias ratio, lag-1 autocorrelation, outliers."""
    x = F.col("residual")
    mae = F.avg(F.abs(x))
    lag1 = series_autocorr(res, "residual", 1)
    mid, scale = robust_scale(res.df, "residual", res.n)
    far = F.count_if(F.abs((x - F.lit(mid)) / F.lit(scale)) >= cfg.outlier_sigma) if scale else F.lit(0).cast("bigint")
    return res.df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                      mae.alias("MAE"), F.coalesce(F.try_divide(F.avg(x), mae), F.lit(0.0)).alias("bias_ratio"),
                      F.lit(None if lag1 is None else round(lag1, 4)).cast("double").alias("lag1_acf"),
                      far.alias("outliers"))
