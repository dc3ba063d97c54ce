import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_series, pandas_of, walk
from tideframe.operators import advice, axis, gram, quality


def test_profile_of_a_gappy_frame(spark, gappy):
    got = quality.profile(as_series(spark, gappy, 50)).toPandas().set_index("column")
    for c in ("a", "b", "sparse", "flat"):
        known = gappy[c].dropna()
        assert got.loc[c, "missing_ratio"] == round(gappy[c].isna().mean(), 4)
        assert got.loc[c, "n_unique"] == known.nunique()
        assert got.loc[c, "flatline_ratio"] == round((known.diff() == 0).mean(), 4)
        q1, q3 = known.quantile(0.25), known.quantile(0.75)
        out = ((known < q1 - 1.5 * (q3 - q1)) | (known > q3 + 1.5 * (q3 - q1))).mean() if q3 > q1 else 0.0
        assert got.loc[c, "outlier_ratio"] == round(out, 4)
        np.testing.assert_allclose(got.loc[c, "std"], known.std(), rtol=1e-9)


def test_drops_name_every_reason_and_spare_the_protected(spark, gappy):
    s = as_series(spark, gappy.assign(copy=gappy["a"] * 2, y=7.0))
    pairs = quality.correlated_pairs(s.df, ["a", "b", "copy"], 0.95)
    got = {r["column"]: r["reason"] for r in quality.suggest_drops(quality.profile(s), protect=["y"], pairs=pairs).collect()}
    assert set(got) == {"a", "b", "flat", "sparse"}
    assert got["flat"] == "constant, flatline" and got["b"] == got["sparse"] == "missing"
    assert got["a"] == "correlates 1.00 with copy"


def test_correlations_are_pairwise_complete(spark, gappy):
    got = gram.correlations(as_series(spark, gappy).df, ["a", "b", "sparse", "flat"]).toPandas()
    want = gappy[["a", "b", "sparse", "flat"]].corr()
    for r in got.itertuples():
        w = want.loc[r.x, r.y]
        assert (pd.isna(r.r) and pd.isna(w)) or abs(r.r - w) < 1e-9
    strict = gram.correlation_matrix(as_series(spark, gappy).df, ["a", "y"], "strict")
    assert np.isnan(strict[0]).all() and strict[1, 1] == pytest.approx(1.0)


def test_large_offsets_do_not_spoil_correlation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    pdf = pd.DataFrame({"x": x + 1e9, "z": x + rng.normal(size=500) * 0.1 - 1e9})
    r = gram.correlations(spark.createDataFrame(pdf), ["x"], ["z"]).first()["r"]
    assert abs(r - pdf["x"].corr(pdf["z"])) < 1e-6


def test_fingerprint_sees_any_value_but_not_the_order(spark):
    df = spark.createDataFrame(walk(200, 1))
    key = lambda d: quality.fingerprint(d, "ts").first()["fingerprint"]
    changed = df.withColumn("x1", F.when(F.col("ts") == F.lit("2024-01-01 05:05:00").cast("timestamp"), 0.0)
                            .otherwise(F.col("x1")))
    assert key(df) == key(df.repartition(7)) != key(changed)


def test_missing_runs(spark, gappy):
    got = advice.missing_profile(as_series(spark, gappy, 40)).toPandas().set_index("column")
    for c in ("a", "b", "sparse", "flat"):
        na = gappy[c].isna()
        runs = na[na].groupby((na != na.shift()).cumsum()[na]).size()
        assert got.loc[c, "runs"] == len(runs) and got.loc[c, "longest"] == (runs.max() if len(runs) else 0)
        assert got.loc[c, "mean_run"] == pytest.approx(runs.mean() if len(runs) else 0.0)


def test_trailing_and_total_gaps(spark):
    n = 60
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=n, freq="h"), "tail": [1.0] * 50 + [None] * 10, "v": 1.0})
    s = as_series(spark, pdf, 16)
    s = s.with_df(s.df.withColumn("never", F.lit(None).cast("double")))
    got = advice.missing_profile(s, ["tail", "never"]).toPandas().set_index("column")
    assert got.loc["tail", ["runs", "longest"]].tolist() == [1, 10]
    assert got.loc["never", ["runs", "longest"]].tolist() == [1, 60]


def test_impute_advice_follows_the_usual_column(spark):
    rng = np.random.default_rng(2)
    n = 400
    short, long = np.arange(n) * 1.0, np.arange(n) * 1.0
    short[[5, 90, 200]] = np.nan
    long[50:150] = long[200:260] = np.nan
    base = {"ts": pd.date_range("2024", periods=n, freq="5min")}
    def ask(**cols):
        return advice.recommend_impute(as_series(spark, pd.DataFrame({**base, **cols})))
    assert ask(a=rng.normal(size=n)).confidence == "high"
    assert ask(a=short).value == "ffill"
    assert ask(a=long, b=long).value == "median"
    assert ask(a=short, b=short, c=short, d=long).value == "ffill"


def test_spike_on_a_constant_is_an_outlier(spark):
    v = np.full(300, 5.0)
    v[100] = 500.0
    df = spark.createDataFrame(pd.DataFrame({"spike": v, "calm": np.sin(np.arange(300.0))}))
    prof = advice.scale_profile(df).toPandas().set_index("column")
    assert prof.loc["spike", "max_robust_z"] > 10 and prof.loc["spike", "n_over_5"] == 1
    assert advice.recommend_scaler(df).value == "robust" and advice.recommend_clip(df).value is True
    assert advice.recommend_clip(df.select("calm")).value is False


@pytest.mark.parametrize("lag", [6, 12])
def test_planted_lag_is_found(spark, lag):
    rng = np.random.default_rng(3)
    n = 1500
    flow = np.cumsum(rng.normal(size=n))
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=n, freq="5min"), "flow": flow, "noise": rng.normal(size=n),
                        "y": np.roll(flow, lag) + rng.normal(size=n) * 0.05})[lag:]
    s = as_series(spark, pdf, 200)
    scan = advice.lag_scan(s, "y").toPandas().set_index("tag")
    assert scan.loc["flow", "best_lag"] == lag
    got = advice.recommend_lags(s, "y", step_min=5.0)
    assert lag in got.value and 1 in got.value and got.confidence == "high"
    capped = advice.recommend_lags(s, "y", step_min=5.0, limits=advice.PhysicalLimits(max_lag_minutes=20))
    assert max(capped.value) <= 4


def test_lag_correlations_use_every_row(spark, gappy):
    s = as_series(spark, gappy, 100)
    got = advice.lag_correlations(s, "y", ["a", "b"], [0, 3, 48]).toPandas()
    for r in got.itertuples():
        assert r.r == pytest.approx(gappy[r.tag].shift(r.lag).corr(gappy["y"]), abs=1e-10)


def test_windows_follow_the_autocorrelation(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=2000, freq="5min"),
                        "y": pd.Series(rng.normal(size=2000)).ewm(alpha=0.1).mean()})
    s = as_series(spark, pdf)
    acf = {r["lag"]: r["autocorrelation"] for r in advice.autocorr_profile(s, "y").collect()}
    assert acf[4] == pytest.approx(pdf["y"].autocorr(4), abs=1e-4)
    half = next(k for k in sorted(acf) if acf[k] < 0.5)
    assert advice.recommend_rolling(s, "y").value[-1] == half


def test_encodings(spark):
    df = spark.createDataFrame([("A", "on", str(i), "LOW") for i in range(30)] + [("B", "off", "x", "HIGH")],
                               "mark string, state string, tag string, band string")
    assert advice.recommend_encoding(df, ["mark", "band"]).value == "ordinal"
    got = advice.recommend_encoding(df)
    assert got.value == "onehot" and got.notes
    assert advice.categorical_profile(df, ["tag"], 3).first()["examples"] == ["0", "1", "10"]
    assert pandas_of(advice.categorical_profile(df), "column")["n_unique"].tolist() == [2, 2, 2, 31]


def test_missing_grid_shows_every_column(spark):
    wide = spark.range(30).select(F.col("id").alias("ts"), *[F.lit(1.0).alias(f"c{i}") for i in range(41)])
    s = axis.ordinal(wide, ["ts"])
    assert len(quality.missing_grid(s, [f"c{i}" for i in range(41)], 5).columns) == 43
