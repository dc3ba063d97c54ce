import numpy as np
import pandas as pd
import pytest

from tests.conftest import as_series, pandas_of, walk
from tideframe.operators import axis, features as FE

CFG = FE.FeatureConfig(lags=(1, 3), rolling_windows=(6, 9), rolling_stats=("mean", "std", "min", "max", "median"),
                       ewm_spans=(4, 12), diffs=(1, 2), rate_of_change=True)


def reference_values(x: pd.Series, name: str) -> dict:
    out = {f"{name}__lag{k}": x.shift(k) for k in CFG.lags}
    out |= {f"{name}__roll{w}_{s}": getattr(x.rolling(w, min_periods=max(2, w // 2)), s)()
            for w in CFG.rolling_windows for s in CFG.rolling_stats}
    out |= {f"{name}__ewm{k}": x.ewm(span=k, adjust=False).mean() for k in CFG.ewm_spans}
    out |= {f"{name}__diff{k}": x.diff(k) for k in CFG.diffs}
    ratio = x / x.shift(1)
    out[f"{name}__pct1"] = (ratio - 1).replace([np.inf, -np.inf], np.nan)
    return out


@pytest.mark.parametrize("chunk", [9, 64, 100_000])
def test_features_equal_pandas_for_any_chunk(spark, gappy, chunk):
    made = FE.generate(as_series(spark, gappy, chunk), "y", ["a", "b", "sparse"], CFG)
    got = pandas_of(made.series.df)
    for c in ("a", "b", "sparse"):
        for name, want in reference_values(gappy[c], c).items():
            np.testing.assert_allclose(got[name].astype(float), want, atol=1e-9, err_msg=name)


def test_ewm_survives_outages_longer_than_a_run_of_blocks(spark, gappy, monkeypatch):
    monkeypatch.setattr(FE, "_BLOCKS_PER_SCAN", 3)
    s = as_series(spark, gappy, 10)
    got = pandas_of(FE.ewm(s, ["b", "sparse"], [12]))
    for c in ("b", "sparse"):
        np.testing.assert_allclose(got[f"{c}__ewm12"], gappy[c].ewm(span=12, adjust=False).mean(), atol=1e-9)


def test_later_rows_cannot_change_earlier_features(spark):
    pdf = walk(300, 1)
    broken = pdf.copy()
    broken.loc[200:, ["x1", "x2"]] = 1e6
    a, b = (pandas_of(FE.generate(as_series(spark, p, 32), "y", ["x1", "x2"], CFG).series.df)[:200] for p in (pdf, broken))
    pd.testing.assert_frame_equal(a, b)


def test_ledger_names_and_target_guard(spark):
    s = as_series(spark, walk(100, 2))
    made = FE.generate(s, "y", ["x1", "y"], FE.FeatureConfig(interactions=(("x1", "x2"),)))
    assert "y__lag1" not in made.features and "x2" not in made.series.df.columns
    by_name = {o.feature: o for o in made.ledger}
    assert by_name["x1__over__x2"].origins == ("x1", "x2")
    assert by_name["x1__roll12_mean"].lookback == 12
    assert set(made.features) == set(made.series.columns) - {"y"}
    assert made.provenance().count() == len(made.ledger)
    with pytest.raises(FE.TargetLeakage):
        FE.generate(s, "y", ["x1"], FE.FeatureConfig(interactions=(("x1", "y"),)))


def test_minutes_become_rows_and_warmup_is_cut(spark):
    s = as_series(spark, walk(200, 3))
    cfg = FE.FeatureConfig(lags=(1,), lag_minutes=(60, 2), rolling_minutes=(200,), rolling_windows=(), ewm_spans=(), diffs=())
    resolved = FE.resolve_for(s, cfg)
    assert resolved.lags == (1, 12) and resolved.rolling_windows == (40,)
    assert FE.warmup_rows(resolved) == 40 and FE.drop_warmup(s, cfg).n == 160
    assert FE.minutes_to_rows([60], None) == []
    assert FE.drop_warmup(axis.rebase(s, 0, 30), cfg).n == 30


def test_no_window_spans_the_whole_series(spark):
    made = FE.generate(as_series(spark, walk(100, 4)), "y", ["x1"], CFG)
    plan = made.series.df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    assert windows and all("_chunk" in line.split("windowspecdefinition")[1][:40] for line in windows)


def test_calendar(spark):
    s = as_series(spark, walk(600, 5))
    got = pandas_of(FE.generate(s, "y", ["x1"], FE.FeatureConfig(lags=(), rolling_windows=(), ewm_spans=(), diffs=())).series.df)
    t = pd.DatetimeIndex(got["ts"])
    assert (got["tf__dayofweek"] == t.dayofweek).all() and (got["tf__is_weekend"] == (t.dayofweek >= 5)).all()
    np.testing.assert_allclose(got["tf__hour_sin"], np.sin(2 * np.pi * t.hour / 24), atol=1e-12)


@pytest.mark.parametrize("wide", [2, 4, 10_000])
def test_windows_of_blocks_equal_sliding_windows(spark, monkeypatch, gappy, wide):
    monkeypatch.setattr(FE, "WIDE", wide)
    s = as_series(spark, gappy, chunk=90)
    cfg = FE.FeatureConfig(lags=(), rolling_windows=(2, 3, 7, 50, 89), rolling_stats=("mean", "std", "min", "max"), ewm_spans=(), diffs=(),
                           time_features=False)
    got = pandas_of(FE.generate(s, "y", ["a", "b", "flat", "sparse"], cfg).series.df)
    for c in ("a", "b", "flat", "sparse"):
        for w in cfg.rolling_windows:
            for stat in cfg.rolling_stats:
                want = getattr(gappy[c].rolling(w, min_periods=max(2, w // 2)), stat)()
                np.testing.assert_allclose(got[f"{c}__roll{w}_{stat}"], want, rtol=1e-9, atol=1e-9)
