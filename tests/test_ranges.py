"""Ridge folds from shared moments against the same folds fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_series, walk
from tideframe.operators import models as M, prep as P, ranges as RG, split as SP, train as T

COLS = ["x1", "x2", "x3", "x4"]


def holed(n: int, seed: int):
    pdf = walk(n, seed)
    rng = np.random.default_rng(seed)
    pdf["x4"] = pdf["x1"] * 1.01 + rng.normal(size=n) * 0.001         # correlated away
    for c in ("x1", "x2", "x3", "y"):
        pdf.loc[rng.random(n) < 0.15, c] = np.nan
    pdf.loc[:4, "x2"] = np.nan
    return pdf


@pytest.mark.parametrize("impute,scaler,select", [("median", "standard", True), ("mean", "none", False), ("zero", "standard", False),
                                                  ("ffill", "standard", True)])
def test_folds_equal_separate_fits(spark, impute, scaler, select):
    s = as_series(spark, holed(420, 3))
    cfg = M.FitConfig(prep=P.PreprocessConfig(impute, scaler=scaler), fold_selection=select)
    folds = SP.rolling_origin(s.n, 3, 2)
    learnt = RG.ridge_ranges(s, "y", COLS, [f.train for f in folds], cfg, 0.5)
    got = RG.predict_ranges(s, "y", [(f.number, m, f.test) for f, m in zip(folds, learnt)])
    for f, m in zip(folds, learnt):
        ready = M.prepare(s, "y", COLS, f.train.where(), cfg)
        pipe = M.fit(ready, M.ZOO["Ridge"], {"alpha": 0.5})
        coef, intercept = pipe.linear_terms()
        assert m.names == pipe.names and m.rows == ready.context.n
        assert all(abs(m.prep.fill[c] - ready.prep.fill[c]) < 1e-9 for c in COLS)
        assert np.abs(np.array(m.coefficients) - coef).max() < 1e-5 and abs(m.intercept - intercept) < 1e-4
        both = pipe.predict(M.part_of(s, f.test.where())).select("ord", F.col("prediction").alias("want")).join(got.where(F.col("fold") == f.number), "ord")
        assert both.count() == len(f.test) and both.agg(F.max(F.abs(F.col("want") - F.col("prediction")))).first()[0] < 1e-4
        M.release(ready)


def test_settings_that_need_the_rows_are_left_to_the_fits(spark):
    s = as_series(spark, holed(60, 1))
    ranges = [SP.Range(0, 30), SP.Range(10, 40)]
    assert RG.applies(s, COLS, M.FitConfig(prep=P.PreprocessConfig("median")), ranges)
    assert not RG.applies(s, COLS, M.FitConfig(), ranges)              # a forward fill from two beginnings
    assert not RG.applies(s, COLS, M.FitConfig(prep=P.PreprocessConfig("median", scaler="robust")), ranges)
    assert not RG.applies(s, COLS, M.FitConfig(top_k=2, prep=P.PreprocessConfig("mean")), ranges)
    with pytest.raises(ValueError):
        RG.ridge_ranges(s, "y", COLS, ranges, M.FitConfig(top_k=2))


@pytest.mark.parametrize("gap", [3, 5_000])
def test_medians_of_ranges_are_exact(spark, monkeypatch, gap):
    monkeypatch.setattr(RG, "GAP_ROWS", gap)
    monkeypatch.setattr(RG, "FIRST_CUTS", [0.25, 0.75])
    monkeypatch.setattr(RG, "NEXT_CUTS", [0.3, 0.5, 0.7])
    rng = np.random.default_rng(2)
    seg = rng.integers(1, 5, 900)
    a, b, c = rng.normal(size=900) + seg, rng.integers(0, 4, 900).astype(float), np.full(900, np.nan)
    a[rng.random(900) < 0.2] = np.nan
    rows = spark.createDataFrame([(int(s), *(None if np.isnan(v) else float(v) for v in x)) for s, *x in zip(seg, a, b, c)],
                                 "seg int, a double, b double, c double")
    members = [[1], [1, 2], [2, 3, 4], [1, 2, 3, 4], []]
    got = RG.range_medians(rows, ["a", "b", "c"], members)
    for own, found in zip(members, got):
        inside = np.isin(seg, own)
        assert found["c"] is None
        for name, v in (("a", a), ("b", b)):
            x = v[inside & ~np.isnan(v)]
            assert found[name] == pytest.approx(np.median(x), abs=1e-12) if len(x) else found[name] is None


def test_training_and_backtest_use_the_shared_moments(spark, monkeypatch):
    s = as_series(spark, walk(300, 8))
    cfg = T.TrainConfig(split=SP.SplitConfig(n_splits=3, gap=2))
    split = SP.three_way(s.n, 0.2, 0.15, 2)
    features = COLS[:3]
    fast = T.train_all(s, "y", features, split, ["Ridge"], cfg)
    table, _ = T.rolling_backtest(s, "y", features, "Ridge", cfg, 3)
    monkeypatch.setattr(RG, "applies", lambda *a: False)
    slow = T.train_all(s, "y", features, split, ["Ridge"], cfg)
    again, _ = T.rolling_backtest(s, "y", features, "Ridge", cfg, 3)
    for one, two in ((fast.leaderboard, slow.leaderboard), (table, again)):
        one, two = one.drop("fit_seconds").toPandas(), two.drop("fit_seconds").toPandas()
        assert list(one.columns) == list(two.columns)
        for c in one.select_dtypes("number"):
            np.testing.assert_allclose(one[c].astype(float), two[c].astype(float), rtol=1e-4, atol=1e-6)
    assert fast.oof().count() == slow.oof().count() and len(fast.fold_sets) == len(slow.fold_sets)
