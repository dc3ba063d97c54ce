import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tests.conftest import SF, as_series, pandas_of, walk
from tideframe.operators import (axis, blend as B, diagnose as D, explain as X, models as M, whatif as W)
from tideframe.plans import catalog

COLS = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def widening(spark):
    """Residuals whose spread grows from 1 to 6."""
    rng = np.random.default_rng(3)
    r = rng.normal(size=600) * np.linspace(1, 6, 600)
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=600, freq="5min"), "residual": r})
    return pdf, axis.ordinal(spark.createDataFrame(pdf), ["ts"], chunk=128)


def test_drift(widening):
    pdf, s = widening
    table = D.drift_table(s).toPandas()
    parts = np.split(pdf["residual"].to_numpy(), 6)
    np.testing.assert_allclose(table["MAE"], [np.abs(p).mean() for p in parts])
    np.testing.assert_allclose(table["p95_abs"], [np.quantile(np.abs(p), 0.95) for p in parts])
    verdict = D.drift_verdict(D.drift_table(s)).first()
    assert verdict["drift"] and verdict["worst_segment"] == int(table["MAE"].argmax()) + 1
    assert D.drift_table(axis.rebase(s, 0, 8)).count() == 0


def test_rolling_and_autocorrelation(widening):
    pdf, s = widening
    cfg = D.ResidualConfig(window=40)
    got = pandas_of(D.rolling_stats(s, cfg))
    roll = pdf["residual"].rolling(40, min_periods=10)
    np.testing.assert_allclose(got["roll_std"].astype(float), roll.std(), atol=1e-9)
    v = pdf["residual"] - pdf["residual"].mean()
    acf = [round(float(np.dot(v[k:], v[:-k]) / np.dot(v, v)), 4) for k in range(1, 25)]
    assert [r["acf"] for r in D.autocorrelation(s, 24).collect()] == acf
    assert D.summary(s).first()["lag1_acf"] == acf[0]


def test_outliers_of_a_constant_with_a_spike(spark):
    v = np.zeros(100)
    v[50] = 9.0
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=100, freq="h"), "residual": v})
    got = D.outliers(axis.ordinal(spark.createDataFrame(pdf), ["ts"])).collect()
    assert len(got) == 1 and got[0]["direction"] == "under-predicted"
    flat = axis.ordinal(spark.createDataFrame(pdf.assign(residual=1.0)), ["ts"])
    assert D.outliers(flat).count() == 0 and D.autocorrelation(flat).count() == 0


def test_residuals_meet_on_shared_instants(spark):
    a = spark.createDataFrame([("2024-01-01", 3.0), ("2024-01-02", None)], "ts string, label double")
    p = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 1.0), ("2024-01-03", 1.0)], "ts string, prediction double")
    assert [r["residual"] for r in D.residuals(a, p).collect()] == [2.0]


def test_causes_of_a_split_gap(spark):
    s = as_series(spark, walk(400, 1))
    found = {r["cause"] for r in D.split_gap_causes(0.3, s, "y").collect()}
    assert "autocorrelation" in found
    rng = np.random.default_rng(8)
    calm = as_series(spark, pd.DataFrame({"ts": pd.date_range("2024", periods=3000, freq="h"), "x": rng.normal(size=3000),
                                          "y": rng.normal(size=3000)}))
    assert [r["cause"] for r in D.split_gap_causes(0.3, calm, "y").collect()] == ["lag mismatch"]
    assert D.split_gap_causes(0.1, calm, "y").count() == 0
    assert D.distribution_drift(axis.rebase(calm, 0, 20), "y").first()["y_shift_sd"] is None


@pytest.fixture(scope="module")
def fitted(spark):
    s = as_series(spark, walk(300, 21))
    ready = M.prepare(s, "y", COLS, axis.in_range(0, 240), M.FitConfig(fold_selection=False))
    return s, {n: M.fit(ready, M.ZOO[n]) for n in ("Ridge", "DecisionTree")}


def sums(c: X.Contributions, pipe, series) -> float:
    total = c.table.groupBy("ord").agg(F.sum("shap_value").alias("s"))
    off = total.join(pipe.predict(series), "ord").select(F.abs(F.col("s") + F.lit(c.base_value) - F.col("prediction")).alias("e"))
    return off.agg(F.max("e")).first()[0]


def test_contributions_add_up(fitted):
    s, pipes = fitted
    cfg = X.ShapConfig(background=6, rows=F.col("ord") % 12 == 0)
    tree = X.explain(pipes["DecisionTree"], s, cfg)
    assert tree.method == "tree" and tree.table.select("ord").distinct().count() == 25
    assert sums(tree, pipes["DecisionTree"], s) < 1e-9
    assert sums(X.explain(pipes["Ridge"], s), pipes["Ridge"], s) < 1e-9
    blend = B.Blend("b", pipes, np.array([0.3, 0.7]), 1.5)
    both = X.explain(blend, s, cfg)
    assert both.method == "blend" and sums(both, blend, s) < 1e-9
    solo = X.explain(B.Blend("b", pipes, np.array([1.0, 0.0])), s, cfg)
    assert solo.method == "blend" == X.method(B.Blend("b", pipes, np.array([1.0, 0.0])))


def subsets_shapley(answer, x: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Rows x features, by the definition: every subset of features from the row, the rest from a background row."""
    n, d = x.shape
    value = {}
    for mask in range(1 << d):
        own = np.array([mask >> i & 1 for i in range(d)], dtype=bool)
        mixed = np.where(own, x[:, None, :], back[None, :, :]).reshape(-1, d)
        value[mask] = answer(mixed).reshape(n, len(back)).mean(1)
    out = np.zeros((n, d))
    for i in range(d):
        for mask in range(1 << d):
            if not mask >> i & 1:
                size = bin(mask).count("1")
                out[:, i] += math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d) * (value[mask | 1 << i] - value[mask])
    return out


def answer_of(pipe, spark, output: int, odds: bool = False):
    def answer(x: np.ndarray) -> np.ndarray:
        rows = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], StructType([StructField("i", IntegerType()), StructField("features", VectorUDT())]))
        out = pipe.predict_vectors(rows).orderBy("i").toPandas()
        if pipe.prepared.task == "regression":
            return out["prediction"].to_numpy()
        p = np.stack(out["probability"].to_numpy())[:, output]
        return np.log(p / (1 - p)) if odds else p
    return answer


@pytest.mark.parametrize("task,name,params", [
    ("regression", "DecisionTree", {}), ("regression", "RandomForest", {"n_trees": 3, "max_depth": 5}),
    ("regression", "GradientBoosting", {"n_rounds": 3}), ("classification", "DecisionTree", {"max_depth": 4}),
    ("classification", "RandomForest", {"n_trees": 3, "max_depth": 4}), ("binary", "GradientBoosting", {"n_rounds": 3})])
def test_tree_contributions_equal_all_subsets(spark, task, name, params):
    pdf = walk(260, 5)
    pdf["x4"] = np.random.default_rng(4).normal(size=260).round(1)
    if task != "regression":
        pdf["y"] = (pdf["y"].rank() * (3 if task == "classification" else 2) // 261).astype(int).astype(str)
    s = as_series(spark, pdf)
    kind = "regression" if task == "regression" else "classification"
    ready = M.prepare(s, "y", ["x1", "x2", "x3", "x4"], axis.in_range(0, 200), M.FitConfig(task=kind, fold_selection=False))
    pipe = M.fit(ready, M.ZOO[name], params)
    cfg = X.ShapConfig(background=7, rows=F.col("ord") % 20 == 0)
    rows = X.explained_rows(pipe, s, cfg)
    x = np.array([r["features"].toArray() for r in rows.orderBy("ord").collect()])
    back = X.background_rows(rows, cfg)
    found = X.explain_classes(pipe, s, cfg) if kind == "classification" else {0: X.explain(pipe, s, cfg)}
    assert len(found) == {"regression": 1, "classification": 3, "binary": 2}[task]
    for output, c in enumerate(found.values()):
        assert c.method == "tree" and c.space == {"regression": "prediction", "classification": "probability", "binary": "log odds"}[task]
        answer = answer_of(pipe, spark, output, task == "binary")
        wide = c.table.groupBy("ord").pivot("feature", pipe.names).agg(F.first("shap_value")).orderBy("ord").toPandas()
        assert np.abs(wide[pipe.names].to_numpy() - subsets_shapley(answer, x, back)).max() < 1e-9
        assert c.base_value == pytest.approx(answer(back).mean(), abs=1e-9)
    if kind == "classification":
        whole = X.explain(pipe, s, X.ShapConfig(target="0"))
        first = X.explain_classes(pipe, s)["0"]
        assert whole.base_value == first.base_value and whole.table.exceptAll(first.table).isEmpty()


def test_sampled_contributions_explain_every_class(spark):
    pdf = walk(120, 6)
    pdf["y"] = (pdf["y"].rank() * 3 // 121).astype(int).astype(str)
    s = as_series(spark, pdf)
    ready = M.prepare(s, "y", COLS, axis.in_range(0, 100), M.FitConfig(task="classification", fold_selection=False))
    pipe = M.fit(ready, M.ZOO["LogisticRegression"])
    cfg = X.ShapConfig(background=5, rows=F.col("ord") < 9)
    found = X.explain_classes(pipe, s, cfg)
    p = np.stack([r["probability"] for r in pipe.predict(s).where("ord < 9").orderBy("ord").collect()])
    for i, c in enumerate(found.values()):
        got = np.array([r[0] for r in c.table.groupBy("ord").agg(F.sum("shap_value")).orderBy("ord").select("sum(shap_value)").collect()])
        assert c.method == "sampled" and np.abs(got + c.base_value - p[:, i]).max() < 1e-9
    assert X.explain(pipe, s, X.ShapConfig(background=5, rows=F.col("ord") < 9, target="2")).base_value == pytest.approx(found["2"].base_value)


def test_a_given_tree_treats_unknown_values_as_large(spark):
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=6, freq="h"), "a": [1.0, 2.0, np.nan, 4.0, 5.0, 1.0], "b": [0.0, 9.0, 9.0, np.nan, 0.0, 0.0]})
    s = as_series(spark, pdf)
    tree = M.TreeFormula(("a", 2.0, ("b", 5.0, 1.0, 2.0), ("b", 5.0, 3.0, ("a", 4.0, 4.0, 8.0))))
    c = X.explain(tree, s)
    assert sums(c, tree, s) < 1e-12
    flat = X.explain(M.TreeFormula(("a", 2.0, 7.0, 7.0)), s)
    assert flat.base_value == 7.0 and flat.table.agg(F.max(F.abs("shap_value"))).first()[0] == 0
    with pytest.raises(ValueError):
        X.explain(tree, s, X.ShapConfig(among=F.lit(False)))


def test_sampled_contributions_of_a_linear_model_are_exact(fitted):
    s, pipes = fitted
    rows = pipes["Ridge"].prepared.assemble(s).where("ord < 12")
    got = X.sampled_shapley(pipes["Ridge"], rows, "ts", X.ShapConfig(background=12))
    want = X._explain(pipes["Ridge"], rows, "ts", X.ShapConfig())
    both = got.table.join(want.table.select("ord", "feature", F.col("shap_value").alias("w")), ["ord", "feature"])
    assert both.agg(F.max(F.abs(F.col("shap_value") - F.col("w")))).first()[0] < 1e-9
    assert got.base_value == pytest.approx(want.base_value)


def test_the_query_explains_all_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "importance", lambda c: c.table)
    got = catalog.sampled_contributions(spark, SF)
    assert got.select("ord").distinct().count() == catalog._training(spark, SF)[0].df.count()


@pytest.fixture(scope="module")
def halves(spark):
    """Contributions of valve grow sixfold in the second half."""
    rng = np.random.default_rng(0)
    t = pd.date_range("2024-01-01", periods=600, freq="h")
    v = rng.normal(size=(600, 3))
    v[300:, 0] *= 6
    rows = [(i, str(t[i]), f, float(rng.normal()) if f != "valve" else float(v[i, 0] * 2), float(v[i, j]))
            for i in range(600) for j, f in enumerate(("valve", "temp", "flow"))]
    table = spark.createDataFrame(rows, "ord bigint, ts string, feature string, feature_value double, shap_value double")
    return t, X.Contributions(table.withColumn("ts", F.col("ts").cast("timestamp")), 3.0, "given")


def test_periods(halves):
    t, c = halves
    periods = [("a", t[0], t[299]), ("b", t[300], None), ("none", "2030-01-01", None)]
    shift = X.period_shift(c, periods).toPandas()
    assert shift.columns.tolist() == ["feature", "a", "b", "change"]
    assert shift["feature"][0] == "valve" and shift["change"][0] > 20
    np.testing.assert_allclose(shift[["a", "b"]].sum(), 100)
    assert X.slice_period(c, t[10], t[19]).table.count() == 30
    with pytest.raises(ValueError):
        X.slice_period(c, "2030-01-01")
    dep = X.dependence_by_periods(c, "valve", periods).groupBy("period").count().collect()
    assert {(r["period"], r["count"]) for r in dep} == {("a", 300), ("b", 300)}


def test_views(halves):
    t, c = halves
    imp = X.importance(c).toPandas()
    assert imp["feature"][0] == "valve" and imp["contribution_pct"].sum() == pytest.approx(100)
    near = X.local_explanation(c, t[7] + pd.Timedelta("20min"), 2).collect()
    assert len(near) == 2 and near[0]["ts"] == t[7].to_pydatetime()
    assert X.dependence(c, "valve", "temp").columns == ["ts", "feature_value", "shap_value", "interaction_value"]
    assert X.auto_interaction(c, "valve") in ("temp", "flow") and X.auto_interaction(c.with_table(c.table.where("feature='temp'")), "temp") is None
    trend = X.quantile_trend(c, "valve", 10).toPandas()
    assert len(trend) == 10 and (np.diff(trend["y"]) > 0).all()
    assert X.contribution_stream(c, "1d").count() == 25 * 3


def test_permutation_finds_the_inputs_that_matter(fitted):
    s, pipes = fitted
    got = X.permutation_importance(pipes["Ridge"], s, n_repeats=2).toPandas().set_index("feature")
    assert got.loc["x1", "importance_mean"] > 0.1 > abs(got.loc["x3", "importance_mean"])


@pytest.mark.parametrize("metric", ["R2", "MAE", "MAPE"])
@pytest.mark.parametrize("name", ["Ridge", "DecisionTree"])
def test_permutation_within_the_batch_equals_the_model_asked_anew(fitted, monkeypatch, name, metric):
    s, pipes = fitted
    fast = X.permutation_importance(pipes[name], s, metric, n_repeats=2).toPandas().set_index("feature").sort_index()
    monkeypatch.setattr(X, "_shift_of", lambda pipe, spark: None)
    slow = X.permutation_importance(pipes[name], s, metric, n_repeats=2).toPandas().set_index("feature").sort_index()
    assert list(fast.index) == list(slow.index)
    np.testing.assert_allclose(fast.to_numpy(), slow.to_numpy(), atol=1e-9)


def test_scenarios(spark, fitted):
    s, pipes = fitted
    moved = W.Scenario((W.Change("x1", W.SET, 60.0), W.Change("x2", W.PCT, 10.0), W.Change("gone", W.DELTA, 1.0)),
                       {"x2": [("x3", 0.5)]})
    raw = pandas_of(s.df)
    got = pandas_of(W.apply_changes(s.df, moved))
    np.testing.assert_allclose(got["x2"], raw["x2"] * 1.1)
    np.testing.assert_allclose(got["x3"], raw["x3"] + 0.05 * raw["x2"])
    coef, _ = pipes["Ridge"].linear_terms()
    step = W.run_scenario(pipes["Ridge"], s, W.Scenario((W.Change("x2", W.DELTA, 2.0),)))
    want = 2.0 * coef[1] / pipes["Ridge"].prepared.prep.scale["x2"]
    assert W.scenario_summary(step).first()["mean_change"] == pytest.approx(want)
    flags = {r["feature"]: r["verdict"] for r in W.extrapolation(s, W.Scenario((
        W.Change("x1", W.SET, 1e6), W.Change("x2", W.SET, 10.0)))).collect()}
    assert flags == {"x1": "mostly outside", "x2": "inside"}


def test_sweep_and_goal(fitted):
    s, pipes = fitted
    grid = W.suggest_range(s, "x2", 7)
    curve = W.sweep(pipes["DecisionTree"], s, "x2", grid).toPandas()
    one = pandas_of(pipes["DecisionTree"].predict(s.with_df(s.df.withColumn("x2", F.lit(grid[3])))))["prediction"]
    assert curve["prediction"][3] == pytest.approx(one.mean())
    assert curve["p90"][3] == pytest.approx(np.percentile(one, 90))
    best = W.optimize_single(pipes["Ridge"], s, "x2", 0.0, 7, "max").first()
    assert best["best_value"] == pytest.approx(grid[-1])
    lines = W.ice_curves(pipes["Ridge"], s, "x2", grid, 10)
    assert lines.count() == 70 and lines.select("ord").distinct().count() == 10


def test_a_linear_model_explains_every_row(fitted):
    s, pipes = fitted
    assert X.explain(pipes["Ridge"], s).table.select("ord").distinct().count() == s.n
