import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tests.conftest import as_series, pandas_of, walk
from tideframe import staging
from tideframe.operators import axis, blend as B, models as M, neighbours, scores, split as SP, train as T
from tideframe.plans import catalog

X = ["x1", "x2", "x3"]


@pytest.fixture(scope="module")
def series(spark):
    return as_series(spark, walk(500, 11))


@pytest.fixture(scope="module")
def trained(spark, series):
    cfg = T.TrainConfig(split=SP.SplitConfig(n_splits=3, gap=5))
    split = SP.three_way(500, gap=5)
    return cfg, split, T.train_all(series, "y", X, split, ["Ridge", "DecisionTree", "SVM"], cfg)


def design(series, rng=None):
    pdf = pandas_of(series.df)
    pdf = pdf if rng is None else pdf[rng.lo:rng.hi]
    z = pdf[X].to_numpy()
    z = (z - z.mean(0)) / z.std(0)
    return z, pdf["y"].to_numpy()


def test_ridge_is_the_closed_form(series):
    ready = M.prepare(series, "y", X, F.lit(True), M.FitConfig(fold_selection=False))
    coef, intercept = M.fit(ready, M.ZOO["Ridge"], {"alpha": 50.0}).linear_terms()
    z, y = design(series)
    want = np.linalg.solve(z.T @ z + 50 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(coef, want, atol=1e-9)
    assert intercept == pytest.approx(y.mean())


def test_elastic_net_meets_its_optimality_conditions(series):
    ready = M.prepare(series, "y", X, F.lit(True), M.FitConfig(fold_selection=False))
    coef = np.array(M.fit(ready, M.ZOO["ElasticNet"], {"alpha": 0.5, "l1_ratio": 0.5}).linear_terms()[0])
    z, y = design(series)
    slope = z.T @ (y - y.mean() - z @ coef) / len(y) - 0.25 * coef
    for g, b in zip(slope, coef):
        assert abs(g - 0.25 * np.sign(b)) < 1e-5 if b else abs(g) <= 0.25 + 1e-5


def test_knn_matches_brute_force_with_duplicates(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(neighbours, "BASE_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 16)
    rng = np.random.default_rng(12)
    base = np.vstack([rng.normal(size=(200, 3)), np.zeros((90, 3)), rng.normal(5, 0.1, size=(60, 3))])
    y = rng.normal(size=len(base))
    q = np.vstack([rng.normal(size=(60, 3)), rng.uniform(-8, 8, size=(20, 3))])

    def frame(x, **extra):
        return spark.createDataFrame(pd.DataFrame({"v": x.tolist(), **extra})).withColumn("features", array_to_vector("v"))

    model = M.KnnEstimator(15, scores.REGRESSION, 0).fit(frame(base, label=y))
    got = pandas_of(model.transform(frame(q, ord=range(len(q)))))["prediction"]
    d = np.sqrt(((q[:, None] - base[None]) ** 2).sum(-1))
    for i in range(len(q)):
        order = np.argsort(d[i], kind="stable")
        edge = d[i][order[14]]
        sure, tied = d[i] < edge - 1e-12, np.abs(d[i] - edge) <= 1e-12
        # Equal points count with their mean, in any number.
        want = (y[sure].sum() + y[tied].mean() * (15 - sure.sum())) / 15
        assert got[i] == pytest.approx(want, abs=1e-9)
    near = M.KnnEstimator(15, scores.REGRESSION, 0, "distance").fit(frame(base[:200], label=y[:200]))
    asked = np.vstack([q[:20], base[3:5]])
    got = pandas_of(near.transform(frame(asked, ord=range(len(asked)))))["prediction"]
    for i, d in enumerate(np.sqrt(((asked[:, None] - base[None, :200]) ** 2).sum(-1))):
        order = np.argsort(d)[:15]
        want = y[order[0]] if d[order[0]] == 0 else np.average(y[order], weights=1 / d[order])
        assert got[i] == pytest.approx(want, abs=1e-9)
    with pytest.raises(ValueError):
        M.KnnEstimator(15, scores.REGRESSION, 0, "nearest")


def test_scores(spark):
    rng = np.random.default_rng(13)
    y, p = rng.normal(size=200), rng.normal(size=200)
    y[:3] = 0.0
    r = scores.regression_scores(spark.createDataFrame(pd.DataFrame({"label": y, "prediction": p}))).first()
    assert r["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert r["MAPE"] == pytest.approx(np.mean(np.abs((y - p)[3:] / y[3:])))
    flat = scores.regression_scores(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double"))
    assert flat.first()["R2"] == 1.0


def test_classification_scores_with_ties_and_an_unseen_class(spark):
    rng = np.random.default_rng(14)
    y = rng.integers(0, 2, 300)
    s = np.round(np.clip(0.3 * y + rng.random(300) * 0.7, 0, 1), 1)
    pdf = pd.DataFrame({"label": y.astype(float), "prediction": np.where(s > 0.5, 1.0, 0.0),
                        "probability": [[1 - v, v] for v in s.tolist()]})
    r = scores.classification_scores(spark.createDataFrame(pdf), 2, probability="probability").first()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    assert r["ROC_AUC"] == pytest.approx(auc)
    f = [2 * ((pdf.prediction == c) & (y == c)).sum() / ((pdf.prediction == c).sum() + (y == c).sum()) for c in (0, 1)]
    assert r["F1"] == pytest.approx(np.mean(f))
    odd = spark.createDataFrame([(0.0, 0.0), (0.0, 2.0)], "label double, prediction double")
    assert scores.label_scores(odd).first()["F1"] == pytest.approx((2 / 3 + 0) / 2)


def test_task_detection(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), i % 2 == 0, f"s{i}", i / 10) for i in range(40)],
                               "many double, three double, flag boolean, text string, frac double")
    assert [M.detect_task(df, c) for c in df.columns] == [
        "regression", "classification", "classification", "classification", "regression"]


def test_training_board(trained):
    cfg, split, got = trained
    board = got.leaderboard.toPandas().set_index("model")
    assert list(board.index) == ["Ridge", "DecisionTree"]          # SVM is no regression model
    assert board.loc["Ridge", "holdout_R2"] > 0.95 and board.loc["Ridge", "rank"] == 1
    oof = got.oof().where("model = 'Ridge'").toPandas()
    assert len(oof) == 3 * (len(split.train) // 4) and oof["ord"].is_unique
    again = T.sort_leaderboard(got.leaderboard, "R2").toPandas()
    assert again["rank"].tolist() == [1, 2] and T.pick_champion(got.leaderboard, "R2") == "Ridge"


def test_scores_ignore_unseen_rows(spark, trained):
    cfg, split, got = trained
    worse = walk(500, 11)
    worse.loc[split.unseen.lo:, ["x1", "x2", "x3", "y"]] = 1e6
    other = T.train_all(as_series(spark, worse), "y", X, split, ["Ridge"], cfg).leaderboard.first()
    mine = got.leaderboard.where("model = 'Ridge'").first()
    assert other["cv_R2"] == pytest.approx(mine["cv_R2"]) and other["holdout_R2"] == pytest.approx(mine["holdout_R2"])


def test_a_failing_model_is_recorded(series, monkeypatch):
    def broken(ctx, p):
        raise RuntimeError("boom")
    monkeypatch.setitem(M.ZOO, "Broken", M.ModelSpec("Broken", "none", M.ALL, broken))
    cfg = T.TrainConfig(split=SP.SplitConfig(n_splits=2))
    board = T.train_all(series, "y", X, SP.three_way(500), ["Broken", "Ridge"], cfg).leaderboard.collect()
    assert [(r["model"], r["status"]) for r in board] == [("Ridge", "ok"), ("Broken", "failed")]
    assert "boom" in board[1]["error"]


def test_blends_reuse_fitted_members(series, trained):
    cfg, split, got = trained
    board, made = B.fit_blends(series, split, got, ["Ridge", "DecisionTree"], cfg)
    assert set(made) == {"Ensemble_Voting", "Ensemble_Weighted", "Ensemble_Stacking"}
    w = made["Ensemble_Weighted"].weights
    assert (w >= 0).all() and w.sum() == pytest.approx(1.0)
    part = M.part_of(series, split.valid.where())
    a, b = (pandas_of(got.pipelines[n].predict(part))["prediction"] for n in ("Ridge", "DecisionTree"))
    np.testing.assert_allclose(pandas_of(made["Ensemble_Voting"].predict(part))["prediction"], (a + b) / 2)
    both = got.leaderboard.drop("rank").unionByName(board, allowMissingColumns=True)
    name, table = B.adopt(both, "R2", 0.03, "holdout_")
    assert name == "Ridge" and table.where("verdict = 'adopted'").count() == 0
    assert B.adopt(both, "R2", -10.0, "holdout_")[0].startswith("Ensemble_")


def test_blends_learn_the_predictions_out_of_fold_they_lack(spark, series, trained, tmp_path, monkeypatch):
    cfg, split, whole = trained
    names = ["Ridge", "DecisionTree"]
    bare = T.train_all(series, "y", X, split, names, cfg, cross=False)
    assert bare.oof().isEmpty() and set(bare.pipelines) == set(names)
    assert bare.leaderboard.first()["cv_R2"] is None and bare.leaderboard.first()["holdout_R2"] is not None
    kept = T.FoldStore(spark, str(tmp_path / "folds"))
    _, made = B.fit_blends(series, split, bare, names, cfg, kept=kept)
    _, want = B.fit_blends(series, split, whole, names, cfg)
    for n in want:
        np.testing.assert_allclose(made[n].weights, want[n].weights, rtol=1e-6, atol=1e-9)
    monkeypatch.setattr(T, "train_all", None)           # everything is in the store by now
    again = T.with_folds(bare, series, "y", X, split, names, cfg, kept)
    cols = ["model", "fold", "ord", "prediction"]
    a, b = (t.oof().where(F.col("model").isin(names)).select(cols).toPandas().sort_values(cols[:3]) for t in (again, whole))
    assert len(a) == len(b) > 0
    np.testing.assert_allclose(a["prediction"], b["prediction"], rtol=1e-6)
    assert kept.get(kept.key(series, "y", X[:2], split, "Ridge", cfg)) is None


def test_nonnegative_weights():
    rng = np.random.default_rng(15)
    truth = rng.normal(size=400)
    a = np.column_stack([truth + rng.normal(size=400) * 0.2, truth + rng.normal(size=400) * 0.4, -truth])
    w = B.nonnegative_weights(a.T @ a, a.T @ truth)
    assert w[2] == 0 and w[0] > w[1] > 0 and w.sum() == pytest.approx(1)
    bad = B.nonnegative_weights(np.eye(2), np.array([-1.0, -2.0]))
    assert bad.tolist() == [0.5, 0.5]


def test_stacking_penalty_has_the_least_leave_one_out_error(spark):
    rng = np.random.default_rng(16)
    y = rng.normal(size=60) * 3 + 2
    a = np.column_stack([y + rng.normal(size=60), y + rng.normal(size=60) * 2])
    df = spark.createDataFrame(pd.DataFrame({"m1": a[:, 0], "m2": a[:, 1], "label": y}))
    coef, intercept, alpha = B.stack_coefficients(df, ["m1", "m2"])

    def left_out(al):
        total = 0.0
        for i in range(60):
            k = np.arange(60) != i
            mx, my = a[k].mean(0), y[k].mean()
            b = np.linalg.solve((a[k] - mx).T @ (a[k] - mx) + al * np.eye(2), (a[k] - mx).T @ (y[k] - my))
            total += (y[i] - my - (a[i] - mx) @ b) ** 2
        return total

    assert alpha == min(B.META_ALPHAS, key=left_out)
    mx = a.mean(0)
    want = np.linalg.solve((a - mx).T @ (a - mx) + alpha * np.eye(2), (a - mx).T @ (y - y.mean()))
    np.testing.assert_allclose(coef, want)
    assert intercept == pytest.approx(y.mean() - mx @ want)


def test_unseen_opens_once(spark, series, trained):
    cfg, split, got = trained
    guard = T.UnseenGuard(spark, staging.new_path(spark, "openings"))
    r = T.evaluate_unseen(got.pipelines["Ridge"], series, split, guard, cfg).first()
    assert r["unseen_rows"] == len(split.unseen) and r["unseen_R2"] > 0.9
    with pytest.raises(T.UnseenAccessError):
        T.evaluate_unseen(got.pipelines["DecisionTree"], series, split, guard, cfg)
    with pytest.raises(T.UnseenAccessError):
        T.evaluate_unseen(got.pipelines["Ridge"], series, split, None, cfg)


def test_tuning_draws_inside_the_grid_and_reports_stability(spark, series):
    assert len({str(d) for d in T.draw_params(M.ZOO["ElasticNet"].grid, 12, 1)}) == 12
    assert len(T.draw_params({"a": [1, 2]}, 12, 1)) == 2
    cfg = T.TrainConfig(split=SP.SplitConfig(n_splits=2, gap=2), tune=T.TuneConfig(True, n_iter=3, inner_splits=2))
    got = T.train_all(series, "y", X, SP.three_way(500, gap=2), ["Ridge"], cfg)
    chosen = got.fold_params["Ridge"]
    assert len(chosen) == 3 and all(d["alpha"] in M.ZOO["Ridge"].grid["alpha"] for d in chosen)
    assert T.parameter_stability(spark, chosen).first()["stability"] in ("consistent", "fair", "unstable")


def test_random_split_scores_stay_out_of_leaderboards(series):
    cfg = T.TrainConfig(split=SP.SplitConfig(gap=5))
    table = T.random_vs_time(series, "y", X, ["Ridge"], cfg)
    r = table.first()
    assert r["gap"] == pytest.approx(r["random"] - r["time"], abs=1e-4)
    with pytest.raises(ValueError):
        T.assert_not_diagnostic(table)
    assert T.sort_leaderboard(table.selectExpr("model", "'ok' status", "time holdout_R2", "purpose"), "R2").count() == 0


def test_backtest(series):
    cfg = T.TrainConfig(split=SP.SplitConfig(gap=5))
    table, stitched = T.rolling_backtest(series, "y", X, "Ridge", cfg, n_folds=3)
    rows = table.collect()
    assert len(rows) == 3 and all(r["train_end"] < r["test_start"] for r in rows)
    assert stitched.count() == 3 * (500 // 4)
    s = T.backtest_summary(table, "RMSE").first()
    assert s["worst_fold"] == max(rows, key=lambda r: r["RMSE"])["fold"]


def test_classification_end_to_end(spark):
    pdf = walk(400, 17)
    pdf["y"] = np.where(pdf["y"] > pdf["y"].median(), "high", "low")
    s = as_series(spark, pdf)
    cfg = T.TrainConfig(fit=M.FitConfig(task="classification"), split=SP.SplitConfig(n_splits=2), champion_metric="F1")
    got = T.train_all(s, "y", X, SP.three_way(400), ["LogisticRegression", "DecisionTree"], cfg)
    board = got.leaderboard.toPandas().set_index("model")
    assert got.classes == ["high", "low"] and board.loc["LogisticRegression", "insample_ROC_AUC"] > 0.9
    blends, made = B.fit_blends(s, SP.three_way(400), got, ["LogisticRegression", "DecisionTree"], cfg)
    assert list(made) == ["Ensemble_Voting"] and blends.first()["holdout_F1"] is not None


def test_no_class_is_left_out(spark):
    rows = [(i, i % 1200, float(i % 7)) for i in range(2600)]
    s = axis.ordinal(spark.createDataFrame(rows, "ts long, kind int, x double"), ["ts"])
    ready = M.prepare(s, "kind", ["x"], axis.in_range(0, 2600), M.FitConfig(task=scores.CLASSIFICATION, fold_selection=False))
    assert ready.classes == list(range(1200)) and ready.frame.count() == 2600
    assert ready.frame.where("label <> ord % 1200").count() == 0


def test_classifier_leaderboard_trains_at_the_operators_own_settings(spark, tmp_path, monkeypatch):
    """No learner, fold or selection is made smaller than the operators' defaults."""
    spark.createDataFrame([(i, f"text {i}", 6 + i % 9, "en" if i % 3 else "fr", f"s{i % 2}") for i in range(40)],
                          "doc_id bigint, text string, n_chars bigint, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    asked = []

    class Trained:
        leaderboard = spark.createDataFrame([("none", 0.0)], "model string, fit_seconds double")

    monkeypatch.setattr(T, "train_all", lambda *given: asked.append(given) or Trained)
    catalog.classifier_leaderboard(spark, str(tmp_path))
    names, cfg = asked[0][4], asked[0][5]
    assert cfg.split == SP.SplitConfig() and cfg.fit == M.FitConfig(task=scores.CLASSIFICATION)
    ctx = M.FitContext(scores.CLASSIFICATION, 40, 0.5, 5, 2)
    made = {n: M.ZOO[n].build(ctx, cfg.params.get(n, {})) for n in names}
    assert len(made) == 7 and made["GradientBoosting"].getMaxIter() == 400 and made["RandomForest"].getNumTrees() == 400
    assert made["MLP"].layers == [5, 128, 64, 2] and made["MLP"].max_iter == 600
    assert made["SVM"].getStages()[-1].getMaxIter() == 200
