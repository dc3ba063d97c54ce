import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tests.conftest import SF, as_series, pandas_of, walk
from tideframe.operators import features as FE, models as M
from tideframe.plans import auto
from tideframe.sources import readers, runs


@pytest.mark.parametrize("sep", readers.SEPARATORS)
@pytest.mark.parametrize("encoding", readers.ENCODINGS)
def test_csv_encodings(spark, tmp_path, sep, encoding):
    path = tmp_path / "in.csv"
    path.write_text(sep.join(["이름", "값"]) + "\n" + sep.join(["온도", "1.5"]) + "\n", encoding=encoding)
    got = readers.read_csv(spark, str(path), sep, encoding)
    assert got.columns == ["이름", "값"] and tuple(got.first()) == ("온도", 1.5)


def test_csv_projection_cap_and_refusals(spark, tmp_path):
    out = str(tmp_path / "t")
    readers.write_csv(spark.range(20).withColumn("b", F.lit("x")), out, "|")
    got = readers.read_csv(spark, out, "|", max_rows=5, columns=["id"])
    assert got.columns == ["id"] and got.count() == 5
    assert readers.preview(lambda n: readers.read_csv(spark, out, "|", max_rows=n), 3).count() == 3
    with pytest.raises(ValueError):
        readers.read_csv(spark, out, "#")


def test_sql_options_split_the_read():
    plain = readers.sql_options("jdbc:x", "select 1", user="u")
    assert plain["query"] == "select 1" and "dbtable" not in plain
    parts = readers.sql_options("jdbc:x", "select * from t", partition_column="id", lower=0, upper=9, partitions=3)
    assert parts["numPartitions"] == "3" and "query" not in parts
    with pytest.raises(ValueError):
        readers.sql_options("jdbc:x", "select 1", partition_column="id")


@pytest.fixture(scope="module")
def run(spark):
    s = as_series(spark, walk(500, 31))
    cfg = auto.AutoConfig(n_splits=2, models=("Ridge", "DecisionTree"), top_k=8,
                          feature=FE.FeatureConfig(lags=(1,), rolling_windows=(4,), ewm_spans=(4,)))
    s = s.with_df(s.df.withColumn("x4", F.lit(7.0)))
    return cfg, auto.run_auto(s, "y", cfg)


def test_auto_run(run):
    cfg, got = run
    assert "x4" not in got.kept and len(got.selected) <= 8
    assert got.config.split.gap == 4 and got.split.three_way
    assert got.checklist.where("not passed").count() == 0
    assert not any("y" in o.origins for o in got.ledger if o.feature in got.selected)
    assert got.leaderboard.count() == 5 and got.champion in got.pipelines
    assert got.unseen.first()["unseen_R2"] > 0.9 and got.decisions.count() >= 8


def test_auto_run_stops_on_bad_input(spark):
    s = as_series(spark, walk(100, 1))
    with pytest.raises(auto.AutoRunError):
        auto.run_auto(s, "nope")
    flat = s.with_df(s.df.select("ts", "ord", "y", F.lit(1.0).alias("a")))
    with pytest.raises(auto.AutoRunError):
        auto.run_auto(flat, "y")


def test_runs_are_saved_listed_and_loaded(spark, run, tmp_path):
    cfg, got = run
    root = str(tmp_path / "runs")
    blend = got.pipelines["Ensemble_Voting"]
    for run_id, champion, pipe in (("r1", "Ridge", got.pipelines["Ridge"]), ("r2", "Ensemble_Voting", blend)):
        m = runs.manifest(spark, runs.RunParts(got.series, got.split, got.selection_report, got.unseen, {"auto": cfg},
                                               {"target": "y", "seed": 42, "champion": champion}))
        runs.save_run(root, run_id, {"leaderboard": got.leaderboard, "predictions": got.trained.predictions,
                                     "selection_report": got.selection_report, "manifest": m}, pipe)
    again = runs.load_run(spark, root, "r1")
    assert set(again) == {"leaderboard", "predictions", "selection_report", "manifest"}
    assert again["predictions"].count() == got.trained.predictions.count()
    assert {r["run_id"] for r in runs.list_runs(spark, root).collect()} == {"r1", "r2"}
    for run_id, pipe in (("r1", got.pipelines["Ridge"]), ("r2", blend)):
        a = pandas_of(runs.load_model(spark, f"{root}/models/{run_id}").predict(got.series))["prediction"]
        np.testing.assert_allclose(a, pandas_of(pipe.predict(got.series))["prediction"])
    diff = runs.compare_manifests(again["manifest"], runs.load_table(spark, root, "manifest", "r2"))
    unequal = {r["key"] for r in diff.where("not equal").collect()}
    assert "champion" in unequal and "dataset.fingerprint" not in unequal
    keep = runs.challenge(again["manifest"], again["manifest"]).first()
    assert keep["decision"] == "keep" and keep["same_data"] and keep["gain"] == 0.0


def test_knn_and_categories_survive_saving(spark, tmp_path):
    pdf = walk(200, 5)
    pdf["mark"] = np.where(np.arange(200) % 50 == 7, "odd", np.where(pdf["x1"] > 50, "a", "b"))
    pdf.loc[3, "mark"] = "once"
    s = as_series(spark, pdf)
    ready = M.prepare(s, "y", ["x1", "x2", "mark"], F.lit(True), M.FitConfig(fold_selection=False))
    pipe = M.fit(ready, M.ZOO["KNN"], {"weights": "distance"})
    runs.save_model(pipe, str(tmp_path / "m"))
    again = runs.load_model(spark, str(tmp_path / "m"))
    np.testing.assert_allclose(pandas_of(again.predict(s))["prediction"], pandas_of(pipe.predict(s))["prediction"])


def test_challenger_needs_a_real_gain(spark):
    rows = spark.createDataFrame([(0.80, 0.81), (0.80, 0.82), (None, 0.9)], "champion_score double, challenger_score double")
    assert [r["decision"] for r in runs.decide(rows).collect()] == ["keep", "replace", "undecided"]
    lower = spark.createDataFrame([(2.0, 1.9)], "champion_score double, challenger_score double")
    assert runs.decide(lower, "RMSE").first()["decision"] == "replace"


def test_settings_become_json():
    json.dumps({"a": auto.AutoConfig(), "b": (1, np.float64(2.0)), "c": {3}}, default=runs.as_json)


def test_entry_and_contract(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) > 80


@pytest.mark.parametrize("name", [
    "long_to_wide", "timeseries_dedupe", "resample_median", "column_profile", "missing_runs", "lag_scan", "feature_rolling",
    "feature_ewm_gaps", "split_by_date", "mutual_information", "impute_ffill", "score_classification_by_language",
    "residual_drift", "contribution_shift", "sweep_curve", "cluster_quality", "linkage_clusters", "hourly_features_split"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got = entry_points.queries()[name](spark, SF)
    rel = con.sql(entry_points.oracle_sql()[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == want
