import numpy as np
import pandas as pd
import pytest

from tests.conftest import as_series, pandas_of
from tideframe.operators import axis, features as FE, prep as P, select as S


def planted(n=800):
    rng = np.random.default_rng(7)
    a, b, c = rng.normal(size=(3, n))
    return pd.DataFrame({"ts": pd.date_range("2024", periods=n, freq="5min"), "strong": a, "weak": b, "noise": c,
                         "twin": a * 3 + 1, "flat": 7.0, "y": np.sin(2 * a) + 0.3 * b})


def test_three_steps(spark):
    s = as_series(spark, planted())
    got = S.select_features(s.df, None, "y", top_k=2)
    report = {r["feature"]: r for r in got.report.collect()}
    assert got.names == ["strong", "weak"]
    assert report["flat"]["reason"].startswith("variance") and report["twin"]["reason"].endswith("with strong")
    assert report["noise"]["reason"] == "mutual information rank 3, over 2"
    assert S.select_features(s.df, None, "y", compute_mi=False).names == ["strong", "weak", "noise"]


def test_a_column_with_gaps_is_not_deduplicated_in_strict_mode(spark):
    pdf = planted()
    pdf.loc[5, "twin"] = np.nan
    df = as_series(spark, pdf).df
    assert "twin" in S.select_features(df, None, "y").names
    assert "twin" not in S.select_features(df, None, "y", null_mode="pairwise").names


def test_mutual_information_of_classes(spark):
    pdf = planted()
    pdf["y"] = (pdf["strong"] > 0).astype(float)
    got = S.mutual_information(as_series(spark, pdf).df, ["strong", "noise"], "y", "classification")
    mi = {r["feature"]: r["mutual_info"] for r in got.collect()}
    assert mi["strong"] > 0.6 > 0.05 > mi["noise"]


def test_review_tables(spark):
    s = as_series(spark, planted())
    got = S.select_features(s.df, None, "y", top_k=2)
    ledger = [FE.Origin(c, ("strong",) if c == "twin" else (c,), "raw") for c in ("strong", "weak", "noise", "twin", "flat")]
    train = s.df.where(axis.in_range(0, 400))
    review = S.feature_report(got.report, ledger, train).toPandas().set_index("feature")
    assert review.loc["strong", "mi_rank"] == 1 and review.loc["weak", "train_mean"] == pytest.approx(planted()["weak"][:400].mean())
    roll = S.origin_rollup(S.feature_report(got.report, ledger)).toPandas().set_index("origin")
    assert roll.loc["strong", ["made", "selected"]].tolist() == [2, 1]
    mine = S.apply_manual_selection(got.report, ["strong", "noise"])
    status = {r["feature"]: r["status"] for r in mine.report.collect()}
    assert status["noise"] == "selected(manual)" and status["weak"] == "removed(manual)" and mine.names == ["noise", "strong"]
    risks = {(r["feature"], r["risk"]) for r in S.selection_risks(got.report, ["strong", "twin", "flat"], s.df).collect()}
    assert ("flat", "no variance") in risks and ("strong + twin", "duplicate") in risks


def test_jaccard(spark):
    got = [r["jaccard"] for r in S.jaccard_stability(spark, [{"a", "b"}, {"a", "b"}, {"c"}, {"b", "c", "d"}]).collect()]
    assert got == [1.0, 0.0, 0.25, 0.0, 0.25, 0.3333]


@pytest.mark.parametrize("how", ["ffill", "median", "mean", "zero"])
@pytest.mark.parametrize("scaler", ["standard", "robust", "none"])
def test_statistics_come_from_training_rows(spark, gappy, how, scaler):
    cols = ["a", "b", "sparse", "flat"]
    cfg = P.PreprocessConfig(how, scaler=scaler, clip_outliers=True, clip_quantiles=(0.05, 0.95))
    s = as_series(spark, gappy, 64)
    train = s.with_df(s.df.where(axis.in_range(0, 400)))
    got = pandas_of(P.fit(train, cols, [], cfg).transform(s, ["ord"]))

    def fill(p):
        base = {"ffill": gappy[cols][:400].median(), "median": gappy[cols][:400].median(),
                "mean": gappy[cols][:400].mean(), "zero": pd.Series(0.0, cols)}[how]
        return (p.ffill() if how == "ffill" else p).fillna(base)

    fitted = fill(gappy[cols][:400])
    lo, hi = fitted.quantile(0.05), fitted.quantile(0.95)
    want, ready = fill(gappy[cols]).clip(lo, hi, axis=1), fitted.clip(lo, hi, axis=1)
    if scaler == "standard":
        want = (want - ready.mean()) / ready.std(ddof=0).replace(0, 1)
    elif scaler == "robust":
        iqr = ready.quantile(0.75) - ready.quantile(0.25)
        want = (want - ready.median()) / iqr.replace(0, 1)
    np.testing.assert_allclose(got[cols], want, atol=1e-9)


def test_corrupting_later_rows_changes_no_fit(spark, gappy):
    cols = ["a", "b"]
    def params(pdf):
        s = as_series(spark, pdf)
        return P.fit(s.with_df(s.df.where(axis.in_range(0, 300))), cols, []).params()
    worse = gappy.copy()
    worse.loc[300:, cols] = 1e9
    assert params(gappy) == params(worse)


def test_fill_starts_anew_in_the_frame_given(spark, gappy):
    s = as_series(spark, gappy)
    fitted = P.fit(s.with_df(s.df.where(axis.in_range(0, 150))), ["b"], [], P.PreprocessConfig(scaler="none"))
    part = s.with_df(s.df.where(axis.in_range(300, 600)))
    got = pandas_of(fitted.transform(part, ["ord"]))
    assert (got["b"][:200] == gappy["b"][:150].median()).all()


def test_categories(spark):
    levels = ["red"] * 300 + ["blue"] * 300 + ["tiny"] * 2 + [None] * 20
    pdf = pd.DataFrame({"ts": pd.date_range("2024", periods=len(levels), freq="h"), "c": levels})
    s = as_series(spark, pdf)
    fitted = P.fit(s, [], ["c"])
    assert fitted.output_columns == ["c_blue", "c_red", "c_infrequent"] and fitted.modes["c"] == "blue"
    other = s.with_df(spark.createDataFrame([(0, "red"), (1, "tiny"), (2, "new"), (3, None)], "ord bigint, c string"))
    got = pandas_of(fitted.transform(other, ["ord"]))[fitted.output_columns].to_numpy().tolist()
    assert got == [[0, 1, 0], [0, 0, 1], [0, 0, 0], [1, 0, 0]]
    ranked = P.fit(s, [], ["c"], P.PreprocessConfig(categorical_encoding="ordinal"))
    assert pandas_of(ranked.transform(other, ["ord"]))["c"].tolist() == [1, 2, -1, 0]


def test_interpolation_warns():
    assert P.impute_warning(P.PreprocessConfig("interpolate")) and not P.impute_warning(P.PreprocessConfig())
