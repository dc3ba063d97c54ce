import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_series, pandas_of
from tideframe.operators import layout, timeaxis

TAGS = ["FLOW_01", "PRESS_01", "TEMP_01", "Y_YIELD"]


@pytest.fixture(scope="module")
def long_form():
    rng = np.random.default_rng(4)
    times = pd.date_range("2024-01-01", periods=120, freq="5min")
    rows = [(str(t), f" {tag} ", str(round(rng.normal(), 4))) for t in times for tag in TAGS]
    rows += rows[:40] + [("not a time", "FLOW_01", "1.0"), (str(times[3]), "FLOW_01", "bad")]
    return pd.DataFrame(rows, columns=["tag_time", "tag_name", "value"]).sample(frac=1, random_state=0)


def test_detects_long(spark, long_form):
    df = spark.createDataFrame(long_form).withColumn("value", F.col("value").try_cast("double"))
    got = layout.detect_layout(df)
    assert (got.layout, got.time_col, got.tag_col, got.value_col) == ("long", "tag_time", "tag_name", "value")
    wide = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024", periods=20), "a": 1.0, "b": 2.0}))
    assert layout.detect_layout(wide).layout == "wide"
    assert layout.detect_layout(wide.select("ts", "a")).layout == "wide"


def test_time_column_by_name_type_then_content(spark):
    assert layout.guess_time_column(spark.createDataFrame([(1, "x")], "id int, stamp_x string")) == "stamp_x"
    assert layout.guess_time_column(spark.sql("select 1 as a, timestamp '2024-01-01' as b")) == "b"
    assert layout.guess_time_column(spark.createDataFrame([("q", "2024-01-01 10:00:00")], "a string, b string")) == "b"
    assert layout.guess_time_column(spark.createDataFrame([("q", 1)], "a string, b int")) is None


def test_long_to_wide_and_back(spark, long_form):
    df = spark.createDataFrame(long_form)
    wide = layout.long_to_wide(df, "tag_time", "tag_name", "value")
    assert wide.columns == ["tag_time", *TAGS] and wide.count() == 120
    stats = layout.long_stats(df, "tag_time", "tag_name", "value").first()
    assert (stats["tags"], stats["instants"], stats["dropped_non_numeric"], stats["repeated"]) == (4, 120, 1, 40)
    back = layout.wide_to_long(wide, "tag_time")
    assert back.count() == 480
    again = layout.long_to_wide(back, "tag_time", "tag", "value")
    assert again.exceptAll(wide).count() == 0


def test_long_to_wide_refuses_nonsense(spark, long_form):
    df = spark.createDataFrame(long_form)
    for args in (("tag_time", "tag_name", "nope"), ("tag_time", "value", "value")):
        with pytest.raises(layout.LayoutError):
            layout.long_to_wide(df, *args)
    with pytest.raises(layout.LayoutError):
        layout.long_to_wide(df.where("false"), "tag_time", "tag_name", "value")


def test_to_timeseries_drops_bad_times_and_keeps_the_last(spark):
    df = spark.createDataFrame([("2024-01-02", 1, 1.0), ("2024-01-01", 2, 2.0), ("2024-01-02", 3, 3.0), ("x", 4, 4.0)],
                               "t string, seq int, v double")
    got = timeaxis.to_timeseries(df, "t", "seq")
    assert got.dropped_bad_times == 1 and got.series.n == 2
    assert pandas_of(got.series.df)["v"].tolist() == [2.0, 3.0]


@pytest.mark.parametrize("agg", ["mean", "sum", "min", "max", "median", "std", "first", "last", "count"])
def test_resample_equals_pandas(spark, agg):
    rng = np.random.default_rng(6)
    t = pd.Timestamp("2024-01-01 03:10") + pd.to_timedelta(np.sort(rng.choice(3000, 200, replace=False)), unit="min")
    pdf = pd.DataFrame({"ts": t, "v": rng.normal(size=200), "s": rng.choice(list("abc"), 200)})
    pdf.loc[::9, "v"] = np.nan
    got = pandas_of(timeaxis.resample(spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None))), "90min", agg), "ts")
    want = getattr(pdf.set_index("ts")["v"].resample("90min"), agg)()
    assert got["ts"].tolist() == want.index.tolist()
    np.testing.assert_allclose(got["v"].astype(float), want.to_numpy(dtype=float), atol=1e-12)
    text = pdf.set_index("ts")["s"].resample("90min").last()
    assert [x if isinstance(x, str) else None for x in got["s"]] == [x if isinstance(x, str) else None for x in text]


def test_step_and_gaps(spark):
    t = list(pd.date_range("2024-01-01", periods=50, freq="5min")) + list(pd.date_range("2024-01-02", periods=10, freq="5min"))
    s = as_series(spark, pd.DataFrame({"ts": t, "v": 1.0}))
    assert timeaxis.step_minutes(s) == 5.0
    gaps = timeaxis.gap_report(s).collect()
    assert len(gaps) == 1 and gaps[0]["end"] == pd.Timestamp("2024-01-02").to_pydatetime()
    assert timeaxis.step_seconds(as_series(spark, pd.DataFrame({"ts": t[:2], "v": 1.0}))) is None


def test_samples_are_exact_and_repeatable(spark):
    s = as_series(spark, pd.DataFrame({"ts": pd.date_range("2024", periods=300, freq="h"), "v": range(300)}))
    a = sorted(r["ord"] for r in timeaxis.sample_rows(s, 25, 1).collect())
    b = sorted(r["ord"] for r in timeaxis.sample_rows(s.with_df(s.df.repartition(7)), 25, 1).collect())
    assert a == b and len(set(a)) == 25
    assert timeaxis.stride(s, 100).count() == 100
    assert timeaxis.last_days(s.df, 2).count() == 300 - 24 * 10       # days 11 to 13 of 13, the last half filled
