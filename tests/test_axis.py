import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import as_series, pandas_of
from tideframe import staging
from tideframe.functions import stats
from tideframe.operators import axis, quantiles


def test_shared_folder_comes_from_the_session(spark):
    assert staging.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("parts", [1, 8, 32])
def test_ordinal_is_row_number_whatever_the_partitioning(spark, parts):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": rng.permutation(500) % 7, "id": range(500)})       # heavy ties in the first key
    got = axis.ordinal(spark.createDataFrame(pdf).repartition(parts), ["k", "id"], ts="k")
    want = pdf.sort_values(["k", "id"])["id"].tolist()
    assert got.n == 500 and pandas_of(got.df)["id"].tolist() == want


def test_ordinal_of_nothing(spark):
    got = axis.ordinal(spark.createDataFrame([], "ts timestamp, v double"), ["ts"])
    assert got.n == 0 and got.df.count() == 0


@pytest.mark.parametrize("chunk", [2, 3, 50, 10_000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_last_seen_equals_forward_fill(spark, gappy, chunk, inclusive):
    s = as_series(spark, gappy, chunk)
    got = pandas_of(axis.last_seen(s, {"b": F.col("b"), "sparse": F.col("sparse")}, inclusive))
    for c in ("b", "sparse"):
        want = gappy[c].ffill() if inclusive else gappy[c].ffill().shift(1)
        np.testing.assert_allclose(got[c], want)


def test_last_seen_starts_anew_in_each_segment(spark, gappy):
    s = as_series(spark, gappy, 64)
    df = s.df.withColumn("seg", (F.col("ord") >= 300).cast("int"))
    got = pandas_of(axis.last_seen(s.with_df(df), {"b": F.col("b")}, by=["seg"]))
    want = pd.concat([gappy["b"][:300].ffill(), gappy["b"][300:].ffill()])
    np.testing.assert_allclose(got["b"], want)


def test_running_totals(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 400), "i": range(400), "v": rng.integers(0, 9, 400)})
    got = axis.running_totals(spark.createDataFrame(pdf), ["g", "i"], {"sum": "v"}).toPandas().sort_values(["g", "i"])
    assert got["sum"].tolist() == pdf.sort_values(["g", "i"])["v"].cumsum().tolist()


@pytest.mark.parametrize("n,k", [(10, 3), (7, 7), (200, 200), (719, 200), (5, 9)])
def test_even_buckets_and_floor_segments(spark, n, k):
    df = spark.range(n).select(stats.even_bucket(F.col("id"), n, k).alias("b"),
                               stats.floor_segment(F.col("id"), n, k).alias("s"), "id").orderBy("id").collect()
    want = np.concatenate([np.full(len(p), i) for i, p in enumerate(np.array_split(np.arange(n), k))])
    assert [r["b"] for r in df] == want.tolist()
    bounds = np.linspace(0, n, k + 1).astype(int)
    assert [r["s"] for r in df] == [int(np.searchsorted(bounds, i, "right") - 1) for i in range(n)]


@pytest.mark.parametrize("gap_rows", [3, 5_000])
def test_exact_quantiles_close_in_on_the_truth(spark, monkeypatch, gap_rows):
    monkeypatch.setattr(stats, "GAP_ROWS", gap_rows)
    rng = np.random.default_rng(2)
    a = rng.normal(size=3000)
    b = np.where(rng.random(3000) < 0.4, 5.0, rng.integers(0, 20, 3000).astype(float))
    a[::7] = np.nan
    pdf = pd.DataFrame({"a": a, "b": b, "none": np.nan, "one": 0.0})
    df = spark.createDataFrame(pdf).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in pdf.columns])
    probs = [0.0, 0.001, 0.25, 0.5, 0.77, 1.0]
    got = stats.exact_quantiles(df, {c: F.col(c) for c in pdf.columns}, probs)
    small = stats.exact_quantiles(df, {c: F.col(c) for c in pdf.columns}, probs, rows_at_most=3000)
    for c in ("a", "b", "one"):
        np.testing.assert_allclose(got[c], np.nanquantile(pdf[c], probs), rtol=1e-12)
        np.testing.assert_allclose(small[c], got[c], rtol=1e-12)
    assert got["none"] == [None] * 6


def test_grouped_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(rng.random(2000) < 0.7, 0, rng.integers(1, 30, 2000)),
                        "v": rng.integers(0, 50, 2000).astype(float)})
    got = quantiles.grouped_quantiles(spark.createDataFrame(pdf), ["g"], F.col("v"), {"p": 0.3, "q": 0.95}).toPandas()
    want = pdf.groupby("g")["v"].quantile([0.3, 0.95]).unstack()
    got = got.set_index("g").sort_index()
    np.testing.assert_allclose(got["p"], want[0.3])
    np.testing.assert_allclose(got["q"], want[0.95])
