import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tideframe.operators import timeaxis  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def walk(n: int, seed: int, extra: bool = True) -> pd.DataFrame:
    """x1 a random walk, x2 noise, x3 unrelated, y linear in x1 and x2."""
    rng = np.random.default_rng(seed)
    x1 = np.cumsum(rng.normal(size=n)) + 50
    x2 = rng.normal(10, 2, size=n)
    out = pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=n, freq="5min"), "x1": x1, "x2": x2})
    if extra:
        out["x3"] = rng.normal(size=n)
    out["y"] = 0.5 * x1 + 2 * x2 + rng.normal(size=n) * 0.3
    return out


def as_series(spark, pdf: pd.DataFrame, chunk: int | None = None):
    frame = spark.createDataFrame(pdf.replace({np.nan: None}) if pdf.isna().any().any() else pdf)
    return timeaxis.to_timeseries(frame, "ts", chunk=chunk).series


def pandas_of(df, by="ord") -> pd.DataFrame:
    return df.toPandas().sort_values(by).reset_index(drop=True)


@pytest.fixture(scope="session")
def gappy() -> pd.DataFrame:
    """Short dropouts in a, one long outage in b, a constant, an almost empty column."""
    rng = np.random.default_rng(5)
    n = 700
    a, b = rng.normal(size=n), np.cumsum(rng.normal(size=n))
    a[10:12] = a[50:52] = a[400:402] = np.nan
    b[200:500] = np.nan
    sparse = np.where(rng.random(n) < 0.6, np.nan, rng.normal(size=n))
    sparse[:5] = np.nan
    return pd.DataFrame({"ts": pd.date_range("2024-03-01", periods=n, freq="5min"), "a": a, "b": b,
                         "flat": 7.0, "sparse": sparse, "y": rng.normal(size=n)})
