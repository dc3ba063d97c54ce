"""Quantiles of few groups, closed in on together."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideframe.functions.stats import group_quantiles


def test_groups_close_in_together(spark):
    rng = np.random.default_rng(3)
    parts = {0: rng.normal(size=9_000), 1: np.repeat([4.0, -1.0, 4.5], [6_000, 900, 2]), 3: np.array([7.0]),
             4: np.round(rng.exponential(size=4_000), 2)}
    rows = pd.concat([pd.DataFrame({"g": g, "x": x}) for g, x in parts.items()])
    df = spark.createDataFrame(rows).unionByName(spark.createDataFrame(
        [(0, None), (1, float("nan")), (4, float("inf"))], "g long, x double")).repartition(5)
    for gap_rows in (20, 100_000):
        got, more = group_quantiles(df, F.col("g"), 5, F.col("x"), [0.1, 0.5, 0.9], {"mean": F.avg("v")}, gap_rows)
        assert got[2] == [None] * 3 and more[2] == {}
        for g, x in parts.items():
            assert got[g] == pytest.approx(np.quantile(x, [0.1, 0.5, 0.9])) and more[g]["mean"] == pytest.approx(x.mean())


def test_nothing_to_rank(spark):
    got, _ = group_quantiles(spark.createDataFrame([], "g int, x double"), F.col("g"), 2, F.col("x"), [0.5])
    assert got == [[None], [None]]
