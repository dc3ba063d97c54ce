"""The radial machine, and the perceptron that stops by itself."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tideframe.operators import models as M
from tideframe.operators.fourier import FourierFeatures


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 400)
    turn, reach = rng.uniform(0, 2 * np.pi, 400), 1 + 2 * label + rng.normal(0, 0.15, 400)
    rows = [(i, float(y), Vectors.dense(r * np.cos(t), r * np.sin(t))) for i, (y, t, r) in enumerate(zip(label, turn, reach))]
    return spark.createDataFrame(rows, ["ord", "label", "features"]).persist()


def _right(model, df) -> float:
    return model.transform(df).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def test_cosines_near_the_kernel(rings):
    out = FourierFeatures(gamma=0.3, size=4096).transform(rings.limit(12)).toPandas()
    x, z = np.stack(out["features"].map(lambda v: v.toArray())), np.stack(out["fourier"].map(lambda v: v.toArray()))
    assert z @ z.T == pytest.approx(np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1)), abs=0.08)
    assert FourierFeatures().transform(rings.where("ord < 0")).count() == 0


def test_rings_need_the_kernel(rings, tmp_path):
    ctx = M.FitContext("classification", 400, 0.5, 2, 2)
    straight = M.ZOO["SVM"].build(ctx, {"kernel": "linear", "max_iter": 30}).fit(rings)
    bent = M.ZOO["SVM"].build(ctx, {"max_iter": 30, "cosines": 64}).fit(rings)
    assert _right(straight, rings) < 0.75 and _right(bent, rings) > 0.98
    PipelineModel([bent]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(rings).select("ord", F.col("prediction").alias("p"))
    assert again.join(bent.transform(rings), "ord").where("p <> prediction").count() == 0


def test_perceptron_stops_and_keeps_the_best(rings):
    est = M.perceptron(M.FitContext("classification", 400, 0.5, 2, 2), {"hidden": (8,)})
    model = est.fit(rings)
    assert len(est.rounds) * M.ROUND_ITERATIONS < 600 and _right(model, rings) > 0.95
    late = rings.where(F.col("ord") > 360)
    p = F.element_at(M.vector_to_array("probability"), F.col("label").cast("int") + 1)
    loss = model.transform(late).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15))))).first()[0]
    assert loss <= min(est.rounds) + 2e-3
    assert M.perceptron(M.FitContext("classification", 400, 0.5, 2, 2), {"hidden": (4,), "max_iter": 5, "held": 0}).fit(rings)
