"""A radial kernel as features of bounded number, so that linear learners bend."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """``size`` random cosines whose inner products near exp(-gamma |x - y|^2).

    The directions follow from seed and dimension, so nothing is fitted and a task needs only
    dimension x size numbers. The error of a kernel value falls as 1 / sqrt(size). An entry that is
    null or not finite makes the whole row's cosines NaN, as such a row has no distance.
    """

    gamma = Param(Params._dummy(), "gamma", "how fast the kernel falls", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of cosines", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol: str = "features", outputCol: str = "fourier", gamma: float = 1.0, size: int = 256, seed: int = 42):
        super().__init__()
        self._setDefault(inputCol="features", outputCol="fourier", gamma=1.0, size=256, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, size, seed = self.getOrDefault("gamma"), self.getOrDefault("size"), self.getSeed()

        @F.pandas_udf("array<double>")
        def cosines(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            drawn = None
            for rows in batches:
                if not len(rows):
                    yield pd.Series([], dtype=object)
                    continue
                x = np.array([np.asarray(r, dtype=float) for r in rows])
                if drawn is None:
                    rng = np.random.default_rng(seed)
                    drawn = rng.normal(scale=np.sqrt(2 * gamma), size=(x.shape[1], size)), rng.uniform(0, 2 * np.pi, size)
                yield pd.Series(list(np.sqrt(2 / size) * np.cos(x @ drawn[0] + drawn[1])))

        return df.withColumn(self.getOutputCol(), array_to_vector(cosines(vector_to_array(self.getInputCol()))))
