"""Exact contributions to the output of trees, from the boxes of their leaves.

A leaf is a box: an interval for each feature its path asks about, and what it
answers. For a row and a background row, a set of features taken from the row
reaches the leaf if it has all features where only the row fits the interval
and none where only the background row does. The Shapley values of that game
are known in closed form from the two counts, and those of the model are sums
over leaves, means over background rows. Which intervals a row fits is a bit
mask; equal masks of a batch are worked out once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import classification as C, regression as R
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tideframe import staging
from tideframe.operators.axis import ORD

MASK_BITS = 62
BATCH = 4_096


@dataclass(frozen=True)
class Leaf:
    """``features`` within (low, high], NaN counted as large; ``value`` has a number for each output."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray

    def masks(self, x: np.ndarray) -> np.ndarray:
        """Bit i of a row: its value of the i-th feature lies in the box."""
        out = np.zeros(len(x), dtype=np.int64)
        for i, (f, low, high) in enumerate(zip(self.features, self.low, self.high)):
            v = x[:, f]
            fits = ~(v <= low)
            if high < np.inf:
                fits &= v <= high
            out |= fits.astype(np.int64) << i
        return out


def _shares(most: int) -> np.ndarray:
    """[u, w]: what one of u features the row must give gains, when w must come from elsewhere."""
    out = np.zeros((most + 1, most + 1))
    for u in range(1, most + 1):
        for w in range(most + 1 - u):
            out[u, w] = 1 / (u * math.comb(u + w, u))
    return out


class Explainer:
    """Contributions against a fixed set of background rows."""

    def __init__(self, leaves: list[Leaf], background: np.ndarray):
        self.leaves = [leaf for leaf in leaves if len(leaf.features)]
        self.outputs = len(leaves[0].value)
        deepest = max([len(leaf.features) for leaf in self.leaves], default=0)
        if deepest > MASK_BITS:
            raise ValueError(f"a path asks about {deepest} features; {MASK_BITS} are the most")
        self.shares = _shares(deepest)
        self.base = sum((leaf.value for leaf in leaves if not len(leaf.features)), np.zeros(self.outputs))
        self.known = []
        for leaf in self.leaves:
            masks, n = np.unique(leaf.masks(background), return_counts=True)
            whole = n[masks == (1 << len(leaf.features)) - 1].sum() / len(background)
            self.base = self.base + whole * leaf.value
            self.known.append((masks, n / len(background)))

    def _gains(self, mine: np.ndarray, theirs: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
        """masks x features, for a leaf that answers 1."""
        full = (1 << width) - 1
        a, c = mine[:, None], theirs[None, :]
        live = ((a | c) == full) * weight
        own, other = a & ~c, c & ~a
        u, w = np.bitwise_count(own), np.bitwise_count(other)
        up, down = live * self.shares[u, w], live * self.shares[w, u]
        return np.stack([(up * (own >> i & 1) - down * (other >> i & 1)).sum(1) for i in range(width)], axis=1)

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs x features."""
        out = np.zeros((len(x), self.outputs, x.shape[1]))
        for leaf, (theirs, weight) in zip(self.leaves, self.known):
            mine, at = np.unique(leaf.masks(x), return_inverse=True)
            gains = self._gains(mine, theirs, weight, len(leaf.features))
            out[:, :, leaf.features] += leaf.value[None, :, None] * gains[at][:, None, :]
        return out


def boxes(nodes: dict[int, tuple], answer) -> list[Leaf]:
    """Leaves of nodes {id: (left, right, feature, threshold, payload)} with root 0."""
    out, todo = [], [(0, {})]
    while todo:
        at, path = todo.pop()
        left, right, feature, threshold, payload = nodes[at]
        if left < 0:
            order = sorted(path)
            out.append(Leaf(np.array(order, dtype=np.int64), np.array([path[f][0] for f in order]),
                            np.array([path[f][1] for f in order]), np.asarray(answer(payload), dtype=float)))
            continue
        low, high = path.get(feature, (-np.inf, np.inf))
        todo += [(left, path | {feature: (low, min(high, threshold))}), (right, path | {feature: (max(low, threshold), high)})]
    return out


def _stored_nodes(spark, model) -> dict[int, dict[int, tuple]]:
    """The nodes of every tree of a fitted model, read from its saved form. They are as many as the driver's model has."""
    path = staging.new_path(spark, "trees")
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    out: dict[int, dict[int, tuple]] = {}
    for r in data.select("treeID", "id", "leftChild", "rightChild", "split", "prediction", "impurityStats").collect():
        if r["leftChild"] >= 0 and r["split"]["numCategories"] >= 0:
            raise ValueError("splits on unordered categories are not boxes")
        threshold = r["split"]["leftCategoriesOrThreshold"][0] if r["leftChild"] >= 0 else math.nan
        out.setdefault(r["treeID"], {})[r["id"]] = (r["leftChild"], r["rightChild"], r["split"]["featureIndex"], threshold,
                                                    (r["prediction"], r["impurityStats"]))
    return out


def _share(payload) -> np.ndarray:
    stats = np.asarray(payload[1], dtype=float)
    return stats / stats.sum() if stats.sum() else stats


REGRESSION = (R.DecisionTreeRegressionModel, R.RandomForestRegressionModel, R.GBTRegressionModel)
SHARES = (C.DecisionTreeClassificationModel, C.RandomForestClassificationModel)


def has_trees(model) -> bool:
    if isinstance(model, C.OneVsRestModel):
        return all(isinstance(m, C.GBTClassificationModel) for m in model.models)
    return isinstance(model, (*REGRESSION, *SHARES, C.GBTClassificationModel))


def leaves_of(spark, model) -> tuple[list[Leaf], str] | None:
    """The leaves whose answers add up to the model's, and in which space; None if it has none.

    Regression trees, forests and boosting answer in ``prediction``; classification
    trees and forests with the ``probability`` of every class; boosted classifiers
    with the ``log odds`` of every class.
    """
    if not has_trees(model):
        return None
    if isinstance(model, C.OneVsRestModel):
        parts = [leaves_of(spark, m) for m in model.models]
        one = np.eye(len(parts))
        return [Leaf(leaf.features, leaf.low, leaf.high, leaf.value[1] * one[i]) for i, (own, _) in enumerate(parts) for leaf in own], "log odds"
    if isinstance(model, REGRESSION):
        trees = _stored_nodes(spark, model)
        weights = list(getattr(model, "treeWeights", [1.0]))
        total = sum(weights) if isinstance(model, R.RandomForestRegressionModel) else 1.0
        return [leaf for t, nodes in trees.items() for leaf in boxes(nodes, lambda p, t=t: [weights[t] / total * p[0]])], "prediction"
    if isinstance(model, SHARES):
        trees = _stored_nodes(spark, model)
        return [leaf for nodes in trees.values() for leaf in boxes(nodes, lambda p: _share(p) / len(trees))], "probability"
    weights = list(model.treeWeights)
    return [leaf for t, nodes in _stored_nodes(spark, model).items()
            for leaf in boxes(nodes, lambda p, t=t: [-2 * weights[t] * p[0], 2 * weights[t] * p[0]])], "log odds"


def contribution_table(explainer: Explainer, rows: DataFrame, names: list[str], ts: str) -> DataFrame:
    """(ord, ts, output, feature, feature_value, shap_value) of rows (ord, ts, features)."""
    sent = rows.sparkSession.sparkContext.broadcast(explainer)     # as large as the model, which the driver holds
    source = rows.select(ORD, ts, vector_to_array("features").alias("v"))

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = np.asarray(part.column(2).flatten(), dtype=float).reshape(part.num_rows, -1)
                found = sent.value.contributions(x)
                n, k, d = found.shape
                row = pa.array(np.repeat(np.arange(n), k * d))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(row), part.column(1).take(row), pa.array(np.tile(np.repeat(np.arange(k), d), n), pa.int32()),
                     pa.array(np.tile(np.arange(d), n * k), pa.int32()), pa.array(np.repeat(x, k, axis=0).ravel()), pa.array(found.ravel())],
                    names=[ORD, ts, "output", "at", "feature_value", "shap_value"])

    schema = source.select(ORD, ts).schema.add("output", "integer").add("at", "integer").add("feature_value", "double").add("shap_value", "double")
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    return source.mapInArrow(work, schema).select(ORD, ts, "output", named.alias("feature"), "feature_value", "shap_value")
