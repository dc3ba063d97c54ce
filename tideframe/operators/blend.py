"""Blends of out-of-fold predictions, and when one may replace a single model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.operators import models as M, scores, split as SP, train as T
from tideframe.operators.axis import ORD, Series
from tideframe.operators.scores import CLASSIFICATION, HIGHER_IS_BETTER

FAMILY = "blend"
PREFIX = "Ensemble_"
MIN_META_ROWS = 10
# The ridge penalties tried for stacking, 1e-3 to 1e3.
META_ALPHAS = tuple(10.0 ** (-3 + i / 2) for i in range(13))


def oof_matrix(trained: T.Trained, names: list[str]) -> DataFrame:
    """(ord, label, one column per model), rows every model has predicted."""
    wide = trained.oof().where(F.col("model").isin(list(names))).groupBy(ORD).pivot("model", list(names)) \
        .agg(F.first("prediction", ignorenulls=True))
    labels = trained.oof().where(F.col("model") == names[0]).select(ORD, "label")
    return wide.join(labels, ORD).dropna(subset=[*names, "label"])


def normal_equations(matrix: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A'A and A'y of the prediction matrix, k x k sums in one pass."""
    row = matrix.agg(*[F.sum(F.col(q(a)) * F.col(q(b))) for a in names for b in [*names, "label"]]).first()
    full = np.array([v or 0.0 for v in row], dtype=float).reshape(len(names), len(names) + 1)
    return full[:, :-1], full[:, -1]


def nonnegative_weights(ata: np.ndarray, aty: np.ndarray) -> np.ndarray:
    """Weights >= 0 that minimise the squared error, scaled to sum 1; equal ones
    if there is no such fit. Models are added while their gradient is positive
    and taken out when their weight would turn negative."""
    k = len(aty)
    w = np.zeros(k)
    active: list[int] = []
    for _ in range(10 * k):
        slope = aty - ata @ w
        free = [i for i in range(k) if i not in active]
        if not free or max(slope[i] for i in free) <= 1e-9 * max(abs(aty).max(), 1e-30):
            break
        active.append(max(free, key=lambda i: slope[i]))
        while active:
            z = np.zeros(k)
            z[active] = np.linalg.lstsq(ata[np.ix_(active, active)], aty[active], rcond=None)[0]
            if (z[active] > 0).all():
                w = z
                break
            step = min(w[i] / (w[i] - z[i]) for i in active if z[i] <= 0 and w[i] != z[i]) \
                if any(z[i] <= 0 and w[i] != z[i] for i in active) else 0.0
            w = w + step * (z - w)
            active = [i for i in active if w[i] > 1e-14]
            w[[i for i in range(k) if i not in active]] = 0.0
    if not np.isfinite(w).all() or w.sum() <= 0:
        return np.full(k, 1.0 / k)
    return w / w.sum()


def stack_coefficients(matrix: DataFrame, names: list[str]) -> tuple[np.ndarray, float, float]:
    """(coefficients, intercept, alpha) of a ridge on the predictions.

    The penalty has the least leave-one-out error. Each row's leverage needs
    only a k x k matrix per penalty, so one pass scores them all.
    """
    n = matrix.count()
    if n < MIN_META_ROWS:
        raise ValueError("too few out-of-fold rows for stacking")
    means = matrix.agg(*[F.avg(q(c)) for c in [*names, "label"]]).first()
    mx, my = np.array(means[:-1], dtype=float), float(means[-1])
    centred = matrix.select(*[(F.col(q(c)) - F.lit(float(m))).alias(c) for c, m in zip(names, mx)],
                            (F.col("label") - F.lit(my)).alias("label"))
    ata, aty = normal_equations(centred, names)
    inverses = [np.linalg.inv(ata + a * np.eye(len(names))) for a in META_ALPHAS]
    coefs = [inv @ aty for inv in inverses]
    k = len(names)

    def left_out(batches):
        total = np.zeros(len(inverses))
        for pdf in batches:
            v = pdf.to_numpy(dtype=float)
            x, y = v[:, :k], v[:, k]
            for i, (inv, b) in enumerate(zip(inverses, coefs)):
                leverage = ((x @ inv) * x).sum(1) + 1.0 / n
                total[i] += (((y - x @ b) / (1 - leverage)) ** 2).sum()
        yield pd.DataFrame({"i": range(len(inverses)), "e": total})

    errors = {r["i"]: r["e"] for r in centred.mapInPandas(left_out, "i int, e double").groupBy("i")
              .agg(F.sum("e").alias("e")).collect()}
    best = min(errors, key=lambda i: (errors[i], i))
    return coefs[best], float(my - mx @ coefs[best]), META_ALPHAS[best]


@dataclass
class Blend:
    """A linear combination of fitted pipelines; soft vote for classes."""

    name: str
    members: dict[str, M.FittedPipeline]
    weights: np.ndarray
    intercept: float = 0.0
    task: str = scores.REGRESSION

    @property
    def prepared(self):
        return next(iter(self.members.values())).prepared

    def parts(self):
        return [(n, p, float(w)) for (n, p), w in zip(self.members.items(), self.weights)]

    def predict(self, part: Series) -> DataFrame:
        return self.predict_vectors(self.prepared.assemble(part))

    def predict_grid(self, part: Series, feature: str, grid: list[float], only: DataFrame | None = None) -> DataFrame:
        return self.predict_vectors(self.prepared.over_grid(part, feature, grid, only))

    def predict_vectors(self, df: DataFrame) -> DataFrame:
        """Members share one preprocessing, so one row carries all their answers."""
        out = df
        for i, pipe in enumerate(self.members.values()):
            scored = pipe.model.transform(out)
            value = F.col("prediction") if self.task != CLASSIFICATION else _probability(scored)
            out = scored.withColumn(f"_m{i}", value).drop(
                *[c for c in ("prediction", "rawPrediction", "probability") if c in scored.columns])
        keep = [F.col(q(c)) for c in df.columns if c != "features"]
        if self.task != CLASSIFICATION:
            total = F.lit(float(self.intercept))
            for i, w in enumerate(self.weights):
                total = total + F.lit(float(w)) * F.col(f"_m{i}")
            return out.select(*keep, total.alias("prediction"))
        shares = F.array(*[sum((F.col(f"_m{i}")[c] for i in range(len(self.members))), F.lit(0.0))
                           / F.lit(len(self.members)) for c in range(len(self.prepared.classes))])
        voted = out.select(*keep, shares.alias("probability"))
        return voted.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1)
                                .cast("double"))


def _probability(scored: DataFrame):
    from pyspark.ml.functions import vector_to_array
    if "probability" not in scored.columns:
        raise ValueError("soft voting needs class probabilities")
    return vector_to_array("probability")


def fit_blends(series: Series, split: SP.Split, trained: T.Trained, names: list[str], cfg: T.TrainConfig,
               include: tuple[str, ...] = ("Voting", "Weighted", "Stacking"), features: list[str] | None = None,
               kept: T.FoldStore | None = None) -> tuple[DataFrame, dict[str, Blend]]:
    """Blends of already fitted models, scored like them.

    A fitted model is never fitted anew. Weights need predictions out of fold;
    where ``trained`` lacks a model's, they are taken from ``kept`` or learnt from
    ``features`` (those the model was prepared with, if not given). A model that
    fails on a fold is in no blend.
    """
    used = [n for n in names if n in trained.pipelines]
    spark = series.df.sparkSession
    if cfg.task != CLASSIFICATION and len(used) > 1 and {"Weighted", "Stacking"} & set(include):
        ready = trained.pipelines[used[0]].prepared
        trained = T.with_folds(trained, series, ready.target, features or [*ready.prep.numeric, *ready.prep.categorical],
                               split, used, cfg, kept)
        have = {r["model"] for r in trained.oof().select("model").distinct().collect()}      # a row per model
        used = [n for n in used if n in have]
    if len(used) < 2:
        return spark.createDataFrame([], "model string, family string, status string"), {}
    members = {n: trained.pipelines[n] for n in used}
    made: dict[str, Blend] = {}
    rows = 0
    if "Voting" in include:
        made[PREFIX + "Voting"] = Blend(PREFIX + "Voting", members, np.full(len(used), 1 / len(used)), 0.0, cfg.task)
    if cfg.task != CLASSIFICATION:
        matrix = staging.store(oof_matrix(trained, used), "oof")
        rows = matrix.count()
        if "Weighted" in include and rows:
            made[PREFIX + "Weighted"] = Blend(PREFIX + "Weighted", members,
                                              nonnegative_weights(*normal_equations(matrix, used)))
        if "Stacking" in include and rows >= MIN_META_ROWS:
            coef, intercept, _ = stack_coefficients(matrix, used)
            made[PREFIX + "Stacking"] = Blend(PREFIX + "Stacking", members, coef, intercept)
    pred = None
    for name, blend in made.items():
        for part, r in (("insample", split.train), ("holdout", split.valid)):
            df = T._tagged(blend.predict(M.part_of(series, r.where())), name, part, 0)
            pred = df if pred is None else pred.unionByName(df)
    table = T._scores(pred, cfg.task, ["model", "part"], len(trained.classes))
    metrics = scores.metrics_of(cfg.task)
    wide = table.groupBy("model").pivot("part", ["insample", "holdout"]).agg(*[F.first(m).alias(m) for m in metrics])
    about = spark.createDataFrame(
        [(n, FAMILY, "ok", ", ".join(used), "; ".join(f"{m}={w:.3f}" for m, w in zip(used, b.weights)), rows)
         for n, b in made.items()], "model string, family string, status string, members string, weights string, "
                                    "oof_rows int")
    return staging.store(about.join(wide, "model", "left"), "leaderboard"), made


def weight_table(spark, blend: Blend) -> DataFrame:
    rows = [(n, round(w, 4)) for n, _, w in blend.parts()]
    return spark.createDataFrame(rows, "model string, weight double").orderBy(F.desc("weight"), "model")


def is_blend():
    return (F.coalesce(F.col("family"), F.lit("")) == FAMILY) | F.col("model").startswith(PREFIX)


def adoption_table(board: DataFrame, metric: str, threshold: float = 0.03, prefix: str = "cv_") -> DataFrame:
    """(model, score, gain, verdict): the best single model, then every blend against it.

    A blend is adopted for a relative gain of at least ``threshold``.
    """
    higher = HIGHER_IS_BETTER.get(metric, True)
    col = F.col(f"{prefix}{metric}")
    rows = board.where((F.col("status") == "ok") & col.isNotNull()).select("model", col.alias("score"),
                                                                           is_blend().alias("blend"))
    order = F.struct(F.col("score") if higher else -F.col("score"), F.col("model"))
    best = rows.where(~F.col("blend")).agg(F.max_by("model", order).alias("base_model"),
                                           F.max_by("score", order).alias("base"))
    joined = rows.crossJoin(F.broadcast(best))          # one row on the right
    diff = F.col("score") - F.col("base") if higher else F.col("base") - F.col("score")
    gain = F.try_divide(diff, F.abs("base"))
    verdict = F.when(~F.col("blend"), "best single").when(gain >= threshold, "adopted").otherwise("rejected")
    kept = joined.where(F.col("blend") | (F.col("model") == F.col("base_model")))
    return kept.select("model", F.bround("score", 6).alias("score"),
                       F.bround(F.when(F.col("blend"), gain).otherwise(0.0), 4).alias("gain"),
                       verdict.alias("verdict")).orderBy(F.asc(F.col("verdict") != "best single"), F.desc("gain"), "model")


def adopt(board: DataFrame, metric: str, threshold: float = 0.03, prefix: str = "cv_") -> tuple[str | None, DataFrame]:
    """The model to use, and the table it was decided on."""
    table = adoption_table(board, metric, threshold, prefix)
    rows = table.collect()          # one row per blend, and one
    adopted = [r for r in rows if r["verdict"] == "adopted"]
    single = [r for r in rows if r["verdict"] == "best single"]
    if adopted:
        return max(adopted, key=lambda r: r["gain"])["model"], table
    if single:
        return single[0]["model"], table
    return (rows[0]["model"] if rows else None), table
