"""Cross-validated training, leaderboards, the unseen part, tuning, backtests."""

from __future__ import annotations

import hashlib
import json
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.operators import models as M, ranges as RG, scores, select as S, split as SP
from tideframe.operators.axis import ORD, Series
from tideframe.operators.scores import CLASSIFICATION, HIGHER_IS_BETTER, REGRESSION

MAX_THREADS = 4
DIAGNOSTIC = "diagnostic"
EVALUATION = "evaluation"


class UnseenAccessError(RuntimeError):
    """The unseen part was opened twice."""


@dataclass(frozen=True)
class TuneConfig:
    enabled: bool = False
    n_iter: int = 12
    inner_splits: int = 3
    seed: int = 42
    scoring: str | None = None
    models: tuple[str, ...] = ()

    def applies_to(self, name: str) -> bool:
        return self.enabled and (not self.models or name in self.models) and bool(M.ZOO[name].grid)


@dataclass(frozen=True)
class TrainConfig:
    fit: M.FitConfig = M.FitConfig()
    split: SP.SplitConfig = SP.SplitConfig()
    champion_metric: str = "R2"
    ensemble_threshold: float = 0.03
    tune: TuneConfig = TuneConfig()
    params: dict[str, dict] = field(default_factory=dict)
    threads: int = MAX_THREADS

    @property
    def task(self) -> str:
        return self.fit.task


@dataclass
class Trained:
    """What stays of a training run: fitted pipelines and the stored predictions.

    ``predictions`` has one row per (model, part, fold, ord): part ``oof`` for
    rolling-origin folds, ``insample`` and ``holdout`` for the final fit.
    """

    leaderboard: DataFrame
    predictions: DataFrame
    pipelines: dict[str, M.FittedPipeline]
    fold_sets: list[set[str]]
    fold_params: dict[str, list[dict]] = field(default_factory=dict)
    classes: list = field(default_factory=list)

    def oof(self) -> DataFrame:
        return self.predictions.where((F.col("part") == "oof") & (F.col("status") == "ok"))


def _threads(cfg: TrainConfig, n: int) -> int:
    return max(1, min(cfg.threads, n))


def _tagged(df: DataFrame, model: str, part: str, fold: int | Column, purpose: str = EVALUATION) -> DataFrame:
    fold = fold if isinstance(fold, Column) else F.lit(fold)
    prob = F.col("probability") if "probability" in df.columns else F.lit(None).cast("array<double>")
    return df.select(F.lit(model).alias("model"), F.lit(part).alias("part"), fold.alias("fold"),
                     F.lit(purpose).alias("purpose"), ORD, "label",
                     F.col("prediction").cast("double").alias("prediction"),
                     prob.alias("probability"))


def _ridge_folds(series: Series, target: str, features: list[str], folds: list[SP.Fold], fit: M.FitConfig, params: dict | None,
                 part: str = "oof") -> tuple[list[RG.RangeModel], DataFrame]:
    """All folds of a ridge at once: models from shared moments, predictions in one scan, stored."""
    learnt = RG.ridge_ranges(series, target, features, [f.train for f in folds], fit, (params or {}).get("alpha", 1.0))
    made = RG.predict_ranges(series, target, [(f.number, m, f.test) for f, m in zip(folds, learnt)])
    return learnt, staging.store(_tagged(made, "Ridge", part, F.col("fold")), "predictions")


def draw_params(grid: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """Distinct random grid points, at most as many as the grid has."""
    sizes = [len(v) for v in grid.values()]
    total = int(np.prod(sizes)) if sizes else 1
    out = []
    for pick in random.Random(seed).sample(range(total), max(1, min(n_iter, total))):
        chosen = {}
        for (k, values), size in zip(grid.items(), sizes):
            pick, at = divmod(pick, size)
            chosen[k] = values[at]
        out.append(chosen)
    return out


def tune(series: Series, target: str, features: list[str], rng: SP.Range, spec: M.ModelSpec, cfg: TrainConfig,
         classes: list) -> dict:
    """Parameters with the best mean score over inner folds of ``rng`` alone."""
    t = cfg.tune
    params = draw_params(spec.grid, t.n_iter, t.seed)
    inner = SP.rolling_origin(len(rng), max(t.inner_splits, 2), cfg.split.gap, None, rng.lo)
    scored: list[list[float]] = [[] for _ in params]
    metric = t.scoring or ("R2" if cfg.task == REGRESSION else "F1")
    for fold in inner:
        ready = M.prepare(series, target, features, fold.train.where(), cfg.fit, classes)
        test = M.part_of(series, fold.test.where())

        def one(i: int):
            pipe = M.fit(ready, spec, params[i])
            got = _scores(pipe.predict(test), cfg.task, [], len(classes)).first()
            return i, got[metric]

        with ThreadPoolExecutor(_threads(cfg, len(params))) as pool:
            for i, v in pool.map(one, range(len(params))):
                scored[i].append(v if v is not None else float("-inf"))
        M.release(ready)
    sign = 1.0 if HIGHER_IS_BETTER[metric] else -1.0
    return params[int(np.argmax([sign * np.mean(v) for v in scored]))]


def _scores(df: DataFrame, task: str, by: list[str], n_classes: int) -> DataFrame:
    known = df.where(F.col("label").isNotNull() & F.col("prediction").isNotNull())
    return scores.score(known, task, by, n_classes, "probability" if task == CLASSIFICATION else None)


def train_all(series: Series, target: str, features: list[str], split: SP.Split, names: list[str],
              cfg: TrainConfig = TrainConfig(), cross: bool = True, final: bool = True) -> Trained:
    """Fit every model on every fold (``cross``) and on the training part (``final``); score all at once.

    Preprocessing and selection are learnt once per training range and shared,
    as they do not depend on the model. Models on one range run side by side; a
    model that fails is recorded and the others go on.
    """
    known = M.zoo(cfg.task)
    picked = [n for n in names if n in known]
    if not picked:
        raise ValueError("no model to train")
    SP.assert_order(series, split.train, split.valid)
    folds = SP.rolling_origin(len(split.train), cfg.split.n_splits, cfg.split.gap, cfg.split.max_train_size,
                              split.train.lo) if cross else []
    classes: list = []
    if cfg.task == CLASSIFICATION:
        classes = M.classes_of(series.df.where(split.train.where()), target)
    stored: list[DataFrame] = []
    pipelines: dict[str, M.FittedPipeline] = {}
    failed: dict[str, str] = {}
    seconds = {n: 0.0 for n in picked}
    fold_sets: list[set[str]] = []
    fold_params: dict[str, list[dict]] = {}
    steps = [(f.number, f.train, [("oof", f.test)]) for f in folds]
    if folds and picked == ["Ridge"] and not cfg.tune.applies_to("Ridge") and RG.applies(series, features, cfg.fit, [f.train for f in folds]):
        start = time.perf_counter()
        learnt, out = _ridge_folds(series, target, features, folds, cfg.fit, cfg.params.get("Ridge"))
        stored.append(out)
        fold_sets += [set(m.names) for m in learnt] if cfg.fit.fold_selection else []
        seconds["Ridge"] += time.perf_counter() - start
        steps = []
    if final:
        steps.append((0, split.train, [("insample", split.train), ("holdout", split.valid)]))
    for number, rng, parts in steps:
        ready = M.prepare(series, target, features, rng.where(), cfg.fit, classes or None)
        if number and cfg.fit.fold_selection:
            fold_sets.append(set(ready.names))
        assembled = {name: ready.assemble(M.part_of(series, r.where())).persist() for name, r in parts}

        def one(name: str):
            start = time.perf_counter()
            try:
                spec = known[name]
                params = tune(series, target, features, rng, spec, cfg, classes) if cfg.tune.applies_to(name) else {}
                pipe = M.fit(ready, spec, {**cfg.params.get(name, {}), **params})
                out = [staging.store(_tagged(pipe.predict_vectors(df), name, part, number), "predictions")
                       for part, df in assembled.items()]
                return name, pipe, params, out, None, time.perf_counter() - start
            except Exception as e:  # noqa: BLE001 - one model's failure must not stop the rest
                return name, None, {}, [], f"{type(e).__name__}: {str(e)[:200]}", time.perf_counter() - start

        alive = [n for n in picked if n not in failed]
        with ThreadPoolExecutor(_threads(cfg, max(len(alive), 1))) as pool:
            for name, pipe, params, out, error, took in pool.map(one, alive):
                seconds[name] += took
                if error:
                    failed[name] = error
                    continue
                stored += out
                if params:
                    fold_params.setdefault(name, []).append(params)
                if not number:
                    pipelines[name] = pipe
        for df in assembled.values():
            df.unpersist()
        M.release(ready)
    spark = series.df.sparkSession
    status = spark.createDataFrame([(n, "failed" if n in failed else "ok") for n in picked], "model string, status string")
    if stored:
        merged = stored[0]
        for df in stored[1:]:
            merged = merged.unionByName(df)
    else:
        merged = spark.createDataFrame([], "model string, part string, fold int, purpose string, ord bigint, "
                                           "label double, prediction double, probability array<double>")
    predictions = merged.join(F.broadcast(status), "model")
    board = _board(spark, predictions, picked, known, failed, seconds, fold_sets, cfg, len(classes))
    return Trained(sort_leaderboard(board, cfg.champion_metric), predictions, pipelines, fold_sets, fold_params, classes)


PREDICTIONS_SCHEMA = ("model string, part string, fold int, purpose string, ord bigint, label double, prediction double, "
                      "probability array<double>, status string")


class FoldStore:
    """Predictions out of fold by model, settings, split and data, kept as tables in a shared folder.

    A table is named by what it was learnt from, so a changed value, split or setting is another
    table. One that was left half written counts as absent and is written again.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def key(series: Series, target: str, features: list[str], split: SP.Split, name: str, cfg: TrainConfig) -> str:
        from tideframe.operators.quality import fingerprint
        used = [F.col(q(c)) for c in dict.fromkeys([ORD, series.ts, target, *features])]
        about = {"data": fingerprint(series.df.where(split.train.where()).select(*used)).first()["fingerprint"],
                 "target": target, "features": list(features), "train": [split.train.lo, split.train.hi], "model": name,
                 "params": cfg.params.get(name, {}), "fit": asdict(cfg.fit), "split": asdict(cfg.split),
                 "tune": asdict(cfg.tune) if cfg.tune.applies_to(name) else None}
        return hashlib.sha256(json.dumps(about, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        found = self.spark.read.schema(PREDICTIONS_SCHEMA)
        try:
            table = found.parquet(f"{self.path}/{key}")
            return None if table.isEmpty() else table
        except Exception as e:  # nothing was stored under this name
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None

    def put(self, key: str, predictions: DataFrame) -> DataFrame:
        predictions.write.mode("overwrite").parquet(f"{self.path}/{key}")
        return self.spark.read.schema(PREDICTIONS_SCHEMA).parquet(f"{self.path}/{key}")


def with_folds(trained: Trained, series: Series, target: str, features: list[str], split: SP.Split, names: list[str],
               cfg: TrainConfig, kept: FoldStore | None = None) -> Trained:
    """``trained`` with predictions out of fold for each of ``names``: those it has, else those of
    the store, else learnt now on the folds of the training part (and stored). A model that fails
    on a fold gets none."""
    have = {r["model"] for r in trained.oof().select("model").distinct().collect()}       # a row per model
    lacking = [n for n in names if n not in have]
    added, keys = [], {}
    for n in lacking if kept else []:
        keys[n] = kept.key(series, target, features, split, n, cfg)
        found = kept.get(keys[n])
        if found is not None:
            added.append(found)
            lacking = [m for m in lacking if m != n]
    if lacking:
        made = train_all(series, target, features, split, lacking, cfg, final=False).oof()
        if kept:
            learnt = {r["model"] for r in made.select("model").distinct().collect()}
            added += [kept.put(keys[n], made.where(F.col("model") == n).select(*trained.predictions.columns))
                      for n in lacking if n in learnt]
        else:
            added.append(made)
    predictions = trained.predictions
    for df in added:
        predictions = predictions.unionByName(df)
    return replace(trained, predictions=predictions)


def _board(spark, predictions, picked, known, failed, seconds, fold_sets, cfg, n_classes) -> DataFrame:
    metrics = scores.metrics_of(cfg.task)
    ok = predictions.where(F.col("status") == "ok")
    per_fold = _scores(ok, cfg.task, ["model", "part", "fold"], n_classes)
    cv = per_fold.where("part = 'oof'").groupBy("model").agg(
        *[e for m in metrics for e in (F.avg(m).alias(f"cv_{m}"), F.stddev_pop(m).alias(f"cv_{m}_std"))])
    final = [per_fold.where(F.col("part") == part).select("model", *[F.col(m).alias(f"{part}_{m}") for m in metrics])
             for part in ("holdout", "insample")]
    jac = None
    if len(fold_sets) > 1:
        jac = S.jaccard_stability(spark, fold_sets).agg(F.avg("jaccard")).first()[0]
    size = float(np.mean([len(s) for s in fold_sets])) if fold_sets else None
    base = spark.createDataFrame(
        [(n, known[n].family, "failed" if n in failed else "ok", failed.get(n), size, jac, round(seconds[n], 2))
         for n in picked], "model string, family string, status string, error string, "
                           "fold_features_mean double, fold_jaccard double, fit_seconds double")
    out = base.join(cv, "model", "left")
    for f in final:
        out = out.join(f, "model", "left")
    return staging.store(out, "leaderboard")        # few rows; stored so that reading it trains nothing anew


def _ordering(board: DataFrame, metric: str, prefix: str):
    col = F.col(f"{prefix}{metric}")
    best = F.desc_nulls_last if HIGHER_IS_BETTER.get(metric, True) else F.asc_nulls_last
    return [F.asc(F.when(F.col("status") == "ok", 0).otherwise(1)), best(col), F.asc("model")]


def sort_leaderboard(board: DataFrame, metric: str, prefix: str = "holdout_") -> DataFrame:
    """Ranked by the metric, failures last; ranking again changes nothing."""
    if "purpose" in board.columns:
        board = board.where(F.col("purpose") != DIAGNOSTIC)
    if f"{prefix}{metric}" not in board.columns:
        return board
    from pyspark.sql import Window
    board = board.drop("rank")
    place = F.row_number().over(Window.orderBy(*_ordering(board, metric, prefix)))     # one row per model
    return board.select(place.alias("rank"), *board.columns).orderBy("rank")


def pick_champion(board: DataFrame, metric: str, prefix: str = "holdout_") -> str | None:
    ok = board.where(F.col("status") == "ok")
    if f"{prefix}{metric}" not in board.columns:
        first = ok.limit(1).collect()
    else:
        first = ok.orderBy(*_ordering(board, metric, prefix)).limit(1).collect()
    return first[0]["model"] if first else None


# --- the unseen part ----------------------------------------------------------

OPENINGS_SCHEMA = "split_key string, opened_by string, rows bigint"


def split_key(series: Series, split: SP.Split) -> str:
    """Names a split by its data and its unseen bounds."""
    from tideframe.operators.quality import fingerprint
    data = fingerprint(series.df.select(series.ts)).first()["fingerprint"]
    return f"{data}:{split.unseen.lo}:{split.unseen.hi}"


class UnseenGuard:
    """An append-only table of openings; a second opening of a split is refused.

    The check and the append are two steps: one writer at a time is assumed.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def openings(self) -> DataFrame:
        try:
            return self.spark.read.schema(OPENINGS_SCHEMA).parquet(self.path)
        except Exception as e:  # the table does not exist before the first opening
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], OPENINGS_SCHEMA)

    def open(self, key: str, who: str, rows: int) -> None:
        before = self.openings().where(F.col("split_key") == key).limit(1).collect()
        if before:
            raise UnseenAccessError(f"already opened by {before[0]['opened_by']}; split anew to change models")
        self.spark.createDataFrame([(key, who, rows)], OPENINGS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)


def evaluate_unseen(pipe, series: Series, split: SP.Split, guard: UnseenGuard, cfg: TrainConfig,
                    who: str = "champion") -> DataFrame:
    """The champion's scores on the unseen part, once."""
    if guard is None:
        raise UnseenAccessError("the unseen part needs its guard")
    spark = series.df.sparkSession
    if not split.three_way:
        return spark.createDataFrame([], "unseen_rows bigint")
    guard.open(split_key(series, split), who, len(split.unseen))
    pred = pipe.predict(M.part_of(series, split.unseen.where()))
    n_classes = len(getattr(getattr(pipe, "prepared", None), "classes", []) or [])
    got = _scores(pred, cfg.task, [], n_classes)
    return got.select(*[F.col(m).alias(f"unseen_{m}") for m in scores.metrics_of(cfg.task)],
                      F.col("n").alias("unseen_rows"))


def selection_bias_report(board: DataFrame, champion: str, unseen: DataFrame, metric: str) -> DataFrame:
    """Validation score, unseen score, and the difference: how optimistic picking was."""
    n_models = board.agg(F.count_if(F.col("status") == "ok").alias("n_models"))
    row = board.where(F.col("model") == champion).select(F.col(f"holdout_{metric}").alias("validation"))
    out = row.crossJoin(unseen.select(F.col(f"unseen_{metric}").alias("unseen"))).crossJoin(n_models)  # single rows
    return out.select(F.lit(metric).alias("metric"), F.bround("validation", 6).alias("validation"),
                      F.bround("unseen", 6).alias("unseen"),
                      F.bround(F.col("validation") - F.col("unseen"), 6).alias("difference"), "n_models")


def predict_range(pipe, series: Series, start=None, end=None) -> DataFrame:
    """Predictions for instants from ``start`` to ``end``, both included."""
    from tideframe.operators.timeaxis import period
    return pipe.predict(series.with_df(period(series.df, start, end, series.ts)))


def score_by_part(pipe, series: Series, split: SP.Split, task: str = REGRESSION, n_classes: int = 2) -> DataFrame:
    """Scores for each part of the split in one pass."""
    pred = None
    for name, r in split.parts().items():
        part = pipe.predict(M.part_of(series, r.where())).withColumn("part", F.lit(name))
        pred = part if pred is None else pred.unionByName(part)
    return _scores(pred, task, ["part"], n_classes)


def parameter_stability(spark, chosen: list[dict]) -> DataFrame:
    """Per parameter: how many distinct values the folds chose."""
    rows = [(k, i, str(d[k])) for i, d in enumerate(chosen, 1) for k in sorted(d)]
    table = spark.createDataFrame(rows, "parameter string, fold int, value string")
    return stability_of(table)


def stability_of(table: DataFrame) -> DataFrame:
    n = F.col("n_values")
    return (table.groupBy("parameter").agg(F.countDistinct("value").alias("n_values"))
            .withColumn("stability", F.when(n == 1, "consistent").when(n <= 2, "fair").otherwise("unstable"))
            .orderBy("parameter"))


# --- diagnosis: random against time order, rolling backtest -------------------

def random_vs_time(series: Series, target: str, features: list[str], names: list[str],
                   cfg: TrainConfig = TrainConfig(), test_ratio: float = 0.2) -> DataFrame:
    """Each model on a time split and on a random split. The ``purpose`` column
    keeps these rows out of every leaderboard."""
    metric = cfg.champion_metric
    timed = SP.time_holdout(series.n, test_ratio, cfg.split.gap)
    mixed = SP.random_split(series, test_ratio, cfg.fit.seed)
    plans = (("time", series, timed.train.where(), timed.valid.where()),
             ("random", mixed, ~F.col("is_test"), F.col("is_test")))
    stored = []
    for label, s, fit_on, test_on in plans:
        ready = M.prepare(s, target, features, fit_on, cfg.fit)
        for name in [n for n in names if n in M.zoo(cfg.task)]:
            pipe = M.fit(ready, M.ZOO[name], cfg.params.get(name))
            stored.append(staging.store(_tagged(pipe.predict(M.part_of(s, test_on)), name, label, 0, DIAGNOSTIC),
                                        "predictions"))
        classes = len(ready.classes)
        M.release(ready)
    merged = stored[0]
    for df in stored[1:]:
        merged = merged.unionByName(df)
    table = _scores(merged, cfg.task, ["model", "part"], classes)
    wide = table.groupBy("model").pivot("part", ["time", "random"]).agg(F.first(metric))
    sign = 1 if HIGHER_IS_BETTER.get(metric, True) else -1
    return wide.select("model", F.lit(metric).alias("metric"), F.col("time"), F.col("random"),
                       F.bround(F.lit(sign) * (F.col("random") - F.col("time")), 4).alias("gap"),
                       F.lit(DIAGNOSTIC).alias("purpose")).orderBy("model")


def assert_not_diagnostic(table: DataFrame) -> None:
    if "purpose" in table.columns and table.where(F.col("purpose") == DIAGNOSTIC).limit(1).count():
        raise ValueError("random-split scores are for diagnosis, not for choosing a model")


def rolling_backtest(series: Series, target: str, features: list[str], model: str,
                     cfg: TrainConfig = TrainConfig(), n_folds: int = 5, test_size: int | None = None,
                     expanding: bool = True, params: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores per window, stitched predictions): the model refitted before each window."""
    folds = SP.rolling_windows(series.n, n_folds, test_size, cfg.split.gap, expanding)
    stored = []
    if model == "Ridge" and RG.applies(series, features, cfg.fit, [f.train for f in folds]):
        stored.append(_ridge_folds(series, target, features, folds, cfg.fit, params, "backtest")[1])
    for f in folds if not stored else []:
        ready = M.prepare(series, target, features, f.train.where(), cfg.fit)
        pipe = M.fit(ready, M.ZOO[model], params)
        stored.append(staging.store(_tagged(pipe.predict(M.part_of(series, f.test.where())), model, "backtest",
                                            f.number), "predictions"))
        M.release(ready)
    merged = stored[0]
    for df in stored[1:]:
        merged = merged.unionByName(df)
    table = _scores(merged, cfg.task, ["fold"], 2).join(SP.audit(series, folds), "fold")
    return table.withColumn("status", F.lit("ok")).orderBy("fold"), merged


def backtest_summary(table: DataFrame, metric: str = "R2") -> DataFrame:
    """Windows, mean, spread, extremes, and the worst window."""
    worst = F.min_by if HIGHER_IS_BETTER.get(metric, True) else F.max_by
    m = F.col(metric)
    return table.where(F.col("status") == "ok").agg(
        F.count(m).alias("windows"), F.bround(F.avg(m), 4).alias("mean"), F.bround(F.stddev_samp(m), 4).alias("std"),
        F.bround(F.min(m), 4).alias("min"), F.bround(F.max(m), 4).alias("max"),
        worst("fold", m).alias("worst_fold"), worst("test_start", m).alias("worst_start"))
