"""The model zoo: what each entry is in Spark ML, and how a pipeline is fitted."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, classification as C, regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import kind, q
from tideframe.functions.stats import clean_double
from tideframe import staging
from tideframe.operators import neighbours, prep as P, select as S
from tideframe.operators.axis import ORD, Series
from tideframe.operators.fourier import FourierFeatures
from tideframe.operators.scores import CLASSIFICATION, REGRESSION



@dataclass(frozen=True)
class FitContext:
    """What an entry may know about the training rows."""

    task: str
    n: int
    target_sd: float
    n_features: int
    n_classes: int
    seed: int = 42


@dataclass(frozen=True)
class ModelSpec:
    name: str
    family: str
    tasks: tuple[str, ...]
    build: Callable[[FitContext, dict], object]
    heavy: bool = False
    grid: dict[str, list] = field(default_factory=dict)


def ridge(ctx: FitContext, p: dict) -> Estimator:
    """Spark divides the penalty by sd(y) and averages the loss; undo both."""
    alpha = p.get("alpha", 1.0)
    return R.LinearRegression(solver="normal", elasticNetParam=0.0, standardization=False,
                              regParam=alpha / ctx.n * (ctx.target_sd or 1.0))


def elastic_net(ctx: FitContext, p: dict) -> Estimator:
    alpha, share = p.get("alpha", 0.05), p.get("l1_ratio", 0.5)
    l1, l2 = alpha * share, alpha * (1 - share) * (ctx.target_sd or 1.0)
    total = l1 + l2
    return R.LinearRegression(standardization=False, regParam=total, maxIter=500, tol=1e-9,
                              elasticNetParam=l1 / total if total else 0.0)


def logistic(ctx: FitContext, p: dict) -> Estimator:
    return C.LogisticRegression(standardization=False, regParam=1.0 / (ctx.n * p.get("C", 1.0)),
                                maxIter=500, tol=1e-9)


def tree(ctx: FitContext, p: dict) -> Estimator:
    cls = R.DecisionTreeRegressor if ctx.task == REGRESSION else C.DecisionTreeClassifier
    return cls(maxDepth=p.get("max_depth", 8), minInstancesPerNode=p.get("min_leaf", 1), seed=ctx.seed)


def forest(ctx: FitContext, p: dict) -> Estimator:
    cls = R.RandomForestRegressor if ctx.task == REGRESSION else C.RandomForestClassifier
    return cls(numTrees=p.get("n_trees", 400), maxDepth=p.get("max_depth", DEEPEST), seed=ctx.seed,
               minInstancesPerNode=p.get("min_leaf", 2), featureSubsetStrategy=p.get("features", "all" if ctx.task == REGRESSION else "sqrt"))


def boosting(ctx: FitContext, p: dict) -> Estimator:
    cls = R.GBTRegressor if ctx.task == REGRESSION else C.GBTClassifier
    one = cls(maxIter=p.get("n_rounds", 400), stepSize=p.get("rate", 0.05), maxDepth=p.get("max_depth", 5),
              minInstancesPerNode=p.get("min_leaf", 20), subsamplingRate=p.get("subsample", 1.0), seed=ctx.seed)
    return C.OneVsRest(classifier=one) if ctx.task == CLASSIFICATION and ctx.n_classes > 2 else one


def kernel_svc(ctx: FitContext, p: dict) -> Estimator:
    """A linear machine on random cosines of a radial kernel; ``kernel="linear"`` leaves them out."""
    radial = p.get("kernel", "radial") == "radial"
    column = "fourier" if radial else "features"
    one = C.LinearSVC(regParam=1.0 / (ctx.n * p.get("C", 10.0)), maxIter=p.get("max_iter", 200), featuresCol=column)
    machine = C.OneVsRest(classifier=one, featuresCol=column) if ctx.n_classes > 2 else one
    if not radial:
        return machine
    cosines = FourierFeatures(outputCol=column, gamma=float(p.get("gamma", 1 / max(1, ctx.n_features))),
                              size=p.get("cosines", 256), seed=ctx.seed)
    return Pipeline(stages=[cosines, machine])


def perceptron(ctx: FitContext, p: dict) -> "PatientPerceptron":
    layers = [ctx.n_features, *p.get("hidden", (128, 64)), max(ctx.n_classes, 2)]
    return PatientPerceptron(layers, p.get("max_iter", 600), ctx.seed, p.get("held", 0.1), p.get("patience", 3))


ROUND_ITERATIONS = 25


@dataclass
class PatientPerceptron:
    """Trains in warm-started rounds and stops when rows held back gain no more.

    The last ``held`` share of the rows by ordinal is held back. A round takes up the weights of the
    one before; after ``patience`` rounds without a smaller log loss there, or ``max_iter``
    iterations in all, the best round's model is kept. ``held=0`` trains to the end on all rows.
    """

    layers: list[int]
    max_iter: int
    seed: int
    held: float = 0.1
    patience: int = 3
    rounds: list[float] = field(default_factory=list)

    def _one(self, iterations: int, start=None) -> C.MultilayerPerceptronClassifier:
        out = C.MultilayerPerceptronClassifier(layers=self.layers, maxIter=iterations, seed=self.seed)
        return out.setInitialWeights(start) if start is not None else out

    def fit(self, df: DataFrame) -> C.MultilayerPerceptronClassificationModel:
        cut = df.agg(F.percentile_approx(ORD, 1.0 - self.held, 10_000)).first()[0] if self.held else None
        early, late = (df.where(F.col(ORD) <= cut), df.where(F.col(ORD) > cut)) if cut is not None else (df, None)
        if late is None or not late.limit(1).count():
            return self._one(self.max_iter).fit(df)
        early, late = early.persist(), late.persist()
        sure = F.greatest(F.get(vector_to_array("probability"), F.col("label").cast("int")), F.lit(1e-15))
        self.rounds, best, model, done = [], None, None, 0
        while done < self.max_iter and (best is None or len(self.rounds) - best[0] <= self.patience):
            step = min(ROUND_ITERATIONS, self.max_iter - done)
            model = self._one(step, model.weights if model is not None else None).fit(early)
            done += step
            loss = model.transform(late).agg(F.avg(-F.log(sure))).first()[0]
            self.rounds.append(loss)
            if best is None or loss < best[1] - 1e-4:
                best = (len(self.rounds), loss, model)
        early.unpersist()
        late.unpersist()
        return best[2]


def nearest(ctx: FitContext, p: dict) -> "KnnEstimator":
    return KnnEstimator(p.get("n_neighbors", 15), ctx.task, ctx.n_classes, p.get("weights", "uniform"))


ALL = (REGRESSION, CLASSIFICATION)
DEEPEST = 30        # the depth at which Spark's trees end
# Defaults and search grids, in Spark's terms.
ZOO: dict[str, ModelSpec] = {s.name: s for s in (
    ModelSpec("Ridge", "linear", (REGRESSION,), ridge, grid={"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}),
    ModelSpec("ElasticNet", "linear", (REGRESSION,), elastic_net,
              grid={"alpha": [0.005, 0.01, 0.05, 0.1, 0.5], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9]}),
    ModelSpec("LogisticRegression", "linear", (CLASSIFICATION,), logistic, grid={"C": [0.01, 0.1, 1.0, 10.0]}),
    ModelSpec("DecisionTree", "tree", ALL, tree,
              grid={"max_depth": [4, 6, 8, 12, DEEPEST], "min_leaf": [1, 2, 5, 10, 20]}),
    ModelSpec("RandomForest", "ensemble", ALL, forest,
              grid={"n_trees": [200, 400, 800], "max_depth": [8, 16, DEEPEST], "min_leaf": [1, 2, 5],
                    "features": ["sqrt", "0.5", "all"]}),
    ModelSpec("GradientBoosting", "boosting", ALL, boosting,
              grid={"rate": [0.02, 0.05, 0.1], "n_rounds": [200, 400, 800], "max_depth": [3, 5, 6],
                    "subsample": [0.7, 0.85, 1.0], "min_leaf": [10, 20, 50]}),
    ModelSpec("KNN", "neighbors", ALL, nearest, heavy=True, grid={"n_neighbors": [5, 10, 15, 25, 40],
                                                                    "weights": ["uniform", "distance"]}),
    ModelSpec("SVM", "svm", (CLASSIFICATION,), kernel_svc, heavy=True, grid={"C": [1.0, 10.0, 100.0]}),
    ModelSpec("MLP", "neural", (CLASSIFICATION,), perceptron, heavy=True,
              grid={"hidden": [(64,), (128, 64), (256, 128)]}),
)}


def zoo(task: str, include_heavy: bool = True) -> dict[str, ModelSpec]:
    return {n: s for n, s in ZOO.items() if task in s.tasks and (include_heavy or not s.heavy)}


MAX_WHOLE_CLASSES = 15


def detect_task(df: DataFrame, target: str) -> str:
    """Text, at most two values, or at most 15 whole-number values mean classes.

    The distinct values are counted only when all are whole numbers; two values
    or fewer show as nothing between the extremes.
    """
    if kind(df.schema[target].dataType) != "numeric":
        return CLASSIFICATION
    y = clean_double(F.col(q(target)))
    r = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi"), F.every(y % 1 == 0).alias("whole")).first()
    if r["lo"] is None or not df.where((y > F.lit(r["lo"])) & (y < F.lit(r["hi"]))).limit(1).count():
        return CLASSIFICATION
    if not r["whole"]:
        return REGRESSION
    return CLASSIFICATION if df.agg(F.countDistinct(y)).first()[0] <= MAX_WHOLE_CLASSES else REGRESSION


# --- nearest neighbours as a model ------------------------------------------

@dataclass
class KnnEstimator:
    k: int
    task: str
    n_classes: int
    weights: str = "uniform"

    def __post_init__(self):
        if self.weights not in ("uniform", "distance"):
            raise ValueError(f"no such weights: {self.weights}")

    def fit(self, df: DataFrame) -> "KnnModel":
        points = df.select(vector_to_array("features").alias("vec"), "label")
        if self.task == REGRESSION:
            payload = {"value": F.avg("label")}
        else:
            payload = {f"c{i}": F.avg((F.col("label") == i).cast("double")) for i in range(self.n_classes)}
        base, cells = neighbours.build_cells(neighbours.merged(points, payload))
        return KnnModel(self.k, self.task, base, cells, list(payload), self.weights)


@dataclass
class KnnModel:
    k: int
    task: str
    base: DataFrame
    cells: neighbours.Cells
    payload: list[str]
    weights: str = "uniform"

    def _mean(self, value: Column, used: Column) -> Column:
        """Mean over the neighbours of a query; by distance, the ones at the query itself decide alone."""
        if self.weights == "uniform":
            return F.sum(value * used) / F.sum(used)
        at, away = F.when(F.col("dist") == 0, used), F.when(F.col("dist") > 0, used / F.col("dist"))
        return F.coalesce(F.sum(value * at) / F.sum(at), F.sum(value * away) / F.sum(away))

    def transform(self, df: DataFrame) -> DataFrame:
        """Mean of the k nearest, or their vote, equally or weighted by the inverse distance; ties in
        distance by point number. A vector that many rows hold is asked once."""
        tagged = df.withColumn("vec", vector_to_array("features"))
        asked = neighbours.merged(tagged.select("vec"), {})
        near = neighbours.knn(asked, self.base, self.cells, self.k, {c: "double" for c in self.payload})
        used = F.least(F.col("weight"), F.lit(float(self.k)) - F.col("before"))
        means = near.groupBy("pid").agg(*[self._mean(F.col(c), used).alias(f"_{c}") for c in self.payload])
        answers = staging.store(asked.select("vec", "weight", "pid").join(means, "pid"), "answers")
        out = neighbours.matched(tagged, answers, [f"_{c}" for c in self.payload]).drop("vec")
        if self.task == REGRESSION:
            return out.withColumnRenamed("_value", "prediction")
        shares = F.array(*[F.col(f"_{c}") for c in self.payload])
        return (out.withColumn("probability", array_to_vector(shares))
                .withColumn("prediction", (F.array_position(shares, F.array_max(shares)) - 1).cast("double"))
                .drop(*[f"_{c}" for c in self.payload]))


# --- one fitted pipeline ------------------------------------------------------

@dataclass(frozen=True)
class FitConfig:
    task: str = REGRESSION
    prep: P.PreprocessConfig = P.PreprocessConfig()
    fold_selection: bool = True
    top_k: int | None = None
    corr_threshold: float = S.CORR_LIMIT
    min_variance: float = S.MIN_VARIANCE
    seed: int = 42


@dataclass
class Prepared:
    """Preprocessing and selection learnt on one range, shared by every model on it."""

    prep: P.FittedPrep
    names: list[str]
    target: str
    task: str
    classes: list
    context: FitContext
    frame: DataFrame

    def label(self) -> Column:
        if self.task == REGRESSION:
            return clean_double(F.col(q(self.target)))
        if not self.classes:
            return F.lit(None).cast("double")
        place = F.array_position(F.lit(self.classes), F.col(q(self.target)))      # 0 for a class unknown in training
        return F.when(place > 0, (place - 1).cast("double"))

    def assemble(self, part: Series) -> DataFrame:
        """(ord, ts, label, features) for a range; the feature axis is ``names``."""
        known = self.target in part.df.columns
        label = self.label() if known else F.lit(None).cast("double")
        filled = self.prep.impute(part.with_df(part.df.withColumn("label", label)))
        return self.pack(filled, [ORD, part.ts, "label"])

    def pack(self, filled: DataFrame, keep: list[str]) -> DataFrame:
        """Vectors of rows whose numbers are already filled."""
        ready = self.prep.finish(filled, keep)
        packed = VectorAssembler(inputCols=self.names, outputCol="features", handleInvalid="keep").transform(ready)
        return packed.select(*keep, "features")

    def over_grid(self, part: Series, feature: str, grid: list[float], only: DataFrame | None = None) -> DataFrame:
        """(ord, ts, grid, features): every row (or those ``only`` lists) at every value of one input."""
        if feature not in part.df.columns:
            raise KeyError(feature)
        filled = listed(self.prep.impute(part), only)
        at = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
        moved = filled.withColumn("grid", at).withColumn(feature, F.col("grid"))
        return self.pack(moved, [ORD, part.ts, "grid"])

    def columns(self, part: Series) -> DataFrame:
        """The transformed columns themselves, for explanation and review."""
        keep = [ORD, part.ts, *([self.target] if self.target in part.df.columns else [])]
        return self.prep.transform(part, keep).select(*keep, *[F.col(q(c)) for c in self.names])


def classes_of(df: DataFrame, target: str) -> list:
    """Every class of the target, in order."""
    return sorted(r[0] for r in df.select(q(target)).where(F.col(q(target)).isNotNull()).distinct().collect())


def listed(df: DataFrame, only: DataFrame | None) -> DataFrame:
    """The rows whose ordinal a small table lists; all without one."""
    return df if only is None else df.join(F.broadcast(only.select(ORD)), ORD, "left_semi")


def part_of(series: Series, where) -> Series:
    return series.with_df(series.df.where(where))


def prepare(series: Series, target: str, features: list[str], where, cfg: FitConfig,
            classes: list | None = None) -> Prepared:
    """Fit preprocessing, then selection, on the rows of ``where`` only."""
    needed = dict.fromkeys([ORD, series.ts, target, *features])
    train = series.with_df(series.df.where(where).select(*[F.col(q(c)) for c in needed]))
    numeric, categorical = P.column_types(series, features)
    fitted, filled = P.fit_filled(train, numeric, categorical, cfg.prep)
    if cfg.task == CLASSIFICATION and classes is None:
        classes = classes_of(train.df, target)
    names = fitted.output_columns
    out = Prepared(fitted, names, target, cfg.task, classes or [], None, None)
    if cfg.fold_selection and names:
        ready = fitted.finish(filled, [target])
        chosen = S.select_features(ready, names, target, cfg.task, cfg.top_k, cfg.corr_threshold,
                                   cfg.min_variance, compute_mi=bool(cfg.top_k)).names
        out.names = chosen or names
    labelled = filled.withColumn("label", out.label())
    out.frame = out.pack(labelled, [ORD, train.ts, "label"]).where(F.col("label").isNotNull()).persist()
    if out.classes:
        # Without it Spark's classifiers take no more than 100 classes.
        out.frame = out.frame.withMetadata("label", {"ml_attr": {"type": "nominal", "num_vals": len(out.classes)}})
    r = out.frame.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    filled.unpersist()
    out.context = FitContext(cfg.task, r[0], r[1] or 0.0, len(out.names), len(out.classes), cfg.seed)
    return out


@dataclass
class FittedPipeline:
    spec: ModelSpec
    prepared: Prepared
    model: object
    params: dict

    @property
    def names(self) -> list[str]:
        return self.prepared.names

    def predict_vectors(self, df: DataFrame) -> DataFrame:
        """Predictions for rows that already hold a ``features`` vector."""
        out = self.model.transform(df)
        keep = [c for c in df.columns if c != "features"]
        cols = [F.col(q(c)) for c in keep] + [F.col("prediction")]
        if "probability" in out.columns:
            cols.append(vector_to_array("probability").alias("probability"))
        elif self.prepared.task == CLASSIFICATION:
            cols.append(F.lit(None).cast("array<double>").alias("probability"))
        return out.select(*cols)

    def predict(self, part: Series) -> DataFrame:
        """(ord, ts, label, prediction[, probability])."""
        return self.predict_vectors(self.prepared.assemble(part))

    def predict_grid(self, part: Series, feature: str, grid: list[float], only: DataFrame | None = None) -> DataFrame:
        return self.predict_vectors(self.prepared.over_grid(part, feature, grid, only))

    def linear_terms(self) -> tuple[list[float], float] | None:
        if isinstance(self.model, R.LinearRegressionModel):
            return [float(x) for x in self.model.coefficients], float(self.model.intercept)
        return None


def fit(prepared: Prepared, spec: ModelSpec, params: dict | None = None) -> FittedPipeline:
    params = dict(params or {})
    estimator = spec.build(prepared.context, params)
    return FittedPipeline(spec, prepared, estimator.fit(prepared.frame), params)


def release(prepared: Prepared) -> None:
    prepared.frame.unpersist()


@dataclass(frozen=True)
class LinearFormula:
    """A linear predictor given by its terms, over raw columns."""

    terms: dict[str, float]
    intercept: float = 0.0
    target: str | None = None

    def expression(self) -> Column:
        total = F.lit(float(self.intercept))
        for c, w in self.terms.items():
            total = total + F.lit(float(w)) * F.col(q(c)).cast("double")
        return total

    def predict(self, part: Series) -> DataFrame:
        label = F.col(q(self.target)).cast("double") if self.target else F.lit(None).cast("double")
        return part.df.select(ORD, part.ts, label.alias("label"), self.expression().alias("prediction"))

    def predict_grid(self, part: Series, feature: str, grid: list[float], only: DataFrame | None = None) -> DataFrame:
        at = F.explode(F.array(*[F.lit(float(v)) for v in grid]))
        moved = listed(part.df, only).withColumn("grid", at).withColumn(feature, F.col("grid"))
        return moved.select(ORD, part.ts, "grid", self.expression().alias("prediction"))


@dataclass(frozen=True)
class TreeFormula:
    """A tree given by its splits over raw columns: a node is an answer, or
    (column, threshold, node where column <= threshold, node elsewhere)."""

    root: tuple | float
    target: str | None = None

    def columns(self) -> list[str]:
        def walk(node):
            return {node[0], *walk(node[2]), *walk(node[3])} if isinstance(node, tuple) else set()

        return sorted(walk(self.root))

    def nodes(self) -> dict[int, tuple]:
        """{id: (left, right, place of the column, threshold, answer)}, the root 0."""
        names, out = self.columns(), {}

        def number(node) -> int:
            at = len(out)
            out[at] = (-1, -1, -1, float("nan"), node)
            if isinstance(node, tuple):
                out[at] = (number(node[2]), number(node[3]), names.index(node[0]), float(node[1]), None)
            return at

        number(self.root)
        return out

    def expression(self) -> Column:
        def case(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            return F.when(F.col(q(node[0])).cast("double") <= F.lit(float(node[1])), case(node[2])).otherwise(case(node[3]))

        return case(self.root)

    def predict(self, part: Series) -> DataFrame:
        label = F.col(q(self.target)).cast("double") if self.target else F.lit(None).cast("double")
        return part.df.select(ORD, part.ts, label.alias("label"), self.expression().alias("prediction"))
