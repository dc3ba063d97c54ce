"""Unsupervised views: clusters and their quality, anomalies, components."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import numeric_columns, q
from tideframe.functions.stats import clean_double, exact_quantiles
from tideframe.operators import axis, linkage, neighbours, prep as P, tiles
from tideframe.operators.axis import ORD, Series

TREE_ROWS = 256
EULER = 0.5772156649015329


@dataclass(frozen=True)
class UnsupervisedConfig:
    k_range: tuple[int, int] = (2, 8)
    contamination: float = 0.01
    n_components: int = 3
    seed: int = 42
    selected: tuple[str, ...] = ()
    eps: float = 0.8
    min_samples: int = 10
    n_trees: int = 300
    n_neighbors: int = 35

    def wants(self, name: str) -> bool:
        return not self.selected or name in self.selected


def matrix(series: Series, features: list[str], cfg: P.PreprocessConfig | None = None) -> tuple[DataFrame, list[str]]:
    """(ord, features) after preprocessing, and the names of the vector's entries."""
    numeric, categorical = P.column_types(series, features)
    fitted = P.fit(series, numeric, categorical, cfg)
    ready = fitted.transform(series, [ORD])
    names = fitted.output_columns
    packed = VectorAssembler(inputCols=names, outputCol="features").transform(ready)
    return staging.store(packed.select(ORD, "features"), "matrix"), names


# --- clusters -------------------------------------------------------------------

PARTITIONS = {
    "KMeans": lambda k, seed: KMeans(k=k, seed=seed, predictionCol="cluster"),
    "GaussianMixture": lambda k, seed: GaussianMixture(k=k, seed=seed, predictionCol="cluster"),
    "BisectingKMeans": lambda k, seed: BisectingKMeans(k=k, seed=seed, predictionCol="cluster"),
}


MEASURES = ("n_clusters", "noise_ratio", "silhouette", "davies_bouldin", "calinski_harabasz")
CENTRE_SENT = 2_000_000         # numbers in centres that may be broadcast: 16 MB
CENTRE_CELLS: int | None = None     # a caller's own bound on them, beyond which the silhouette is left out; none unless set
CENTRE_BLOCK = 512
SALTS = 64


def _with_centres(rows: DataFrame, centres: DataFrame, small: bool) -> DataFrame:
    """Rows (cluster, v) with their cluster's centre: sent to every task while these are few, else
    met on salted keys, so that no cluster is one task."""
    if small:
        return rows.join(F.broadcast(centres), "cluster")
    salted = centres.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["cluster", "_salt"])


def _worst_neighbours(spread: DataFrame, clusters: int) -> DataFrame:
    """(cluster, worst): the greatest (s + s') / distance to another centre. Blocks of centres meet
    blocks of centres, and a block returns one number per centre."""
    blocks = -(-clusters // CENTRE_BLOCK)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    own = F.pmod(F.xxhash64("cluster"), F.lit(blocks)).cast("int")
    base = spread.select("cluster", "centre", "s", own.alias("own"))
    left = base.withColumn("other", every)
    right = base.withColumnRenamed("own", "other").withColumn("own", every)

    def worst(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"cluster": [], "worst": []})
        x, y = np.stack(mine["centre"].to_numpy()), np.stack(theirs["centre"].to_numpy())
        apart = np.stack([np.sqrt(((y - one) ** 2).sum(1)) for one in x])
        apart[mine["cluster"].to_numpy()[:, None] == theirs["cluster"].to_numpy()[None]] = np.inf
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = (mine["s"].to_numpy()[:, None] + theirs["s"].to_numpy()[None]) / apart
        return pd.DataFrame({"cluster": mine["cluster"], "worst": np.nan_to_num(ratio, nan=0.0, posinf=np.inf).max(1)})

    return left.groupBy("own", "other").cogroup(right.groupBy("own", "other")) \
        .applyInPandas(worst, "cluster bigint, worst double").groupBy("cluster").agg(F.max("worst").alias("worst"))


def _silhouette(placed: DataFrame, spread: DataFrame, clusters: int) -> float:
    """The mean squared-Euclidean silhouette of rows (cluster, v, sq), with no centres sent to tasks.

    A row's mean squared distance to a cluster is that to its centre and the cluster's variance: the
    squared distance to the centre lengthened by the standard deviation. So the nearest other cluster
    is the nearer of a row's two nearest among these, or the one left without its own.
    """
    around = F.sqrt(F.col("sq") / F.col("n"))
    points = neighbours.merged(spread.select(F.concat("centre", F.array(around)).alias("vec"), "cluster"),
                               {"low": F.min("cluster"), "high": F.max("cluster")})
    base, cells = neighbours.build_cells(points)
    rows = placed.select("cluster", "sq", F.concat("v", F.array(F.lit(0.0))).alias("vec"))
    asked = neighbours.merged(rows.select("vec"), {})
    near = neighbours.knn(asked, base, cells, 2, {"low": "bigint", "high": "bigint"}) \
        .groupBy("pid").agg(F.collect_list(F.struct("dist", "low", "high")).alias("near"))
    answers = staging.store(asked.join(near, "pid").select("vec", "weight", "near"), "near_centres")
    other = F.filter("near", lambda c: (c["low"] != F.col("cluster")) | (c["high"] != F.col("cluster")))
    met = neighbours.matched(rows, answers, ["near"]) \
        .select("cluster", "sq", F.col("vec").alias("v"), F.pow(F.array_min(F.transform(other, lambda c: c["dist"])), 2).alias("b"))
    sums = spread.select("cluster", "n", F.col("sq").alias("all"))
    a = (F.col("sq") + F.col("all") / F.col("n")) * F.col("n") / (F.col("n") - 1)
    s = F.when((F.col("n") == 1) | (F.col("a") == F.col("b")), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return _with_centres(met, sums, clusters <= neighbours.FEW).withColumn("a", F.when(F.col("n") > 1, a)).agg(F.avg(s)).first()[0]


def cluster_metrics(df: DataFrame) -> dict[str, float | None]:
    """Quality of (features, cluster); noise (-1) is left out. No sampling.

    Davies-Bouldin and Calinski-Harabasz need the centres and two sums per cluster, which stay a
    table; the driver sees their totals alone. Fewer than two clusters or ten rows have no quality,
    and two clusters of one centre have a Davies-Bouldin of infinity (0 when both are points). The
    silhouette is the squared-Euclidean one, for which Spark sends all centres to every task; when
    these are more than CENTRE_SENT numbers, rows meet them as nearest neighbours, to the same value.
    """
    v = vector_to_array("features").alias("v")
    shape = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("cluster") >= 0).alias("n"),
                   F.max(F.size(vector_to_array("features"))).alias("d")).first()
    kept = df.where("cluster >= 0")
    centres = staging.store(kept.groupBy(F.col("cluster").cast("long").alias("cluster")).agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("centre"), F.count(F.lit(1)).alias("n")), "centres")
    k, n = centres.count(), shape["n"]
    out: dict[str, float | None] = dict.fromkeys(MEASURES) | {
        "n_clusters": k, "noise_ratio": (shape["rows"] - n) / shape["rows"] if shape["rows"] else 0.0}
    if k < 2 or n < 10:
        return out
    cells = k * shape["d"]
    asked = CENTRE_CELLS is None or cells <= CENTRE_CELLS
    small = asked and cells <= CENTRE_SENT

    def squares(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x)

    placed = _with_centres(kept.select(F.col("cluster").cast("long").alias("cluster"), v), centres, small) \
        .select("cluster", "v", squares("v", "centre").alias("sq"))
    if asked and not small:
        placed = staging.store(placed, "placed")        # read again for the silhouette
    reach = placed.groupBy("cluster").agg(F.avg(F.sqrt("sq")).alias("s"), F.sum("sq").alias("sq"))
    spread = staging.store(centres.join(reach, "cluster"), "spread")
    overall = np.array([r["m"] for r in spread.select(F.posexplode("centre").alias("i", "x"), "n").groupBy("i")
                        .agg((F.sum(F.col("x") * F.col("n")) / n).alias("m")).orderBy("i").collect()])   # one row per dimension
    middle = F.array(*[F.lit(float(x)) for x in overall])
    total = spread.withColumn("_m", middle).agg(F.sum(F.col("n") * squares("centre", "_m")).alias("between"),
                                                F.sum("sq").alias("within")).first()
    out["davies_bouldin"] = _worst_neighbours(spread, k).agg(F.avg("worst")).first()[0]
    out["calinski_harabasz"] = total["between"] * (n - k) / (total["within"] * (k - 1)) if total["within"] > 0 else 1.0
    if asked:
        out["silhouette"] = float(ClusteringEvaluator(predictionCol="cluster").evaluate(kept)) if small else _silhouette(placed, spread, k)
    return out


def _attempt(make):
    """(result, "ok"), or (None, the error)."""
    try:
        return make(), "ok"
    except Exception as e:  # noqa: BLE001 - one method's failure must not stop the rest
        return None, f"failed: {type(e).__name__}: {str(e)[:200]}"


def run_clustering(vectors: DataFrame, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(board, labels per key): every partition for every k, DBSCAN once. Single linkage
    merges once and is cut at every k. What fails is on the board with its error, and
    the others go on."""
    spark = vectors.sparkSession
    sizes = range(cfg.k_range[0], cfg.k_range[1] + 1)

    def partition(make, k: int) -> DataFrame:
        return make(k, cfg.seed).fit(vectors).transform(vectors).select(ORD, "features", "cluster")

    runs = [(f"{name}_k{k}", name, k, functools.partial(partition, make, k))
            for k in sizes for name, make in PARTITIONS.items() if cfg.wants(name)]
    if cfg.wants("Agglomerative"):
        levels = functools.cache(lambda: linkage.cut(linkage.merges(vectors, cfg.seed), list(sizes)))
        runs += [(f"Agglomerative_k{k}", "Agglomerative", k, lambda k=k: levels()[k]) for k in sizes]
    if cfg.wants("DBSCAN"):
        runs.append(("DBSCAN", "DBSCAN", None, lambda: dbscan(vectors, cfg.eps, cfg.min_samples, cfg.seed)))
    filled, labels = [], {}
    for key, name, k, make in runs:
        found, status = _attempt(lambda: staging.store(make(), "clusters"))
        m, status = _attempt(lambda: cluster_metrics(found)) if found is not None else (None, status)
        if m:
            labels[key] = found
        filled.append((key, name, k, status, *[m[x] if m else None for x in MEASURES]))
    board = spark.createDataFrame(filled, "key string, model string, k int, status string, n_clusters int, "
                                          "noise_ratio double, silhouette double, davies_bouldin double, "
                                          "calinski_harabasz double")
    return board.orderBy(F.desc_nulls_last("silhouette"), "key"), labels


def _within(eps: float, value: str):
    """Per query: a summary of the base points at most eps away."""
    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": [], value: []})
        near = neighbours._distances(neighbours._matrix(left["vec"]), neighbours._matrix(right["vec"])) <= eps
        if value == "weight":
            got = near @ right["weight"].to_numpy(dtype=float)
            return pd.DataFrame({"pid": left["pid"].to_numpy(), value: got})
        label = right["label"].to_numpy()
        top = np.iinfo(np.int64).max
        got = np.where(near, label[None, :], top).min(1)
        hit = got < top
        return pd.DataFrame({"pid": left["pid"].to_numpy()[hit], value: got[hit]})
    return fold


def _dense_parts(points: DataFrame, eps: float, min_samples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same as ``_cell_parts`` for long vectors, in tiles: a query that has neighbours enough is
    not asked further, and core points of one label are not compared."""
    counted = tiles.met(points, points, tiles.Counted(eps, min_samples), "pid bigint, weight double", ("weight", "weight"))
    core = staging.store(counted.groupBy("pid").agg(F.sum("weight").alias("near")).where(F.col("near") >= min_samples).select("pid"), "core")
    inner = staging.store(points.join(core, "pid"), "inner")
    parts = linkage.linked(inner, eps).join(inner.select("pid", "least"), "pid")
    least = parts.groupBy("label").agg(F.min("least").alias("least"))
    labels = staging.store(parts.select("pid", "label").join(least, "label").select("pid", F.col("least").alias("label")), "labels")
    outer = points.join(core, "pid", "left_anti")
    found = tiles.met(outer, inner.join(labels, "pid"), tiles.LeastLabel(eps), "pid bigint, label bigint", ("weight", "label"))
    return labels, found.groupBy("pid").agg(F.min("label").alias("label"))


def _cell_parts(points: DataFrame, eps: float, min_samples: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(pid, label) of the core points, and of the border points."""
    base, cells = neighbours.build_cells(points, seed)
    asked = points.select("pid", "vec")
    visits = neighbours.visit(asked.withColumn("eps", F.lit(eps)), cells, "eps")
    counted = neighbours.in_blocks(visits, asked, base, cells, _within(eps, "weight"), "pid bigint, weight double")
    core = staging.store(counted.groupBy("pid").agg(F.sum("weight").alias("near"))
                         .where(F.col("near") >= min_samples).select("pid"), "core")
    labels = core.join(points.select("pid", F.col("least").alias("label")), "pid")
    core_visits = staging.store(visits.join(core, "pid"), "visits")
    while True:
        labelled = base.join(labels, "pid")
        best = neighbours.in_blocks(core_visits, asked, labelled, cells, _within(eps, "label"), "pid bigint, label bigint") \
                         .groupBy("pid").agg(F.min("label").alias("least"))
        hooks = staging.store(labels.join(best, "pid").groupBy("label").agg(F.min("least").alias("parent")), "hooks")
        if not hooks.where("parent < label").limit(1).count():
            break
        while True:
            up = hooks.select(F.col("label").alias("parent"), F.col("parent").alias("above"))
            jumped = staging.store(hooks.join(up, "parent").select("label", F.col("above").alias("parent")), "hooks")
            moved = jumped.join(hooks.withColumnRenamed("parent", "before"), "label").where("parent < before")
            hooks = jumped
            if not moved.limit(1).count():
                break
        labels = staging.store(labels.join(hooks, "label").select("pid", F.col("parent").alias("label")), "labels")
    border = visits.join(core, "pid", "left_anti")
    joined = neighbours.in_blocks(border, asked, base.join(labels, "pid"), cells, _within(eps, "label"),
                                  "pid bigint, label bigint").groupBy("pid").agg(F.min("label").alias("label"))
    return labels, joined


def dbscan(vectors: DataFrame, eps: float = 0.8, min_samples: int = 10, seed: int = 42) -> DataFrame:
    """(ord, features, cluster), noise -1.

    Neighbour pairs are never listed: a pass counts neighbours per point, later
    passes return the least label among core neighbours. Labels that touch are
    joined by following parents, so clusters merge in few rounds whatever their
    extent. A cluster's label is the least ordinal of its core points, and a border
    point joins the reachable cluster with the least label.
    """
    rows = vectors.select(ORD, "features", vector_to_array("features").alias("vec"))
    points = neighbours.merged(rows, {"least": F.min(ORD)})
    labels, joined = (_dense_parts if tiles.dense(points) else _cell_parts)(points, float(eps), min_samples, seed)
    every = labels.unionByName(joined)
    labelled = staging.store(points.join(every, "pid", "left").select("vec", "weight", "label"), "labels")
    tagged = staging.store(neighbours.matched(rows, labelled, ["label"]).drop("vec"), "dbscan")
    first = tagged.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(ORD).alias("_first"))
    numbered = axis.ordinal(first, ["_first"], name="cluster").df.select("label", F.col("cluster").cast("int"))
    out = tagged.join(numbered, "label", "left")
    return staging.store(out.select(ORD, "features", F.coalesce("cluster", F.lit(-1)).alias("cluster")), "dbscan")


def cluster_profile(df: DataFrame, cols: list[str] | None = None, cluster: str = "cluster") -> DataFrame:
    """(feature, cluster, cluster_mean, overall_mean, rows)."""
    cols = cols or [c for c in numeric_columns(df, (ORD, "ts")) if c != cluster]
    tall = df.select(F.col(q(cluster)).alias("cluster"), *[clean_double(F.col(q(c))).alias(c) for c in cols]) \
             .unpivot(["cluster"], list(cols), "feature", "value")
    per = tall.groupBy("feature", "cluster").agg(F.avg("value").alias("cluster_mean"), F.sum("value").alias("_s"),
                                                 F.count("value").alias("rows"))
    whole = per.groupBy("feature").agg((F.sum("_s") / F.sum("rows")).alias("overall_mean"))
    return per.drop("_s").join(whole, "feature").orderBy("feature", "cluster")


def profile_wide(profile: DataFrame, clusters: list[int]) -> DataFrame:
    """Features as rows: overall mean, then one column per cluster."""
    wide = profile.groupBy("feature", "overall_mean").pivot("cluster", list(clusters)).agg(F.first("cluster_mean"))
    return wide.select("feature", "overall_mean", *[F.col(str(c)).alias(f"cluster_{c}") for c in clusters])


# --- anomalies --------------------------------------------------------------------

def _unsuccessful(n):
    """Mean path of a failed search in a binary tree of n rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long = 2 * (np.log(n - 1) + EULER) - 2 * (n - 1) / n
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, depth: int, rng) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length added at a leaf)."""
    nodes: list = []

    def place(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        part = x[rows]
        varying = np.flatnonzero(part.max(0) > part.min(0)) if len(rows) > 1 else []
        if level >= depth or not len(varying):
            nodes[at] = (-1, 0.0, -1, -1, level + float(_unsuccessful(len(rows))))
            return at
        f = int(rng.choice(varying))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        under = part[:, f] <= cut
        left = place(rows[under], level + 1)
        nodes[at] = (f, cut, left, place(rows[~under], level + 1), 0.0)
        return at

    place(np.arange(len(x)), 0)
    return nodes


def isolation_forest(vectors: DataFrame, n: int, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> DataFrame:
    """(ord, anomaly_score, is_anomaly): lower scores are stranger.

    Trees are grown in parallel, each from its own 256 rows; the forest (at most
    n_trees x 511 nodes) then travels to the data.
    """
    size = min(TREE_ROWS, n)
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    rng = np.random.default_rng(cfg.seed)
    picks = pd.DataFrame([(t, int(o)) for t in range(cfg.n_trees) for o in rng.choice(n, size, replace=False)],
                         columns=["tree", ORD])                  # n_trees x 256 row numbers
    spark = vectors.sparkSession
    sample = vectors.select(ORD, vector_to_array("features").alias("v")) \
                    .join(F.broadcast(spark.createDataFrame(picks, f"tree int, {ORD} bigint")), ORD)
    seed = cfg.seed

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values(ORD)
        nodes = _grow(np.stack(pdf["v"].to_numpy()), depth, np.random.default_rng([seed, t]))
        f, cut, left, right, path = (list(c) for c in zip(*nodes))
        return pd.DataFrame({"tree": [t], "f": [f], "cut": [cut], "left": [left], "right": [right], "path": [path]})

    grown = sample.groupBy("tree").applyInPandas(
        grow, "tree int, f array<int>, cut array<double>, left array<int>, right array<int>, path array<double>")
    trees = [tuple(np.array(r[c]) for c in ("f", "cut", "left", "right", "path"))
             for r in grown.orderBy("tree").collect()]
    forest = spark.sparkContext.broadcast(trees)
    norm = float(_unsuccessful(size)) or 1.0

    def strange(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["v"].to_numpy())
            each = np.arange(len(x))
            total = np.zeros(len(x))
            for f, cut, left, right, path in forest.value:
                at = np.zeros(len(x), dtype=int)
                while (f[at] >= 0).any():
                    inner = f[at] >= 0
                    go_left = x[each, np.maximum(f[at], 0)] <= cut[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                total += path[at]
            yield pd.DataFrame({ORD: pdf[ORD], "anomaly_score": -np.power(2.0, -(total / len(forest.value)) / norm)})

    scored = vectors.select(ORD, vector_to_array("features").alias("v")) \
                    .mapInPandas(strange, f"{ORD} bigint, anomaly_score double")
    return _flagged(staging.store(scored, "isolation"), cfg.contamination)


def _flagged(scored: DataFrame, contamination: float) -> DataFrame:
    cut = exact_quantiles(scored, {"s": F.col("anomaly_score")}, [contamination])["s"][0]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(cut))


def local_outlier_factor(vectors: DataFrame, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> DataFrame:
    """(ord, anomaly_score, is_anomaly): the negative local outlier factor.

    Neighbours come from the exact cell join; reach distance, local density and
    the factor are three aggregations over at most k rows per point.
    """
    rows = vectors.select(ORD, vector_to_array("features").alias("vec"))
    points = neighbours.merged(rows, {})
    total = points.agg(F.sum("weight")).first()[0] or 0
    k = int(max(1, min(cfg.n_neighbors, total - 1)))
    base, cells = neighbours.build_cells(points, cfg.seed)
    near = neighbours.knn(points.select("pid", "vec"), base, cells, k, {}, skip_self=True)
    used = F.least(F.col("weight"), F.lit(float(k)) - F.col("before"))
    near = staging.store(near.withColumn("w", used).select("pid", "near", "dist", "w"), "lof")
    reach = near.groupBy("pid").agg(F.max("dist").alias("kdist"))
    far = reach.select(F.col("pid").alias("near"), "kdist")
    density = staging.store(
        near.join(far, "near").groupBy("pid").agg(
            (F.sum("w") / (F.sum(F.greatest("dist", "kdist") * F.col("w")) + F.lit(1e-10) * F.sum("w"))).alias("lrd")), "lof")
    other = density.select(F.col("pid").alias("near"), F.col("lrd").alias("near_lrd"))
    factor = near.join(other, "near").groupBy("pid").agg((F.sum(F.col("near_lrd") * F.col("w")) / F.sum("w")).alias("m")) \
                 .join(density, "pid").select("pid", (-F.col("m") / F.col("lrd")).alias("anomaly_score"))
    factors = staging.store(points.join(factor, "pid").select("vec", "weight", "anomaly_score"), "lof")
    scored = neighbours.matched(rows, factors, ["anomaly_score"]).select(ORD, "anomaly_score")
    return _flagged(staging.store(scored, "lof"), cfg.contamination)


def run_anomaly(vectors: DataFrame, n: int, cfg: UnsupervisedConfig = UnsupervisedConfig()) -> tuple[DataFrame, dict[str, DataFrame]]:
    ways = {"IsolationForest": lambda: isolation_forest(vectors, n, cfg),
            "LocalOutlierFactor": lambda: local_outlier_factor(vectors, cfg)}
    rows, made = [], {}
    for name, make in ways.items():
        if not cfg.wants(name):
            continue
        t, status = _attempt(make)
        if t is None:
            rows.append((name, status, None, None, None, None))
            continue
        made[name] = t
        r = t.agg(F.count_if("is_anomaly"), F.avg(F.col("is_anomaly").cast("double")), F.min("anomaly_score")).first()
        mid = exact_quantiles(t, {"s": F.col("anomaly_score")}, [0.5])["s"][0]
        rows.append((name, "ok", r[0], round(r[1], 4), r[2], mid))
    board = vectors.sparkSession.createDataFrame(
        rows, "model string, status string, n_anomaly bigint, anomaly_ratio double, score_min double, score_median double")
    return board, made


# --- components ---------------------------------------------------------------------

@dataclass
class Components:
    scores: DataFrame
    loadings: DataFrame
    explained: DataFrame


def run_pca(vectors: DataFrame, names: list[str], cfg: UnsupervisedConfig = UnsupervisedConfig()) -> Components:
    """Scores, loadings and explained shares; each component's largest loading is positive."""
    k = min(cfg.n_components, len(names))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="centred") \
        .fit(vectors).transform(vectors)
    model = PCA(k=k, inputCol="centred", outputCol="pc").fit(centred)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    spark = vectors.sparkSession
    out = model.transform(centred).withColumn("_a", vector_to_array("pc"))
    scored = out.select(ORD, *[(F.col("_a")[i] * F.lit(float(sign[i]))).alias(f"PC{i + 1}") for i in range(k)])
    loadings = spark.createDataFrame([(c, *[float(v) for v in load[i] * sign]) for i, c in enumerate(names)],
                                     "feature string, " + ", ".join(f"PC{i + 1} double" for i in range(k)))
    ratio = model.explainedVariance.toArray()
    explained = spark.createDataFrame([(f"PC{i + 1}", float(r), float(ratio[:i + 1].sum())) for i, r in enumerate(ratio)],
                                      "component string, ratio double, cumulative double")
    return Components(scored, loadings, explained)
