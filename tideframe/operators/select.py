"""Feature selection: variance, correlation, mutual information; and its review."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.functions.names import numeric_columns, q
from tideframe.functions.stats import bucketed, clean_double, exact_quantiles
from tideframe.operators import gram
from tideframe.operators.axis import ORD
from tideframe.operators.features import Origin, ledger_frame

MI_BINS = 16
MIN_MI_ROWS = 10
MIN_VARIANCE = 1e-12
CORR_LIMIT = 0.98

REPORT_SCHEMA = ("position int, feature string, variance double, missing_ratio double, mutual_info double, "
                 "kept boolean, status string, reason string")


@dataclass
class Selection:
    names: list[str]
    report: DataFrame


def spread(df: DataFrame, cols: list[str]) -> dict[str, tuple[float | None, float]]:
    """Population variance and missing share per column, one pass."""
    return _spread(gram.centres(df, cols))


def _spread(info: dict[str, gram.ColumnSummary]) -> dict[str, tuple[float | None, float]]:
    return {c: (s.variance, s.nulls / s.rows if s.rows else 0.0) for c, s in info.items()}


def correlated_away(matrix: np.ndarray, threshold: float) -> dict[int, int]:
    """{dropped: kept}: in column order a column drops later ones it correlates with."""
    gone: dict[int, int] = {}
    strong = np.abs(np.nan_to_num(matrix, nan=0.0)) >= threshold
    for i in range(len(matrix)):
        if i not in gone:
            gone.update({j: i for j in np.flatnonzero(strong[i]) if j > i and j not in gone})
    return {int(j): i for j, i in gone.items()}


def mutual_information(df: DataFrame, cols: list[str], target: str, task: str = "regression",
                       bins: int = MI_BINS) -> DataFrame:
    """(feature, mutual_info): binned estimate, in nats.

    Values are cut at quantiles, NULL features count as 0 and rows without a
    target are left out. The shuffle carries at most bins x bins cells a column.
    """
    known = df.where(F.col(q(target)).isNotNull())
    probs = [i / bins for i in range(1, bins)]
    xs = {c: F.coalesce(clean_double(F.col(q(c))), F.lit(0.0)) for c in cols}
    want = dict(xs)
    if task == "regression":
        want["__y"] = clean_double(F.col(q(target)))
    cuts = {k: sorted({v for v in vs if v is not None}) for k, vs in exact_quantiles(known, want, probs).items()}
    values = known.select(*[e.alias(f"v{i}") for i, e in enumerate(want.values())],
                          *([] if task == "regression" else [F.col(q(target)).alias("_y")]))
    at = {f"v{i}": cuts[k] for i, k in enumerate(want)}
    cut = bucketed(values, at, {v: f"b{v}" for v in at})
    names = list(want)
    binned = cut.select(*([F.col(f"bv{names.index('__y')}").cast("int").alias("_y")] if task == "regression" else ["_y"]),
                        *[F.col(f"bv{i}").cast("int").alias(c) for i, c in enumerate(names) if c != "__y"])
    if task == "regression":
        binned = binned.where(F.col("_y") <= len(cuts["__y"]))
    cells = binned.unpivot(["_y"], list(cols), "feature", "_x").groupBy("feature", "_x", "_y") \
                  .agg(F.count(F.lit(1)).alias("n"))
    return mi_from_cells(cells)


def mi_from_cells(cells: DataFrame) -> DataFrame:
    """Sum of p log(p / (px py)) from (feature, _x, _y, n) counts."""
    def total(*keys: str) -> Column:        # a feature has at most bins x bins cells
        return F.sum("n").over(Window.partitionBy("feature", *keys))

    n = F.col("n")
    term = n / total() * F.log(n * total() / (total("_x") * total("_y")))
    return cells.select("feature", term.alias("term")).groupBy("feature").agg(
        F.greatest(F.sum("term"), F.lit(0.0)).alias("mutual_info"))


def select_features(df: DataFrame, cols: list[str] | None, target: str, task: str = "regression",
                    top_k: int | None = None, corr_threshold: float = CORR_LIMIT,
                    min_variance: float = MIN_VARIANCE, compute_mi: bool = True,
                    null_mode: str = "strict", bins: int = MI_BINS) -> Selection:
    """Variance, then correlation, then the mutual-information cut.

    ``df`` must hold training rows only. ``strict`` leaves columns with NULLs
    out of the correlation step, ``pairwise`` uses the rows both know.
    """
    names = cols if cols is not None else numeric_columns(df, ("ts", ORD, target))
    info = gram.centres(df, names)
    stats = _spread(info)
    reason, status = {}, {c: "selected" for c in names}
    alive = []
    for c in names:
        v = stats[c][0]
        if v is not None and v > min_variance:
            alive.append(c)
        else:
            status[c] = "removed"
            reason[c] = f"variance {'none' if v is None else format(v, '.3g')} <= {min_variance:g}"
    matrix = gram.correlation_matrix(df, alive, null_mode, info) if len(alive) > 1 else np.ones((len(alive),) * 2)
    for j, i in correlated_away(matrix, corr_threshold).items():
        status[alive[j]] = "removed"
        reason[alive[j]] = f"|corr| >= {corr_threshold:g} with {alive[i]}"
    alive = [c for c in alive if status[c] == "selected"]

    mi: dict[str, float] = {}
    if compute_mi and alive and df.where(F.col(q(target)).isNotNull()).count() > MIN_MI_ROWS:
        mi = {r["feature"]: r["mutual_info"] for r in mutual_information(df, alive, target, task, bins).collect()}
    ranked = sorted(alive, key=lambda c: -mi.get(c, float("-inf")))
    if top_k and len(alive) > top_k:
        for i, c in enumerate(ranked[top_k:], top_k + 1):
            status[c], reason[c] = "removed", f"mutual information rank {i}, over {top_k}"
        ranked = ranked[:top_k]
        alive = [c for c in alive if status[c] == "selected"]
    for i, c in enumerate(ranked, 1):
        reason[c] = f"mutual information rank {i}" if compute_mi else "passed variance and correlation"
    rows = [(i, c, stats[c][0], stats[c][1], mi.get(c), status[c] == "selected", status[c], reason[c])
            for i, c in enumerate(names)]
    return Selection(alive, df.sparkSession.createDataFrame(rows, REPORT_SCHEMA).orderBy("position"))


def jaccard_stability(spark, fold_sets: list[set[str]]) -> DataFrame:
    """Overlap of the selected sets of every two folds."""
    rows = [(i, f) for i, s in enumerate(fold_sets, 1) for f in sorted(s)]
    picked = spark.createDataFrame(rows, "fold int, feature string")
    return jaccard(picked)


def jaccard(picked: DataFrame) -> DataFrame:
    """Same from a (fold, feature) table."""
    size = picked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    a, b = size.select(F.col("fold").alias("fold_a"), F.col("n").alias("n_a")), \
        size.select(F.col("fold").alias("fold_b"), F.col("n").alias("n_b"))
    both = picked.select(F.col("fold").alias("fold_a"), "feature") \
        .join(picked.select(F.col("fold").alias("fold_b"), "feature"), "feature") \
        .where("fold_a < fold_b").groupBy("fold_a", "fold_b").agg(F.count(F.lit(1)).alias("common"))
    pairs = a.join(b, F.col("fold_a") < F.col("fold_b")).join(both, ["fold_a", "fold_b"], "left")
    common = F.coalesce("common", F.lit(0))
    union = F.col("n_a") + F.col("n_b") - common
    return pairs.select("fold_a", "fold_b", F.bround(common / union, 4).alias("jaccard"), "n_a", "n_b",
                        common.alias("common")).orderBy("fold_a", "fold_b")


def feature_report(report: DataFrame, ledger: list[Origin] | DataFrame | None = None,
                   train: DataFrame | None = None) -> DataFrame:
    """Report with origins, MI rank, and statistics of the training rows only."""
    spark = report.sparkSession
    out = report
    if ledger is not None:
        prov = ledger if isinstance(ledger, DataFrame) else ledger_frame(spark, ledger)
        out = out.join(F.broadcast(prov), "feature", "left")
        out = out.withColumns({"transform": F.coalesce("transform", F.lit("raw")),
                               "lookback": F.coalesce("lookback", F.lit(0))})
    mi = out.select("feature", "mutual_info")
    ahead = mi.alias("a").join(mi.alias("b"), F.col("b.mutual_info") > F.col("a.mutual_info"), "left") \
        .where(F.col("a.mutual_info").isNotNull()) \
        .groupBy(F.col("a.feature").alias("feature")).agg((F.count("b.mutual_info") + 1).alias("mi_rank"))
    out = out.join(ahead, "feature", "left")
    if train is not None:
        cols = [r["feature"] for r in report.select("feature").collect() if r["feature"] in train.columns]
        out = out.join(train_stats(train, cols), "feature", "left")
    return out


def train_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = clean_double(F.col(q(c)))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"), F.count(x).alias(f"k{i}")]
    r = train.agg(*aggs).first()
    rows = [(c, r[f"m{i}"], r[f"s{i}"], 1 - r[f"k{i}"] / r["rows"] if r["rows"] else None)
            for i, c in enumerate(cols)]
    return train.sparkSession.createDataFrame(
        rows, "feature string, train_mean double, train_std double, train_missing double")


def origin_rollup(report: DataFrame) -> DataFrame:
    """Per origin (several joined by |): made, selected, best MI, share selected."""
    origin = F.array_join(F.col("origins"), "|")
    return (report.groupBy(origin.alias("origin"))
            .agg(F.count(F.lit(1)).alias("made"), F.count_if(F.col("kept")).alias("selected"),
                 F.max("mutual_info").alias("best_mi"))
            .withColumn("rate", F.bround(F.col("selected") / F.col("made"), 3))
            .orderBy(F.desc_nulls_last("best_mi"), "origin"))


def apply_manual_selection(report: DataFrame, chosen: list[str]) -> Selection:
    """The user's picks over the automatic ones, with what changed kept on record."""
    picked = F.col("feature").isin(list(chosen))
    added, dropped = picked & ~F.col("kept"), ~picked & F.col("kept")
    out = report.withColumns({
        "status": F.when(added, "selected(manual)").when(dropped, "removed(manual)").otherwise(F.col("status")),
        "reason": F.when(added, F.concat(F.lit("added by hand; before: "), F.col("reason")))
                   .when(dropped, F.concat(F.lit("removed by hand; before: "), F.col("reason")))
                   .otherwise(F.col("reason")),
        "kept": picked})
    return Selection(sorted(set(chosen)), out)


def selection_risks(report: DataFrame, chosen: list[str], train: DataFrame | None = None,
                    corr_threshold: float = CORR_LIMIT, min_mi: float = 1e-6, max_missing: float = 0.3) -> DataFrame:
    """(feature, risk, value): warnings only."""
    picked = report.where(F.col("feature").isin(list(chosen)))
    rules = {"no information": (F.col("mutual_info"), F.col("mutual_info") <= min_mi),
             "no variance": (F.col("variance"), F.col("variance") <= MIN_VARIANCE),
             "mostly missing": (F.col("missing_ratio"), F.col("missing_ratio") > max_missing)}
    out = None
    for name, (value, cond) in rules.items():
        part = picked.where(cond).select("feature", F.lit(name).alias("risk"), value.alias("value"))
        out = part if out is None else out.unionByName(part)
    cols = [c for c in chosen if train is not None and c in numeric_columns(train)]
    if len(cols) >= 2:
        from tideframe.operators.quality import correlated_pairs
        pairs = correlated_pairs(train, cols, corr_threshold)
        out = out.unionByName(pairs.select(F.concat_ws(" + ", "feature_a", "feature_b").alias("feature"),
                                           F.lit("duplicate").alias("risk"), F.col("corr").alias("value")))
    return out
