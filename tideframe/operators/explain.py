"""Contributions of features to predictions, kept as one long table.

Columns: ord, ts, feature, feature_value, shap_value. The base value stands
beside it. Every view below is a query on that table; nothing is recomputed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.operators import blend as B, boxes, models as M, quantiles, scores, split as SP, timeaxis
from tideframe.operators.axis import ORD, Series

ZERO_WEIGHT = 1e-9


@dataclass(frozen=True)
class ShapConfig:
    """``background`` rows stand for an absent feature: that many drawn ones, or the first so
    many by ordinal that meet ``among``. ``rows`` is a condition for the rows to explain, all of
    them without one. ``target`` is the class to explain, without it the second of two and
    the first of more. Sampled walks cost background x features per row."""

    background: int = 200
    rows: Column | None = None
    seed: int = 42
    among: Column | None = None
    target: object = None


@dataclass(frozen=True)
class Contributions:
    table: DataFrame
    base_value: float
    method: str
    ts: str = "ts"
    space: str = "prediction"

    def with_table(self, table: DataFrame) -> "Contributions":
        return replace(self, table=table)


def method(pipe) -> str:
    if isinstance(pipe, B.Blend):
        return "blend"
    if isinstance(pipe, M.LinearFormula) or not isinstance(pipe, M.TreeFormula) and pipe.linear_terms() is not None:
        return "linear"
    return "tree" if isinstance(pipe, M.TreeFormula) or boxes.has_trees(pipe.model) else "sampled"


def linear_table(df: DataFrame, terms: dict[str, float], means: dict[str, float], ts: str) -> DataFrame:
    """coef x (value - mean), one row per row and feature."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(q(c)).cast("double").alias("feature_value"),
                               (F.lit(float(w)) * (F.col(q(c)).cast("double") - F.lit(float(means[c])))).alias("shap_value"))
                      for c, w in terms.items()])
    return df.select(ORD, ts, F.explode(cells).alias("c")).select(ORD, ts, "c.*")


def formula_contributions(series: Series, formula: M.LinearFormula) -> Contributions:
    """Exact contributions of a given linear formula over all rows."""
    r = series.df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(f"m{i}") for i, c in enumerate(formula.terms)]).first()
    means = dict(zip(formula.terms, r))
    base = formula.intercept + sum(w * means[c] for c, w in formula.terms.items())
    return Contributions(linear_table(series.df, formula.terms, means, series.ts), base, "linear", series.ts)


def explain(pipe, series: Series, cfg: ShapConfig = ShapConfig()) -> Contributions:
    """Contributions in the space the model sees, of all rows or those of ``cfg.rows``."""
    if isinstance(pipe, M.LinearFormula):
        return formula_contributions(series, pipe)
    if isinstance(pipe, M.TreeFormula):
        return tree_contributions(pipe, series, cfg)
    return _explain(pipe, explained_rows(pipe, series, cfg), series.ts, cfg)


def explain_classes(pipe, series: Series, cfg: ShapConfig = ShapConfig()) -> dict[object, Contributions]:
    """Contributions to every class, worked out together; by class."""
    if pipe.prepared.task != scores.CLASSIFICATION:
        raise ValueError("only a classifier has classes")
    rows = explained_rows(pipe, series, cfg)
    if isinstance(pipe, B.Blend):
        return {c: _explain_blend(pipe, rows, series.ts, replace(cfg, target=c)) for c in pipe.prepared.classes}
    table, base, how, space = _by_output(pipe, rows, series.ts, cfg)
    return {c: _one_output(table, base, how, space, i, series.ts) for i, c in enumerate(pipe.prepared.classes)}


def tree_contributions(tree: M.TreeFormula, series: Series, cfg: ShapConfig = ShapConfig()) -> Contributions:
    """Exact contributions of a given tree over its raw columns."""
    names = tree.columns()
    packed = array_to_vector(F.array(*[F.coalesce(F.col(q(c)).cast("double"), F.lit(float("nan"))) for c in names]))
    rows = series.df if cfg.rows is None else series.df.where(cfg.rows)
    rows = staging.store(rows.select(ORD, series.ts, packed.alias("features")), "explained")
    explainer = boxes.Explainer(boxes.boxes(tree.nodes(), lambda v: [v]), background_rows(rows, cfg))
    table = boxes.contribution_table(explainer, rows, names, series.ts)
    return _one_output(table, explainer.base, "tree", "prediction", 0, series.ts)


def explained_rows(pipe, series: Series, cfg: ShapConfig) -> DataFrame:
    # Vectors come from the whole series, since a fill needs the rows before; then rows are chosen.
    vectors = pipe.prepared.assemble(series)
    if cfg.rows is not None:
        vectors = vectors.where(cfg.rows)
    return staging.store(vectors.select(ORD, series.ts, "features"), "explained")


def background_rows(rows: DataFrame, cfg: ShapConfig) -> np.ndarray:
    """At most ``cfg.background`` vectors."""
    if cfg.among is not None:
        picked = rows.where(cfg.among).orderBy(ORD)
    else:
        picked = rows.orderBy(F.xxhash64(F.col(ORD), F.lit(cfg.seed + 1)), ORD)
    back = np.array([r["v"] for r in picked.limit(cfg.background).select(vector_to_array("features").alias("v")).collect()], dtype=float)
    if not len(back):
        raise ValueError("no background row is left")
    return back


def _by_output(pipe, rows: DataFrame, ts: str, cfg: ShapConfig, additive: bool = False) -> tuple[DataFrame, np.ndarray, str, str]:
    """(table with ``output``, base values, method, space). ``additive`` asks for predictions or
    probabilities, which blends add, where boosted classifiers would be explained in log odds."""
    found = boxes.leaves_of(rows.sparkSession, pipe.model)
    if found is None or additive and found[1] == "log odds":
        return sampled_outputs(pipe, rows, ts, cfg)
    leaves, space = found
    explainer = boxes.Explainer(leaves, background_rows(rows, cfg))
    return staging.store(boxes.contribution_table(explainer, rows, pipe.names, ts), "contributions"), explainer.base, "tree", space


def _one_output(table: DataFrame, base: np.ndarray, how: str, space: str, output: int, ts: str) -> Contributions:
    own = table.where(F.col("output") == output).drop("output") if len(base) > 1 else table.drop("output")
    return Contributions(own, float(base[output]), how, ts, space)


def _target(pipe, cfg: ShapConfig) -> int:
    if pipe.prepared.task != scores.CLASSIFICATION:
        return 0
    classes = pipe.prepared.classes
    if cfg.target is not None:
        return classes.index(cfg.target)
    return 1 if len(classes) == 2 else 0


def _explain(pipe, rows: DataFrame, ts: str, cfg: ShapConfig, additive: bool = False) -> Contributions:
    if isinstance(pipe, B.Blend):
        return _explain_blend(pipe, rows, ts, cfg)
    linear = pipe.linear_terms()
    if linear is None:
        table, base, how, space = _by_output(pipe, rows, ts, cfg, additive)
        return _one_output(table, base, how, space, _target(pipe, cfg), ts)
    names = pipe.names
    wide = rows.withColumn("_v", vector_to_array("features")) \
               .select(ORD, ts, *[F.col("_v")[i].alias(c) for i, c in enumerate(names)])
    r = wide.agg(*[F.avg(F.col(q(c))).alias(f"m{i}") for i, c in enumerate(names)]).first()
    means = dict(zip(names, r))
    coef, intercept = linear
    base = intercept + sum(w * means[c] for c, w in zip(names, coef))
    return Contributions(linear_table(wide, dict(zip(names, coef)), means, ts), base, "linear", ts)


def blend_tables(parts: list[tuple[Contributions, float]], intercept: float) -> Contributions:
    """A linear blend's contributions are its members', weighted: exact, not an estimate."""
    live = [(c, w) for c, w in parts if abs(w) >= ZERO_WEIGHT]
    if not live:
        raise ValueError("no member has a weight")
    out = None
    for c, w in live:
        t = c.table.withColumn("shap_value", F.col("shap_value") * F.lit(w))
        out = t if out is None else out.unionByName(t)
    ts = live[0][0].ts
    total = out.groupBy(ORD, ts, "feature").agg(F.first("feature_value").alias("feature_value"),
                                                F.sum("shap_value").alias("shap_value"))
    return Contributions(total, intercept + sum(w * c.base_value for c, w in live), "blend", ts)


def _explain_blend(pipe: B.Blend, rows: DataFrame, ts: str, cfg: ShapConfig) -> Contributions:
    names = pipe.prepared.names
    parts = []
    for name, member, w in pipe.parts():
        if member.names != names:
            raise ValueError(f"{name} has other features; its contributions cannot be added")
        if abs(w) >= ZERO_WEIGHT:
            parts.append((_explain(member, rows, ts, cfg, additive=True), w))
    return blend_tables(parts, pipe.intercept)


def _answers(pipe, df: DataFrame) -> tuple[DataFrame, Column]:
    """Predictions, and one array of outputs: the prediction, or the probabilities of all classes (the vote, if there are none)."""
    out = pipe.predict_vectors(df)
    if pipe.prepared.task == scores.CLASSIFICATION:
        vote = F.transform(F.sequence(F.lit(0), F.lit(len(pipe.prepared.classes) - 1)), lambda i: (i == F.col("prediction")).cast("double"))
        return out, F.coalesce(F.col("probability"), vote)
    return out, F.array(F.col("prediction"))


def sampled_shapley(pipe, rows: DataFrame, ts: str, cfg: ShapConfig = ShapConfig()) -> Contributions:
    """One output of ``sampled_outputs``."""
    table, base, how, space = sampled_outputs(pipe, rows, ts, cfg)
    return _one_output(table, base, how, space, _target(pipe, cfg), ts)


def sampled_outputs(pipe, rows: DataFrame, ts: str, cfg: ShapConfig = ShapConfig()) -> tuple[DataFrame, np.ndarray, str, str]:
    """Shapley values by walking from background rows to the row explained, for any model.

    Each background row is the start of one walk in a random feature order; a
    feature gets the change of the answer when its value is switched. Steps of a
    walk add up, so contributions sum to f(row) - mean f(background) exactly. A
    step's answer counts for the feature switched last and against the one that
    is next, so answers are added up where they are made and no walk is shuffled.
    """
    names = pipe.names
    start = background_rows(rows, cfg)
    d, seed = len(names), cfg.seed

    def walks(batches):
        for pdf in batches:
            for o, v in zip(pdf[ORD], pdf["v"]):
                x = np.asarray(v, dtype=float)
                rng = np.random.default_rng([seed, int(o)])
                orders = np.array([rng.permutation(d) for _ in start])
                places = np.argsort(orders, axis=1)                # of each feature in its walk
                switched = places[:, None, :] < np.arange(d + 1)[None, :, None]
                path = np.where(switched, x, start[:, None, :]).reshape(-1, d)
                yield pd.DataFrame({ORD: o, "at": np.insert(orders, 0, -1, axis=1).ravel(),
                                    "next": np.insert(orders, d, -1, axis=1).ravel(), "v": list(path)})

    steps = rows.select(ORD, vector_to_array("features").alias("v")).mapInPandas(walks, f"{ORD} bigint, at int, next int, v array<double>")
    scored, answers = _answers(pipe, steps.withColumn("features", array_to_vector("v")).drop("v"))
    signed = F.explode(F.array(F.struct("at", F.lit(1.0).alias("sign")), F.struct(F.col("next").alias("at"), F.lit(-1.0).alias("sign"))))
    sides = scored.select(ORD, answers.alias("f"), signed.alias("s")).where("s.at >= 0").select(ORD, "s.at", "s.sign", F.posexplode("f").alias("output", "f"))
    per = sides.groupBy(ORD, "output", "at").agg((F.sum(F.col("sign") * F.col("f")) / F.lit(float(len(start)))).alias("shap_value"))
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    values = rows.select(ORD, ts, vector_to_array("features").alias("_v"))
    table = per.join(values, ORD).select(ORD, ts, "output", named.alias("feature"), F.col("_v")[F.col("at")].alias("feature_value"), "shap_value")
    spark = rows.sparkSession
    begun = spark.createDataFrame([(v.tolist(),) for v in start], "v array<double>").withColumn("features", array_to_vector("v")).drop("v")
    scored, answers = _answers(pipe, begun)
    base = np.array([r["f"] for r in scored.select(answers.alias("f")).collect()], dtype=float).mean(0)      # cfg.background rows at most
    space = "probability" if pipe.prepared.task == scores.CLASSIFICATION else "prediction"
    return staging.store(table, "contributions"), base, "sampled", space


# --- views of the long table --------------------------------------------------

def importance(c: Contributions, top_n: int | None = None) -> DataFrame:
    v = F.col("shap_value")
    per = c.table.groupBy("feature").agg(F.avg(F.abs(v)).alias("mean_abs_shap"), F.avg(v).alias("mean_shap"),
                                         F.stddev_samp(v).alias("std_shap"))
    total = per.agg(F.sum("mean_abs_shap").alias("_all"))
    out = per.crossJoin(F.broadcast(total))             # one row on the right
    out = out.withColumn("contribution_pct", 100 * F.try_divide(F.col("mean_abs_shap"), F.col("_all"))).drop("_all") \
             .orderBy(F.desc("mean_abs_shap"), "feature")
    return out.limit(top_n) if top_n else out


def period_bounds(c: Contributions) -> DataFrame:
    return c.table.agg(F.min(c.ts).alias("start"), F.max(c.ts).alias("end"))


def slice_period(c: Contributions, start=None, end=None) -> Contributions:
    """Rows of a period, both ends included; the base value stays."""
    part = timeaxis.period(c.table, start, end, c.ts)
    if not part.limit(1).count():
        raise ValueError("no explained row lies in that period")
    return c.with_table(part)


def dependence(c: Contributions, feature: str, interaction: str | None = None, start=None, end=None) -> DataFrame:
    """(ts, feature_value, shap_value[, interaction_value])."""
    part = timeaxis.period(c.table, start, end, c.ts)
    mine = part.where(F.col("feature") == feature).select(ORD, c.ts, "feature_value", "shap_value")
    if interaction is None:
        return mine.drop(ORD)
    other = part.where(F.col("feature") == interaction).select(ORD, F.col("feature_value").alias("interaction_value"))
    return mine.join(other, ORD, "left").drop(ORD)


def _period_table(spark, periods: list[tuple]) -> DataFrame:
    rows = [(i, label, str(lo) if lo is not None else None, str(hi) if hi is not None else None)
            for i, (label, lo, hi) in enumerate(periods)]
    t = spark.createDataFrame(rows, "at int, period string, lo string, hi string")
    return t.select("at", "period", F.col("lo").cast("timestamp").alias("lo"), F.col("hi").cast("timestamp").alias("hi"))


def in_periods(c: Contributions, periods: list[tuple]) -> DataFrame:
    """The table with a period label; rows in several periods appear in each."""
    p = F.broadcast(_period_table(c.table.sparkSession, periods))
    when = F.col(c.ts)
    inside = (F.col("lo").isNull() | (when >= F.col("lo"))) & (F.col("hi").isNull() | (when <= F.col("hi")))
    return c.table.join(p, inside).drop("lo", "hi")


def dependence_by_periods(c: Contributions, feature: str, periods: list[tuple]) -> DataFrame:
    return in_periods(c, periods).where(F.col("feature") == feature) \
        .select("period", c.ts, "feature_value", "shap_value")


def period_shift(c: Contributions, periods: list[tuple], top_n: int = 15) -> DataFrame:
    """Share of the mean absolute contribution per period, and last minus first."""
    labels = [p[0] for p in periods]
    per = in_periods(c, periods).groupBy("period", "feature").agg(F.avg(F.abs("shap_value")).alias("m"))
    whole = per.groupBy("period").agg(F.sum("m").alias("all"))
    share = per.join(F.broadcast(whole), "period").select("feature", "period", (100 * F.col("m") / F.col("all")).alias("pct"))
    wide = share.groupBy("feature").pivot("period", labels).agg(F.first("pct"))
    filled = [r["period"] for r in whole.select("period").collect()]          # at most one row per period
    present = [p for p in labels if p in filled]
    if not present:
        raise ValueError("no explained row lies in these periods")
    wide = wide.select("feature", *[F.col(q(p)) for p in present])
    if len(present) < 2:
        return wide.orderBy(F.desc(q(present[0])), "feature").limit(top_n)
    change = F.col(q(present[-1])) - F.col(q(present[0]))
    return wide.withColumn("change", change).orderBy(F.desc(F.abs("change")), "feature").limit(top_n)


def interaction_strength(c: Contributions, feature: str) -> DataFrame:
    """(feature, r): other features' values against this feature's contributions."""
    mine = c.table.where(F.col("feature") == feature).select(ORD, F.col("shap_value").alias("_s"))
    others = c.table.where(F.col("feature") != feature).select(ORD, "feature", "feature_value")
    return others.join(mine, ORD).groupBy("feature").agg(F.abs(F.corr("feature_value", "_s")).alias("r"))


def auto_interaction(c: Contributions, feature: str) -> str | None:
    r = F.col("r")
    known = ~F.isnan(r) & r.isNotNull()
    best = interaction_strength(c, feature).where(known).orderBy(F.desc("r"), "feature").limit(1).collect()
    return best[0]["feature"] if best else None


def local_explanation(c: Contributions, when, top_n: int = 12) -> DataFrame:
    """The contributions at the instant nearest to ``when``, the greatest first."""
    t = F.lit(when).cast("timestamp")
    away = F.abs(F.unix_micros(F.col(c.ts)) - F.unix_micros(t))
    at = c.table.agg(F.min_by(ORD, F.struct(away, F.col(ORD))).alias("_at"))
    row = c.table.join(F.broadcast(at), F.col(ORD) == F.col("_at"))
    return row.orderBy(F.desc(F.abs("shap_value")), "feature").limit(top_n) \
              .select(c.ts, "feature", "shap_value", "feature_value")


def quantile_trend(c: Contributions, feature: str, bins: int = 20, least: int = 50) -> DataFrame:
    """(bin, x, y): median value and mean contribution per quantile bin."""
    from tideframe.functions.stats import exact_quantiles
    mine = c.table.where((F.col("feature") == feature) & F.col("feature_value").isNotNull())
    n = mine.count()
    if n <= least:
        return mine.where(F.lit(False)).select(F.lit(0).alias("bin"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    edges = exact_quantiles(mine, {"x": F.col("feature_value")}, [i / bins for i in range(1, bins)])["x"]
    cuts = sorted(set(edges))
    at = sum((F.when(F.col("feature_value") > F.lit(e), 1).otherwise(0) for e in cuts), F.lit(0))
    binned = mine.withColumn("bin", at)
    y = binned.groupBy("bin").agg(F.avg("shap_value").alias("y"))
    return quantiles.grouped_quantiles(binned, ["bin"], F.col("feature_value"), {"x": 0.5}).join(y, "bin").orderBy("bin")


def contribution_stream(c: Contributions, rule: str | None = None, top_n: int = 6) -> DataFrame:
    """(ts, feature, shap_value) of the strongest features, averaged per interval if one is given."""
    top = importance(c, top_n).select("feature")
    part = c.table.join(F.broadcast(top), "feature")
    if rule is None:
        return part.select(c.ts, "feature", "shap_value")
    seconds = timeaxis.seconds_of(rule)
    return (part.groupBy(F.window(c.ts, f"{seconds} seconds").alias("w"), "feature")
            .agg(F.avg("shap_value").alias("shap_value"))
            .select(F.col("w.start").alias(c.ts), "feature", "shap_value"))


def _shuffled(rows: DataFrame, rep: int, seed: int) -> DataFrame:
    """Rows with ``_other``, the features of the row ranked as they are numbered."""
    ranked = SP.random_rank(rows.select(ORD), seed + rep)
    given = rows.select(F.col(ORD).alias("rank"), vector_to_array("features").alias("_other"))
    return rows.join(ranked.join(given, "rank").drop("rank"), ORD)


class _LinearShift:
    """How far a linear prediction moves when one feature is replaced."""

    def __init__(self, coef: list[float]):
        self.coef = np.asarray(coef)

    def moves(self, x: np.ndarray, other: np.ndarray):
        yield from enumerate(((other - x) * self.coef).T)


class _TreeShift:
    """The same for trees: only leaves that ask about the feature can be entered or left."""

    def __init__(self, leaves: list[boxes.Leaf]):
        self.leaves = [leaf for leaf in leaves if len(leaf.features)]

    def moves(self, x: np.ndarray, other: np.ndarray):
        out = np.zeros((x.shape[1], len(x)))
        for leaf in self.leaves:
            mine, theirs = leaf.masks(x), leaf.masks(other)
            full = (1 << len(leaf.features)) - 1
            for i, f in enumerate(leaf.features):
                rest = (mine | 1 << i) == full
                out[f] += leaf.value[0] * (rest & (theirs >> i & 1 == 1)).astype(float) - leaf.value[0] * (mine == full)
        yield from enumerate(out)


def _shift_of(pipe, spark):
    """What moves the predictions of a regression, or None where only the model itself can tell."""
    if isinstance(pipe, B.Blend) or pipe.prepared.task != scores.REGRESSION:
        return None
    if pipe.linear_terms() is not None:
        return _LinearShift(pipe.linear_terms()[0])
    leaves = boxes.leaves_of(spark, pipe.model)
    if leaves is None or max([len(leaf.features) for leaf in leaves[0]], default=0) > boxes.MASK_BITS:
        return None
    return _TreeShift(leaves[0])


def _moved_scores(pipe, rows: DataFrame, shift, metric: str, n_repeats: int, seed: int) -> DataFrame:
    """(feature, rep, m): every feature replaced in turn within a batch of rows, which
    returns four sums per feature; no row is written for a feature."""
    names = pipe.names
    sent = rows.sparkSession.sparkContext.broadcast(shift)      # as large as the model, which the driver holds

    def work(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, other = np.stack(pdf["_own"].to_numpy()), np.stack(pdf["_other"].to_numpy())
            y = pdf["label"].to_numpy(dtype=float)
            error, far = y - pdf["prediction"].to_numpy(dtype=float), np.abs(y) > scores.NEAR_ZERO
            found = []
            for at, moved in sent.value.moves(x, other):
                off = np.abs(error - moved)
                found.append((int(pdf["rep"].iloc[0]), at, (off ** 2).sum(), off.sum(), (off[far] / np.abs(y[far])).sum()))
            yield pd.DataFrame(found, columns=["rep", "at", "sse", "sae", "sape"])

    plain = pipe.predict_vectors(rows.withColumn("_own", vector_to_array("features"))).where("label is not null")
    whole = plain.agg(F.count(F.lit(1)).alias("n"), F.var_pop("label").alias("var"),
                      F.count_if(F.abs("label") > scores.NEAR_ZERO).alias("far"))
    sums = None
    for rep in range(n_repeats):
        pairs = plain.join(_shuffled(rows, rep, seed).select(ORD, "_other"), ORD)
        part = pairs.select(F.lit(rep).alias("rep"), "label", "prediction", "_own", "_other") \
            .mapInPandas(work, "rep int, at int, sse double, sae double, sape double") \
            .groupBy("rep", "at").agg(*[F.sum(c).alias(c) for c in ("sse", "sae", "sape")])
        sums = part if sums is None else sums.unionByName(part)
    spread = F.col("var") * F.col("n")
    got = {"R2": F.when(spread > 0, 1 - F.col("sse") / spread).when(F.col("sse") == 0, 1.0).otherwise(0.0),
           "RMSE": F.sqrt(F.col("sse") / F.col("n")), "MAE": F.col("sae") / F.col("n"),
           "MAPE": F.try_divide(F.col("sape"), F.col("far"))}
    named = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    return sums.crossJoin(F.broadcast(whole)).select(named.alias("feature"), "rep", got[metric].alias("m"))     # one row on the right


def _replaced_scores(pipe, rows: DataFrame, metric: str, n_repeats: int, seed: int) -> DataFrame:
    """The same by asking the model about every row with every feature replaced."""
    names, scored = pipe.names, None
    for rep in range(n_repeats):
        pairs = _shuffled(rows, rep, seed).withColumn("_own", vector_to_array("features"))
        mixed = pairs.withColumn("_at", F.explode(F.array(*[F.lit(i) for i in range(len(names))]))).select(
            ORD, "label", F.lit(rep).alias("rep"),
            F.element_at(F.array(*[F.lit(c) for c in names]), F.col("_at") + 1).alias("feature"),
            array_to_vector(F.transform("_own", lambda x, i: F.when(i == F.col("_at"), F.col("_other")[i]).otherwise(x)))
            .alias("features"))
        scored = mixed if scored is None else scored.unionByName(mixed)
    return _metric_of(pipe, scored, metric)


def permutation_importance(pipe, series: Series, metric: str = "R2", n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): score lost when a feature is shuffled.

    A shuffle is a join of row numbers with hash ranks: row i gets the values of
    the row ranked i. All features share one shuffle per repeat. Linear and tree
    regressions are scored within the batch; other models see each row once per
    feature and repeat, streamed through the model and summed at once.
    """
    rows = staging.store(pipe.prepared.assemble(series).select(ORD, "label", "features"), "permute")
    plain = _metric_of(pipe, rows.withColumn("feature", F.lit("")).withColumn("rep", F.lit(0)), metric).first()["m"]
    shift = _shift_of(pipe, rows.sparkSession)
    moved = _moved_scores(pipe, rows, shift, metric, n_repeats, seed) if shift is not None \
        else _replaced_scores(pipe, rows, metric, n_repeats, seed)
    sign = 1.0 if scores.HIGHER_IS_BETTER.get(metric, True) else -1.0
    drops = moved.withColumn("drop", F.lit(sign) * (F.lit(plain) - F.col("m")))
    return (drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                         F.stddev_pop("drop").alias("importance_std"))
            .orderBy(F.desc("importance_mean"), "feature"))


def _metric_of(pipe, df: DataFrame, metric: str) -> DataFrame:
    prepared = pipe.prepared
    out = scores.score(pipe.predict_vectors(df), prepared.task, ["feature", "rep"], len(prepared.classes),
                       "probability" if prepared.task == scores.CLASSIFICATION else None)
    return out.select("feature", "rep", F.col(metric).alias("m"))
