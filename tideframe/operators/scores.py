"""Regression and classification scores, per group, in distributed passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import q
from tideframe.operators import axis

REGRESSION = "regression"
CLASSIFICATION = "classification"
REGRESSION_METRICS = ("R2", "RMSE", "MAE", "MAPE")
CLASSIFICATION_METRICS = ("Accuracy", "F1", "ROC_AUC")
HIGHER_IS_BETTER = {"R2": True, "RMSE": False, "MAE": False, "MAPE": False,
                    "Accuracy": True, "F1": True, "ROC_AUC": True}
NEAR_ZERO = 1e-9


def regression_scores(df: DataFrame, actual: str = "label", predicted: str = "prediction",
                      by: list[str] | None = None) -> DataFrame:
    """R2, RMSE, MAE, and MAPE over targets away from zero; one aggregate."""
    y, p = F.col(q(actual)).cast("double"), F.col(q(predicted)).cast("double")
    error = y - p
    sums = df.where(y.isNotNull() & p.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("sse"), F.var_pop(y).alias("var"),
        F.avg(F.abs(error)).alias("MAE"),
        F.avg(F.when(F.abs(y) > NEAR_ZERO, F.abs(error) / F.abs(y))).alias("MAPE"))
    spread = F.col("var") * F.col("n")
    r2 = F.when(spread > 0, 1 - F.col("sse") / spread).when(F.col("sse") == 0, 1.0).otherwise(0.0)
    return sums.select(*(by or []), "n", F.when(F.col("n") > 0, r2).alias("R2"),
                       F.sqrt(F.col("sse") / F.col("n")).alias("RMSE"), "MAE", "MAPE")


def confusion(df: DataFrame, actual: str = "label", predicted: str = "prediction",
              by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(q(actual)).alias("actual"), F.col(q(predicted)).alias("predicted")) \
             .agg(F.count(F.lit(1)).alias("n"))


def label_scores(df: DataFrame, actual: str = "label", predicted: str = "prediction",
                 by: list[str] | None = None) -> DataFrame:
    """Accuracy and macro F1 (0 where a class has no true or predicted rows)."""
    keys = by or []
    cells = confusion(df, actual, predicted, keys)
    hit = F.col("actual") == F.col("predicted")
    total = cells.groupBy(*keys).agg(F.sum("n").alias("n"),
                                     F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    tall = cells.select(*keys, F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("true"), F.lit(0).cast("bigint").alias("pred"),
                 F.when(hit, F.col("n")).otherwise(0).cast("bigint").alias("both")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("true"), F.col("n").alias("pred"),
                 F.lit(0).cast("bigint").alias("both")))).alias("c")).select(*keys, "c.*")
    per = tall.groupBy(*keys, "class").agg(*[F.sum(m).alias(m) for m in ("true", "pred", "both")])
    f1 = per.groupBy(*keys).agg(F.avg(2.0 * F.col("both") / (F.col("true") + F.col("pred"))).alias("F1"))
    joined = total.join(f1, keys) if keys else total.crossJoin(f1)      # one row on each side
    return joined.select(*keys, "n", (F.col("hits") / F.col("n")).alias("Accuracy"), "F1")


def roc_auc(df: DataFrame, positive: Column, score: Column, by: list[str] | None = None) -> DataFrame:
    """Area under the curve, ties counted half; NULL when a class is absent.

    Rows are first counted per distinct score; the running count of negatives
    comes from a range-partitioned pass, so no task sees the whole ranking.
    """
    keys = by or []
    counted = df.select(*[F.col(q(k)) for k in keys], positive.cast("int").alias("_pos"), score.alias("_s")) \
        .where(F.col("_s").isNotNull() & F.col("_pos").isNotNull()).groupBy(*keys, "_s") \
        .agg(F.sum("_pos").cast("double").alias("pos"), F.sum(1 - F.col("_pos")).cast("double").alias("neg"))
    run = axis.running_totals(counted, [*keys, "_s"], {"below": "neg"})
    sums = run.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2)).alias("wins"),
        F.min(F.col("below") - F.col("neg")).alias("start"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    area = (F.col("wins") - F.col("start") * F.col("P")) / (F.col("P") * F.col("N"))
    return sums.select(*keys, F.when((F.col("P") > 0) & (F.col("N") > 0), area).alias("ROC_AUC"))


def classification_scores(df: DataFrame, n_classes: int, actual: str = "label", predicted: str = "prediction",
                          probability: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Label scores plus ROC AUC: binary, or the mean of one-against-rest."""
    keys = by or []
    out = label_scores(df, actual, predicted, keys)
    if probability is None:
        return out.withColumn("ROC_AUC", F.lit(None).cast("double"))
    classes = [1] if n_classes == 2 else list(range(n_classes))
    tall = df.select(*[F.col(q(k)) for k in keys], q(actual), F.posexplode(q(probability)).alias("_class", "_p")) \
             .where(F.col("_class").isin(classes))
    per = roc_auc(tall, F.col(q(actual)) == F.col("_class"), F.col("_p"), [*keys, "_class"])
    whole = F.when(F.count("ROC_AUC") == len(classes), F.avg("ROC_AUC"))
    mean = per.groupBy(*keys).agg(whole.alias("ROC_AUC"))
    return out.join(mean, keys, "left") if keys else out.crossJoin(mean)


def score(df: DataFrame, task: str, by: list[str] | None = None, n_classes: int = 2,
          probability: str | None = None) -> DataFrame:
    if task == REGRESSION:
        return regression_scores(df, by=by)
    return classification_scores(df, n_classes, probability=probability, by=by)


def metrics_of(task: str) -> tuple[str, ...]:
    return REGRESSION_METRICS if task == REGRESSION else CLASSIFICATION_METRICS
