"""Exact quantiles per group that no hot group can pull into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.operators import axis


GROUPS = 200_000        # groups whose spans may be broadcast: some 20 MB
SALTS = 64


def _with_spans(run: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """The rows with their group's span: sent to every task while groups are few, else
    met on salted keys, so that no group is one task."""
    spans = staging.store(spans, "spans")
    if spans.count() <= GROUPS:
        return run.join(F.broadcast(spans), by)
    salted = spans.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return run.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int")).join(salted, [*by, "_salt"]).drop("_salt")


def grouped_quantiles(df: DataFrame, by: list[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """One row per group with the interpolated quantiles named in ``probs``.

    Equal values are counted first; running counts over (group, value) are
    range-partitioned, so a large group spreads over many tasks.
    """
    keys = [F.col(q(c)) for c in by]
    counted = (df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
               .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    run = axis.running_totals(counted, [*by, "_v"], {"_upto": "_c"})
    spans = run.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"),
                                   F.max("_upto").alias("_end"))
    n = F.col("_end") - F.col("_start")
    placed = _with_spans(run, spans, by).withColumn("_hi", F.col("_upto") - F.col("_start")) \
                .withColumn("_lo", F.col("_hi") - F.col("_c"))
    aggs = []
    for name, p in probs.items():
        h = (n - 1) * F.lit(float(p))
        for side, rank in (("a", F.floor(h)), ("b", F.ceil(h))):
            aggs.append(F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))
                        .alias(f"_{side}_{name}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"_f_{name}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[
        (F.col(q(f"_a_{m}")) + (F.col(q(f"_b_{m}")) - F.col(q(f"_a_{m}"))) * F.col(q(f"_f_{m}"))).alias(m)
        for m in probs])
