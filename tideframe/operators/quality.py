"""Column profiles, correlated duplicates, and what to leave out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tideframe.functions.names import kinds, numeric_columns, q
from tideframe.functions.stats import clean_double, even_bucket, exact_quantiles
from tideframe.operators import axis, gram
from tideframe.operators.axis import ORD, Series


@dataclass(frozen=True)
class QualityRule:
    max_missing_ratio: float = 0.30
    min_unique: int = 2
    max_dominant_ratio: float = 0.98
    max_corr: float = 0.95
    max_categorical_levels: int = 50


FLATLINE_LIMIT = 0.99


def _per_column(df: DataFrame, aggs: dict[str, list[tuple[str, Column]]], schema: str) -> DataFrame:
    """One aggregate pass over all columns, turned into one row per column."""
    flat = [e.alias(f"{i}_{m}") for i, pairs in enumerate(aggs.values()) for m, e in pairs]
    row = df.agg(*flat).first()
    rows = [(c, *[row[f"{i}_{m}"] for m, _ in pairs]) for i, (c, pairs) in enumerate(aggs.items())]
    return df.sparkSession.createDataFrame(rows, schema)


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_unique, top_count): distinct known values and the commonest one's count.

    Equal values are counted map-side, so a value held by a third of the rows
    reaches the shuffle as one row per task.
    """
    types = kinds(df)
    numbers = [c for c in cols if types[c] == "numeric"]
    others = [c for c in cols if types[c] != "numeric"]
    parts = []
    for group, cast in ((numbers, "double"), (others, "string")):
        if group:
            tall = df.select(*[F.col(q(c)).cast(cast).alias(c) for c in group]) \
                     .unpivot([], list(group), "column", "value")
            counted = tall.where(F.col("value").isNotNull() if cast == "string" else clean_double(F.col("value")).isNotNull()) \
                          .groupBy("column", "value").count()
            parts.append(counted.groupBy("column").agg(
                F.count(F.lit(1)).alias("n_unique"), F.max("count").alias("top_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def basic_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, rows, known, mean, std, min, max); moments for numeric columns only."""
    types = kinds(df)
    none = F.lit(None).cast("double")
    aggs = {}
    for c in cols:
        num = types[c] == "numeric"
        x = clean_double(F.col(q(c))) if num else F.col(q(c))
        aggs[c] = [("rows", F.count(F.lit(1))), ("known", F.count(x)),
                   *[(m, f(x) if num else none) for m, f in
                     (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]]
    return _per_column(df, aggs, "column string, rows bigint, known bigint, "
                                 "mean double, std double, min double, max double")


def outlier_ratios(df: DataFrame, cols: list[str], rows_at_most: int | None = None) -> DataFrame:
    """Share of known values outside the quartiles by 1.5 IQR; 0 when the IQR is 0."""
    xs = {c: clean_double(F.col(q(c))) for c in cols}
    quartiles = exact_quantiles(df, xs, [0.25, 0.75], rows_at_most=rows_at_most)
    aggs = {}
    for c, x in xs.items():
        q1, q3 = quartiles[c]
        if q1 is None:
            e = F.lit(None).cast("double")
        elif q3 - q1 > 0:
            reach = 1.5 * (q3 - q1)
            outside = (x < F.lit(q1 - reach)) | (x > F.lit(q3 + reach))
            e = F.avg(outside.cast("double"))
        else:
            e = F.lit(0.0)
        aggs[c] = [("outlier_ratio", e)]
    return _per_column(df, aggs, "column string, outlier_ratio double")


def flatline_ratios(series: Series, cols: list[str]) -> DataFrame:
    """Share of known values equal to the known value before."""
    xs = {c: clean_double(F.col(q(c))) for c in cols}
    narrow = series.with_df(series.df.select(ORD, *[e.alias(c) for c, e in xs.items()]))
    before = axis.last_seen(narrow, {f"_prev_{c}": F.col(q(c)) for c in cols}, inclusive=False)
    aggs = {}
    for c in cols:
        same = F.count_if(F.col(q(c)) == F.col(q(f"_prev_{c}")))
        aggs[c] = [("flatline_ratio", F.try_divide(same.cast("double"), F.count(F.col(q(c)))))]
    return _per_column(before, aggs, "column string, flatline_ratio double")


def profile(series: Series, cols: list[str] | None = None) -> DataFrame:
    """One row per column: kind, type, missing, distinct, dominant, spread and shape."""
    df = series.df
    cols = cols or series.columns
    types = kinds(df)
    numbers = [c for c in cols if types[c] == "numeric"]
    labels = df.sparkSession.createDataFrame(
        [(i, c, types[c], df.schema[c].dataType.simpleString()) for i, c in enumerate(cols)],
        "position int, column string, kind string, dtype string")
    out = (labels.join(basic_profile(df, cols), "column", "left")
           .join(value_counts(df, cols), "column", "left"))
    if numbers:
        out = (out.join(outlier_ratios(df, numbers, series.n), "column", "left")
               .join(flatline_ratios(series, numbers), "column", "left"))
    else:
        out = out.withColumn("outlier_ratio", F.lit(None).cast("double")) \
                 .withColumn("flatline_ratio", F.lit(None).cast("double"))
    rows = F.col("rows")
    missing = F.when(rows > 0, (rows - F.col("known")) / rows).otherwise(1.0)
    return out.select(
        "position", "column", "kind", "dtype", F.bround(missing, 4).alias("missing_ratio"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.bround(F.try_divide(F.col("top_count").cast("double"), F.col("known")), 4).alias("dominant_ratio"),
        F.bround("outlier_ratio", 4).alias("outlier_ratio"), F.bround("flatline_ratio", 4).alias("flatline_ratio"),
        "mean", "std", "min", "max").orderBy("position")


def correlated_pairs(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Pairs with |r| at or over the threshold, the emptier column (first on a tie) to drop."""
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    schema = "feature_a string, feature_b string, corr double, suggest_drop string"
    if len(cols) < 2:
        return spark.createDataFrame([], schema)
    info = gram.centres(df, cols)
    sums = gram.cross_moments(df, cols, cols, {c: s.shift for c, s in info.items()})
    about = spark.createDataFrame([(c, i, info[c].nulls) for i, c in enumerate(cols)], "c string, at int, nulls bigint")
    a = about.select(F.col("c").alias("x"), F.col("at").alias("at_x"), F.col("nulls").alias("nulls_x"))
    b = about.select(F.col("c").alias("y"), F.col("at").alias("at_y"), F.col("nulls").alias("nulls_y"))
    pairs = sums.join(F.broadcast(a), "x").join(F.broadcast(b), "y").where("at_x < at_y")
    r = F.abs(gram.correlation())
    return (pairs.withColumn("r", r).where(F.col("r") >= threshold)
            .orderBy(F.desc("r"), "at_x", "at_y")
            .select(F.col("x").alias("feature_a"), F.col("y").alias("feature_b"), F.bround("r", 4).alias("corr"),
                    F.when(F.col("nulls_x") >= F.col("nulls_y"), F.col("x")).otherwise(F.col("y"))
                    .alias("suggest_drop")))


def suggest_drops(prof: DataFrame, rule: QualityRule = QualityRule(), protect: list[str] | None = None,
                  pairs: DataFrame | None = None) -> DataFrame:
    """(column, reason, source): one row per column to leave out, reasons joined."""
    unique, dominant = F.col("n_unique"), F.col("dominant_ratio")
    rules = {
        "missing": F.col("missing_ratio") > rule.max_missing_ratio,
        "constant": unique < rule.min_unique,
        "dominant value": (dominant > rule.max_dominant_ratio) & (unique >= rule.min_unique),
        "flatline": F.col("flatline_ratio") > FLATLINE_LIMIT,
        "too many levels": (F.col("kind") == "categorical") & (unique > rule.max_categorical_levels),
    }
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    found = prof.select("column", F.array_join(hits, ", ").alias("reason"), F.lit("quality").alias("source"),
                        F.lit(0).alias("rank")).where(F.col("reason") != "")
    if pairs is not None:
        other = F.when(F.col("suggest_drop") == F.col("feature_a"), F.col("feature_b")).otherwise(F.col("feature_a"))
        found = found.unionByName(pairs.select(
            F.col("suggest_drop").alias("column"),
            F.format_string("correlates %.2f with %s", F.col("corr"), other).alias("reason"),
            F.lit("duplicate").alias("source"), F.lit(1).alias("rank")))
    if protect:
        found = found.where(~F.col("column").isin(list(protect)))
    # Few rows: one per rule hit or correlated pair.
    lines = F.array_sort(F.collect_set(F.struct("rank", "reason")))
    return found.groupBy("column").agg(
        F.array_join(F.transform(lines, lambda x: x["reason"]), " / ").alias("reason"),
        F.min_by("source", "rank").alias("source")).orderBy("column")


def missing_grid(series: Series, cols: list[str], bins: int = 200) -> DataFrame:
    """Share of NULLs per column in at most ``bins`` runs of rows, and each run's first instant."""
    k = min(bins, max(series.n, 1))
    number = even_bucket(F.col(ORD), max(series.n, 1), k)
    return (series.df.groupBy(number.alias("bin"))
            .agg(F.min(series.ts).alias("start"),
                 *[F.avg(F.col(q(c)).isNull().cast("double")).alias(c) for c in cols])
            .orderBy("bin"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    x = clean_double(F.col(q(target)))
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                  F.avg(x.isNull().cast("double")).alias("missing_ratio"), F.countDistinct(x).alias("n_unique"))


def fingerprint(df: DataFrame, ts: str | None = None) -> DataFrame:
    """One row that changes with any value, whatever the order of rows.

    Every row is hashed; hashes are added up as decimals, with the count and the
    schema text beside them.
    """
    cols = [c for c in df.columns if c != ORD]
    span = [F.min(ts).alias("start"), F.max(ts).alias("end")] if ts else []
    row_hash = F.xxhash64(*[F.col(q(c)) for c in cols])
    text = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields if f.name in cols)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).alias("columns"),
                  F.sum(row_hash.cast("decimal(38,0)")).alias("hash_sum"),
                  F.bit_xor(row_hash).alias("hash_xor"), *span) \
             .withColumn("schema", F.lit(text)) \
             .withColumn("fingerprint", F.sha2(F.concat_ws("|", "rows", "hash_sum", "hash_xor", "schema"), 256))
