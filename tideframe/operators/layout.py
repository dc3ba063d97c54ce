"""Wide and long layouts: detection, pivoting, melting, inventories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideframe.functions.names import kind, kinds, numeric_columns, q
from tideframe.functions.stats import clean_double

# Name fragments that hint at a column's role.
TAG_HINTS = ("tag", "태그", "item", "point", "name", "이름", "변수", "sensor", "센서",
             "signal", "code", "코드", "지점")
VALUE_HINTS = ("value", "val", "값", "측정", "meas", "reading", "data")
TIME_HINTS = ("time", "date", "dt", "stamp", "일시", "시각", "일자", "시간")
# Scores and limits of the layout decision.
MAX_TAGS = 5000
MIN_TAGS = 2
ROWS_PER_TAG = 3
LONG_SCORE = 0.6
WEIGHTS = {"repeated_times": 0.5, "tag_column": 0.3, "few_columns": 0.1, "value_column": 0.1}

AGGREGATES = ("mean", "last", "max", "min")


class LayoutError(ValueError):
    """The table cannot be turned from long to wide."""


@dataclass
class Layout:
    layout: str = "wide"
    confidence: float = 0.0
    time_col: str | None = None
    tag_col: str | None = None
    value_col: str | None = None
    n_tags: int = 0
    reasons: list[str] = field(default_factory=list)


def as_time(col: Column, dtype: T.DataType | None = None) -> Column:
    """Timestamps from any column; what does not parse becomes NULL."""
    if dtype is not None and kind(dtype) == "datetime":
        return col.cast("timestamp")
    return F.try_to_timestamp(col.cast("string"))


def time_of(df: DataFrame, name: str) -> Column:
    return as_time(F.col(q(name)), df.schema[name].dataType)


def number_of(df: DataFrame, name: str) -> Column:
    c = F.col(q(name))
    if kind(df.schema[name].dataType) == "numeric":
        return clean_double(c)
    return clean_double(c.try_cast("double"))


def _hinted(names: list[str], hints: tuple[str, ...]) -> str | None:
    return next((n for n in names if any(h in n.lower() for h in hints)), None)


def guess_time_column(df: DataFrame) -> str | None:
    """By name, then by type, then the first text column of which over 80% reads as time."""
    hinted = _hinted(df.columns, TIME_HINTS)
    if hinted:
        return hinted
    types = kinds(df)
    typed = next((c for c in df.columns if types[c] == "datetime"), None)
    if typed:
        return typed
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return None
    reads = [F.avg(F.when(F.col(q(c)).isNotNull(), as_time(F.col(q(c))).isNotNull().cast("double"))) for c in texts]
    shares = df.agg(*[e.alias(f"s{i}") for i, e in enumerate(reads)]).first()
    return next((c for c, share in zip(texts, shares) if (share or 0) > 0.8), None)


def layout_stats(df: DataFrame, time_col: str) -> DataFrame:
    """One row: readable times, distinct times, distinct values of every text column."""
    ts = time_of(df, time_col)
    texts = [c for c, k in kinds(df, (time_col,)).items() if k == "categorical"]
    return df.agg(F.count(ts).alias("n_times"), F.countDistinct(ts).alias("distinct_times"),
                  *[F.countDistinct(F.col(q(c))).alias(f"distinct_{c}") for c in texts])


def detect_layout(df: DataFrame, time_col: str | None = None) -> Layout:
    """Long if instants repeat and a tag column and a value column can be named."""
    out = Layout(time_col=time_col)
    if len(df.columns) < 3:
        out.reasons.append("fewer than three columns")
        return out
    out.time_col = time_col or guess_time_column(df)
    if out.time_col is None or out.time_col not in df.columns:
        out.reasons.append("no time column")
        return out
    stats = layout_stats(df, out.time_col).first().asDict()
    n = stats["n_times"]
    if n < 3:
        out.reasons.append("hardly any readable times")
        return out
    repeated = 1.0 - stats["distinct_times"] / n
    types = kinds(df, (out.time_col,))
    distinct = {c: stats[f"distinct_{c}"] for c, k in types.items() if k == "categorical"}
    tags = [c for c, d in distinct.items() if MIN_TAGS <= d <= MAX_TAGS and n / d >= ROWS_PER_TAG]
    values = [c for c, k in types.items() if k == "numeric"]
    found = {"repeated_times": repeated > 0.3, "tag_column": bool(tags),
             "few_columns": len(types) <= 4, "value_column": bool(values)}
    out.reasons += [k for k, hit in found.items() if hit]
    if not tags or not values:
        out.reasons.append("no pair of tag and value columns")
        return out
    score = sum(WEIGHTS[k] for k, hit in found.items() if hit)
    out.tag_col = _hinted(tags, TAG_HINTS) or tags[0]
    out.value_col = _hinted(values, VALUE_HINTS) or values[0]
    out.n_tags = distinct[out.tag_col]
    out.confidence = round(min(score, 1.0), 2)
    if round(score, 9) >= LONG_SCORE:
        out.layout = "long"
    else:
        out.reasons.append("too little evidence for long")
    return out


def _long_rows(df: DataFrame, time_col: str, tag_col: str, value_col: str) -> DataFrame:
    return df.select(time_of(df, time_col).alias(time_col),
                     F.trim(F.col(q(tag_col)).cast("string")).alias(tag_col),
                     number_of(df, value_col).alias("_value"),
                     F.xxhash64(*[F.col(q(c)) for c in df.columns]).alias("_any"),
                     *[F.col(q(c)).alias(f"_tie_{c}") for c in df.columns])


def long_to_wide(df: DataFrame, time_col: str, tag_col: str, value_col: str, agg: str = "mean",
                 tags: list[str] | None = None, tiebreak: str | None = None) -> DataFrame:
    """One row per instant, one column per tag.

    Rows without a readable time or number are left out. Several rows for one
    (instant, tag) are merged by ``agg``; ``last`` goes by ``tiebreak``.
    """
    names = (time_col, tag_col, value_col)
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise LayoutError(f"no column {missing[0]}")
    if len(set(names)) < 3:
        raise LayoutError("time, tag and value must be three columns")
    if agg not in AGGREGATES:
        raise LayoutError(f"unknown aggregate {agg}")
    rows = _long_rows(df, time_col, tag_col, value_col).where(
        F.col(q(time_col)).isNotNull() & F.col("_value").isNotNull())
    if tags is None:
        found = rows.select(q(tag_col)).distinct().limit(MAX_TAGS + 1).collect()
        if len(found) > MAX_TAGS:
            raise LayoutError(f"more than {MAX_TAGS} tags; pass the ones to keep")
        tags = sorted(r[0] for r in found if r[0] is not None)
    else:
        rows = rows.where(F.col(q(tag_col)).isin(list(tags)))
        tags = sorted(tags)
    if not tags:
        raise LayoutError("no usable rows")
    order = F.col(q(f"_tie_{tiebreak}")) if tiebreak else F.col("_any")
    merged = {"mean": F.avg("_value"), "max": F.max("_value"), "min": F.min("_value"),
              "last": F.max_by("_value", order)}[agg]
    wide = rows.groupBy(q(time_col)).pivot(tag_col, list(tags)).agg(merged)
    return wide


def long_stats(df: DataFrame, time_col: str, tag_col: str, value_col: str) -> DataFrame:
    """One row: tags, instants, rows dropped as non-numeric, repeated (instant, tag) rows."""
    rows = _long_rows(df, time_col, tag_col, value_col).where(F.col(q(time_col)).isNotNull())
    per_cell = rows.groupBy(q(time_col), q(tag_col)).agg(
        F.count("_value").alias("used"), F.count_if(F.col("_value").isNull()).alias("dropped"))
    used = F.col("used") > 0
    return per_cell.agg(
        F.countDistinct(F.when(used, F.col(q(tag_col)))).alias("tags"),
        F.countDistinct(F.when(used, F.col(q(time_col)))).alias("instants"),
        F.coalesce(F.sum("dropped"), F.lit(0)).alias("dropped_non_numeric"),
        F.coalesce(F.sum(F.when(used, F.col("used") - 1)), F.lit(0)).alias("repeated"))


def wide_to_long(df: DataFrame, time_col: str, tags: list[str] | None = None,
                 tag_col: str = "tag", value_col: str = "value") -> DataFrame:
    cols = tags or numeric_columns(df, (time_col,))
    wide = df.select(q(time_col), *[F.col(q(c)).cast("double").alias(c) for c in cols])
    return wide.unpivot([time_col], list(cols), tag_col, value_col).where(F.col(q(value_col)).isNotNull())


def tag_inventory(df: DataFrame, time_col: str, tag_col: str, value_col: str) -> DataFrame:
    """Per tag: rows, share that reads as a number, mean, min, max; largest first."""
    v = F.col("_value")
    return (_long_rows(df, time_col, tag_col, value_col)
            .groupBy(F.col(q(tag_col)).alias("tag"))
            .agg(F.count(F.lit(1)).alias("rows"), F.avg(v.isNotNull().cast("double")).alias("numeric_ratio"),
                 F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
            .orderBy(F.desc("rows"), "tag"))
