"""Preprocessing fitted on training rows only: impute, clip, scale, encode."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import kinds, q
from tideframe.functions.stats import clean_double, exact_quantiles, medians
from tideframe.operators import axis
from tideframe.operators.axis import Series

RARE_SHARE = 0.01
ROWS_PER_PARTITION = 25_000
NUMERIC_IMPUTERS = ("ffill", "median", "mean", "zero", "interpolate")
# The interpolating imputer looks ahead in spirit; it fills with the median here too.
LOOKS_AHEAD = frozenset({"interpolate"})


@dataclass(frozen=True)
class PreprocessConfig:
    impute_numeric: str = "ffill"
    impute_categorical: str = "most_frequent"
    scaler: str = "standard"
    categorical_encoding: str = "onehot"
    clip_outliers: bool = False
    clip_quantiles: tuple[float, float] = (0.001, 0.999)


def impute_warning(cfg: PreprocessConfig) -> str | None:
    if cfg.impute_numeric in LOOKS_AHEAD:
        return "interpolation uses later values; scores made with it are too good"
    return None


def column_types(series: Series, cols: list[str]) -> tuple[list[str], list[str]]:
    types = kinds(series.df)
    return [c for c in cols if types[c] == "numeric"], [c for c in cols if types[c] != "numeric"]


@dataclass
class FittedPrep:
    """Statistics learnt on one training range, applied to any other."""

    numeric: list[str]
    categorical: list[str]
    cfg: PreprocessConfig
    fill: dict[str, float] = field(default_factory=dict)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    centre: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    modes: dict[str, str] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)
    level_tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def output_columns(self) -> list[str]:
        out = list(self.numeric)
        for c in self.categorical:
            if self.cfg.categorical_encoding == "ordinal":
                out.append(c)
            else:
                out += [onehot_name(c, v) for v in self.levels[c]]
                if c in self.level_tables:
                    out.append(onehot_name(c, "infrequent"))
        return out

    def impute(self, part: Series) -> DataFrame:
        """Numbers filled; the fill starts anew with the rows given."""
        df = part.df.withColumns({c: clean_double(F.col(q(c))) for c in self.numeric}) if self.numeric else part.df
        if self.cfg.impute_numeric == "ffill" and self.numeric:
            df = axis.last_seen(part.with_df(df), {c: F.col(q(c)) for c in self.numeric})
        return df.withColumns({c: F.coalesce(F.col(q(c)), F.lit(self.fill[c])) for c in self.numeric}) \
            if self.numeric else df

    def _clipped(self, c: str) -> Column:
        x = F.col(q(c))
        if c in self.clip:
            lo, hi = self.clip[c]
            x = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
        return x

    def _scaled(self, c: str) -> Column:
        x = self._clipped(c)
        return (x - F.lit(self.centre[c])) / F.lit(self.scale[c]) if c in self.centre else x

    def transform(self, part: Series, keep: list[str]) -> DataFrame:
        """Output columns after the ones in ``keep``."""
        return self.finish(self.impute(part), keep)

    def finish(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Clip, scale and encode rows whose numbers are already filled."""
        made = [self._scaled(c).alias(c) for c in self.numeric]
        for c in self.categorical:
            value = F.coalesce(F.col(q(c)).cast("string"), F.lit(self.modes[c]))
            if c in self.level_tables:
                # Frequent levels are not in the table; scattered keys without a match keep them apart.
                aside = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*[F.col(q(k)) for k in keep]), F.lit(1_024)).cast("string"))
                key = F.when(value.isin(self.levels[c]), aside).otherwise(value) if self.levels[c] else value
                df = df.withColumns({f"_l_{c}": value, f"_k_{c}": key}).join(
                    self.level_tables[c].select(F.col("level").alias(f"_k_{c}"), F.col("code").alias(f"_c_{c}")),
                    f"_k_{c}", "left")
                value = F.col(q(f"_l_{c}"))
            if self.cfg.categorical_encoding == "ordinal":
                made.append(F.coalesce(F.col(q(f"_c_{c}")), F.lit(-1)).cast("double").alias(c))
                continue
            made += [(value == F.lit(v)).cast("double").alias(onehot_name(c, v)) for v in self.levels[c]]
            if c in self.level_tables:
                made.append(F.col(q(f"_c_{c}")).isNotNull().cast("double").alias(onehot_name(c, "infrequent")))
        return df.select(*[F.col(q(k)) for k in keep], *made)

    def params(self) -> dict:
        return {"numeric": self.numeric, "categorical": self.categorical, "fill": self.fill, "clip": self.clip,
                "centre": self.centre, "scale": self.scale, "modes": self.modes, "levels": self.levels}


def onehot_name(col: str, level: str) -> str:
    return f"{col}_{level}"


def fit(train: Series, numeric: list[str], categorical: list[str], cfg: PreprocessConfig | None = None) -> FittedPrep:
    """Learn every statistic from the rows of ``train`` and nothing else."""
    out, filled = fit_filled(train, numeric, categorical, cfg)
    filled.unpersist()
    return out


def fit_filled(train: Series, numeric: list[str], categorical: list[str],
               cfg: PreprocessConfig | None = None) -> tuple[FittedPrep, DataFrame]:
    """The same, with the filled training rows, persisted: later steps need them too."""
    cfg = cfg or PreprocessConfig()
    if cfg.impute_numeric not in NUMERIC_IMPUTERS:
        raise ValueError(f"unknown imputer {cfg.impute_numeric}")
    out = FittedPrep(list(numeric), list(categorical), cfg)
    xs = {c: clean_double(F.col(q(c))) for c in numeric}
    if cfg.impute_numeric == "zero" or not numeric:
        out.fill = {c: 0.0 for c in numeric}
    elif cfg.impute_numeric == "mean":
        r = train.df.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(xs.values())]).first()
        out.fill = {c: r[i] if r[i] is not None else 0.0 for i, c in enumerate(numeric)}
    else:
        out.fill = {c: v if v is not None else 0.0 for c, v in medians(train.df, xs, rows_at_most=train.n).items()}
    filled = compact(out.impute(train), train.n).persist()
    if numeric and (cfg.clip_outliers or cfg.scaler in ("standard", "robust")):
        if cfg.clip_outliers:
            cuts = exact_quantiles(filled, {c: F.col(q(c)) for c in numeric}, list(cfg.clip_quantiles),
                                   rows_at_most=train.n)
            out.clip = {c: (v[0], v[1]) for c, v in cuts.items() if v[0] is not None}
        clipped = {c: out._clipped(c) for c in numeric}
        if cfg.scaler == "standard":
            r = filled.agg(*[e for i, c in enumerate(numeric) for e in (
                F.avg(clipped[c]).alias(f"m{i}"), F.stddev_pop(clipped[c]).alias(f"s{i}"))]).first()
            out.centre = {c: r[f"m{i}"] or 0.0 for i, c in enumerate(numeric)}
            out.scale = {c: r[f"s{i}"] if r[f"s{i}"] else 1.0 for i, c in enumerate(numeric)}
        elif cfg.scaler == "robust":
            cuts = exact_quantiles(filled, clipped, [0.25, 0.5, 0.75], rows_at_most=train.n)
            out.centre = {c: v[1] or 0.0 for c, v in cuts.items()}
            out.scale = {c: (v[2] - v[0]) if v[0] is not None and v[2] > v[0] else 1.0 for c, v in cuts.items()}
    for c in categorical:
        _fit_levels(out, train.df, c)
    return out, filled


def compact(df: DataFrame, at_most: int) -> DataFrame:
    """Few partitions for few rows: iterative fits run one task per partition and
    step. Anything beyond a few partitions' worth of rows is left as it is."""
    wanted = max(1, -(-at_most // ROWS_PER_PARTITION))
    return df.coalesce(wanted) if wanted < df.sparkSession.sparkContext.defaultParallelism else df


def _fit_levels(out: FittedPrep, df: DataFrame, c: str) -> None:
    """Mode (the smallest on a tie), frequent levels, and a table of the others."""
    counts = df.select(F.col(q(c)).cast("string").alias("level")).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    known = counts.where(F.col("level").isNotNull())
    top = known.orderBy(F.desc("n"), "level").limit(1).collect()
    out.modes[c] = top[0]["level"] if top else ""
    # Filled rows count for the mode.
    filled = counts.groupBy(F.coalesce("level", F.lit(out.modes[c])).alias("level")).agg(F.sum("n").alias("n"))
    if out.cfg.categorical_encoding == "ordinal":
        numbered = axis.ordinal(filled.select("level"), ["level"], name="code").df
        out.level_tables[c] = staging.store(numbered.select("level", "code"), "levels")
        out.levels[c] = []
        return
    total = filled.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= F.lit(RARE_SHARE * total)
    out.levels[c] = sorted(r["level"] for r in filled.where(frequent).collect())    # at most 100
    rare = filled.where(~frequent)
    if rare.limit(1).count():
        out.level_tables[c] = staging.store(rare.select("level", F.lit(1).alias("code")), "levels")
