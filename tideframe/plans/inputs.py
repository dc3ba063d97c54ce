"""The frames the catalogue works on, derived from the given tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tideframe.functions.names import q
from tideframe.operators import axis, layout, timeaxis
from tideframe.operators.axis import ORD, Series
from tideframe.operators.models import LinearFormula, TreeFormula

TAGS = ["click", "error", "purchase", "signup", "view"]
# A fixed linear predictor of an event's value, so that scores have closed forms.
FORMULA = LinearFormula({"user_id": 0.1, "k": 0.2}, 30.0, "value")

# A fixed tree over the same columns.
TREE = TreeFormula(("k", 50.0, ("user_id", 40.0, 10.0, ("k", 20.0, 35.0, 22.0)), ("user_id", 90.0, -4.0, 51.0)), "value")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "user_id", "event_type", "value",
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


def event_series(spark: SparkSession, sf_dir: str) -> Series:
    """Irregular series, one row per event."""
    return axis.ordinal(events(spark, sf_dir), ["ts", "event_id"])


def event_rows_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: the hour, the event type as tag, the value."""
    return events(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))


def hourly(spark: SparkSession, sf_dir: str) -> Series:
    """Mean value per hour, one column per event type, NULL where a type is silent."""
    wide = layout.long_to_wide(event_rows_by_hour(spark, sf_dir), "ts", "event_type", "value", "mean", TAGS)
    return timeaxis.to_timeseries(wide, "ts").series


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def daily_orders(spark: SparkSession, sf_dir: str) -> Series:
    days = orders(spark, sf_dir).groupBy(F.col("o_orderdate").alias("ts")).agg(
        F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    return axis.ordinal(days, ["ts"])


def residual_events(spark: SparkSession, sf_dir: str) -> Series:
    s = event_series(spark, sf_dir)
    return s.with_df(s.df.select("ts", ORD, (F.col("value") - FORMULA.expression()).alias("residual")))


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias(ORD), array_to_vector(F.slice(v, 1, dims) if dims else v).alias("features"),
                    "label")


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """For comparison with SQL: rounded doubles, timestamps without a zone."""
    cols = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
