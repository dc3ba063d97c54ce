"""Headline operators at BENCH_SF_DIR on local[BENCH_CPUS]; one JSON line out."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from tideframe import staging
from tideframe.operators import (advice, axis, diagnose as D, features as FE, gram, models as M, prep as P,
                                 quality, ranges as RG, select as S, split as SP, timeaxis)
from tideframe.plans import inputs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "4")
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", str(2 * int(CPUS)))
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "7g"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, fn):
        start = time.perf_counter()
        out = fn()
        took[name] = round(time.perf_counter() - start, 3)
        return out

    lines = inputs.table(spark, SF_DIR, "lineitem")
    run(lines)                                           # warm the reader and the JVM
    holes = lines.withColumns({c: F.when(F.xxhash64("l_orderkey", "l_linenumber", F.lit(i)) % 10 != 0, F.col(c))
                               for i, c in enumerate(LINE)})
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *LINE]
    dated = lines.withColumn("ts", F.col("l_shipdate").cast("timestamp"))
    series = timed("ordinal_lineitem", lambda: axis.ordinal(dated.select("ts", *order), order, settled=True))
    events = timed("ordinal_events", lambda: inputs.event_series(spark, SF_DIR))
    cfg = FE.FeatureConfig(ewm_spans=(), diffs=(), time_features=False)
    timed("features_events", lambda: run(FE.generate(events, "k", ["value", "user_id"], cfg).series.df))
    timed("features_lineitem", lambda: run(FE.generate(series, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"],
                                                       cfg).series.df))
    timed("ewm_events", lambda: run(FE.ewm(events, ["value"], [12])))
    timed("wide_from_long", lambda: run(inputs.hourly(spark, SF_DIR).df))
    timed("profile_events", lambda: run(quality.profile(events, ["value", "user_id", "event_type", "k"])))
    timed("gram_no_nulls", lambda: run(gram.correlations(lines, LINE)))
    timed("gram_nulls", lambda: run(gram.correlations(holes, LINE)))
    timed("mutual_information", lambda: run(S.mutual_information(lines, ["l_quantity", "l_discount", "l_tax"],
                                                                "l_extendedprice")))
    timed("lag_scan_17", lambda: run(advice.lag_scan(events, "value", ["user_id", "k"], 288)))
    timed("autocorrelation", lambda: run(advice.autocorr_profile(events, "value")))
    timed("ffill_holes", lambda: run(axis.last_seen(
        series.with_df(series.df.withColumn("l_tax", F.when(F.col(axis.ORD) % 7 == 0, F.col("l_tax")))),
        {"l_tax": F.col("l_tax")})))
    timed("split_audit", lambda: run(SP.audit(series, SP.rolling_origin(series.n, 5, 24))))

    def ridge_folds() -> None:
        fit = M.FitConfig(prep=P.PreprocessConfig("median"))
        folds = SP.rolling_origin(series.n, 5, 24)
        learnt = RG.ridge_ranges(series, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], [f.train for f in folds], fit)
        run(RG.predict_ranges(series, "l_extendedprice", [(f.number, m, f.test) for f, m in zip(folds, learnt)]))

    timed("ridge_5_folds", ridge_folds)
    res = series.with_df(series.df.select("ts", axis.ORD, (F.col("l_extendedprice") - F.col("l_quantity") * 2000)
                                          .alias("residual")))
    timed("drift_table", lambda: run(D.drift_table(res)))
    timed("rolling_residuals", lambda: run(D.rolling_stats(res)))
    timed("gap_report", lambda: run(timeaxis.gap_report(events)))
    staging.release(spark)
    spark.stop()
    print(json.dumps({"metric": "headline operators, total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
