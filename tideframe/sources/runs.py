"""Run records: tables partitioned by run, saved models, and comparisons."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, is_dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tideframe.operators import blend as B, models as M, neighbours, prep as P, quality, split as SP
from tideframe.operators.axis import Series
from tideframe.operators.scores import HIGHER_IS_BETTER

TABLES = ("leaderboard", "predictions", "provenance", "selection_report", "manifest")
MANIFEST_SCHEMA = "key string, value string"
SWAP_GAIN = 0.02


def as_json(value):
    """What json itself cannot write."""
    if is_dataclass(value):
        return {f.name: getattr(value, f.name) for f in fields(value)}
    return list(value) if isinstance(value, (set, frozenset)) else value.item() if isinstance(value, np.generic) else str(value)


# --- manifests --------------------------------------------------------------------

@dataclass(frozen=True)
class RunParts:
    """What a run was made of, as far as it is known."""

    data: Series | None = None
    split: SP.Split | None = None
    selection: DataFrame | None = None
    unseen: DataFrame | None = None
    configs: dict | None = None
    labels: dict | None = None          # single facts: target, champion, seed, source


def manifest(spark: SparkSession, run: RunParts) -> DataFrame:
    """(key, value): what is needed to know whether two runs were alike."""
    data, split, unseen, selection = run.data, run.split, run.unseen, run.selection
    facts = dict.fromkeys(("target", "champion", "seed")) | {"source": ""} | (run.labels or {})
    rows: list[tuple[str, str | None]] = [("created_at", datetime.now(timezone.utc).isoformat(timespec="seconds"))]
    rows += [(k, None if v is None else str(v)) for k, v in facts.items()]
    if data is not None:
        f = quality.fingerprint(data.df, data.ts).first()
        rows += [("dataset.fingerprint", f["fingerprint"]), ("dataset.rows", str(f["rows"])),
                 ("dataset.columns", f["schema"]), ("dataset.start", str(f["start"])), ("dataset.end", str(f["end"]))]
    if split is not None and data is not None:
        for r in SP.describe(data, split).collect():            # at most three parts
            rows.append((f"split.{r['part']}", f"{r['rows']} rows, {r['start']} to {r['end']}"))
    for name, cfg in (run.configs or {}).items():
        settings = json.loads(json.dumps(cfg, default=as_json))
        rows += [(f"config.{name}.{k}", json.dumps(v, ensure_ascii=False)) for k, v in settings.items()]
    if unseen is not None and unseen.columns:
        r = unseen.first()
        rows += [(f"final.{k}", None if v is None else repr(v)) for k, v in (r.asDict() if r else {}).items()]
    out = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    if selection is not None:
        status = F.col("status")
        prefix = F.when(status.contains("manual"), F.lit("feature.manual.")) \
                  .when(status.startswith("selected"), F.lit("feature.selected.")).otherwise(F.lit("feature.excluded."))
        out = out.unionByName(selection.select(F.concat(prefix, F.col("feature")).alias("key"),
                                               F.concat_ws(": ", "status", "reason").alias("value")))
    return out


def compare_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b, equal) over the keys of both."""
    left = a.select("key", F.col("value").alias("a"))
    right = b.select("key", F.col("value").alias("b"))
    return left.join(right, "key", "full").withColumn("equal", F.col("a").eqNullSafe(F.col("b"))).orderBy("key")


# --- run tables -------------------------------------------------------------------

def save_run(root: str, run_id: str, tables: dict[str, DataFrame], model=None) -> None:
    """Each table gets a partition of its own for the run; saving again replaces it."""
    unknown = set(tables) - set(TABLES)
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")
    for name, df in tables.items():
        (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root}/{name}"))
    if model is not None:
        save_model(model, f"{root}/models/{run_id}")


def load_table(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.option("mergeSchema", True).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
    df = df.withColumn("run_id", F.col("run_id").cast("string"))
    return df.where(F.col("run_id") == run_id).drop("run_id") if run_id is not None else df


def load_run(spark: SparkSession, root: str, run_id: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    out = {}
    for name in names:
        try:
            out[name] = load_table(spark, root, name, run_id)
        except Exception as e:  # a run need not have every table
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return out


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, created_at, champion, target), newest first."""
    m = load_table(spark, root, "manifest")
    wide = m.groupBy("run_id").pivot("key", ["created_at", "champion", "target"]).agg(F.first("value"))
    return wide.orderBy(F.desc("created_at"), F.desc("run_id"))


def challenge(current: DataFrame, challenger: DataFrame, metric: str = "R2", threshold: float = SWAP_GAIN) -> DataFrame:
    """(champion, challenger, scores, gain, decision, same_data) from two manifests.

    The champion is replaced for a relative gain of at least ``threshold`` on
    the unseen part; scores of different data are flagged.
    """
    def side(m: DataFrame, name: str) -> DataFrame:
        def value(key: str):
            return F.max(F.when(F.col("key") == key, F.col("value")))
        return m.agg(value("champion").alias(name), value(f"final.unseen_{metric}").try_cast("double").alias(f"{name}_score"),
                     value("dataset.fingerprint").alias(f"{name}_data"))

    both = side(current, "champion").crossJoin(side(challenger, "challenger"))       # one row on each side
    return decide(both, metric, threshold).withColumn(
        "same_data", F.col("champion_data").eqNullSafe(F.col("challenger_data"))).drop("champion_data", "challenger_data")


def decide(both: DataFrame, metric: str = "R2", threshold: float = SWAP_GAIN) -> DataFrame:
    """Adds ``gain`` and ``decision`` to rows with champion_score and challenger_score."""
    diff = F.col("challenger_score") - F.col("champion_score")
    if not HIGHER_IS_BETTER.get(metric, True):
        diff = -diff
    gain = F.try_divide(diff, F.abs("champion_score"))
    verdict = F.when(gain.isNull(), "undecided").when(gain >= threshold, "replace").otherwise("keep")
    return both.withColumns({"gain": F.bround(gain, 4), "decision": verdict})


# --- models -------------------------------------------------------------------------

def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value, default=as_json, ensure_ascii=False),)], "value string") \
         .coalesce(1).write.mode("overwrite").text(path)


def _read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()["value"])


def save_model(pipe, path: str) -> None:
    spark = SparkSession.active()
    if isinstance(pipe, B.Blend):
        _write_json(spark, f"{path}/meta", {"kind": "blend", "name": pipe.name, "weights": list(pipe.weights),
                                            "intercept": pipe.intercept, "task": pipe.task, "members": list(pipe.members)})
        for i, member in enumerate(pipe.members.values()):
            save_model(member, f"{path}/member{i}")
        return
    prepared = pipe.prepared
    _write_json(spark, f"{path}/meta", {
        "kind": "pipeline", "model": pipe.spec.name, "params": pipe.params, "names": prepared.names,
        "target": prepared.target, "task": prepared.task, "classes": prepared.classes,
        "context": prepared.context, "prep": prepared.prep.params(), "prep_config": prepared.prep.cfg,
        "level_tables": sorted(prepared.prep.level_tables)})
    for i, c in enumerate(sorted(prepared.prep.level_tables)):
        prepared.prep.level_tables[c].write.mode("overwrite").parquet(f"{path}/levels{i}")
    if isinstance(pipe.model, M.KnnModel):
        cells = pipe.model.cells
        _write_json(spark, f"{path}/cells", {"k": pipe.model.k, "payload": pipe.model.payload, "weights": pipe.model.weights, "tops": cells.tops.tolist(),
                                             "reach": cells.reach.tolist(), "chunks": cells.chunks.tolist()})
        cells.table.write.mode("overwrite").parquet(f"{path}/cell_table")
        pipe.model.base.write.mode("overwrite").parquet(f"{path}/base")
    else:
        PipelineModel([pipe.model]).write().overwrite().save(f"{path}/ml")


def load_model(spark: SparkSession, path: str):
    meta = _read_json(spark, f"{path}/meta")
    if meta["kind"] == "blend":
        members = {n: load_model(spark, f"{path}/member{i}") for i, n in enumerate(meta["members"])}
        return B.Blend(meta["name"], members, np.array(meta["weights"]), meta["intercept"], meta["task"])
    cfg = dict(meta["prep_config"])
    cfg["clip_quantiles"] = tuple(cfg["clip_quantiles"])
    params = meta["prep"]
    fitted = P.FittedPrep(params["numeric"], params["categorical"], P.PreprocessConfig(**cfg), params["fill"],
                          {k: tuple(v) for k, v in params["clip"].items()}, params["centre"], params["scale"],
                          params["modes"], params["levels"],
                          {c: spark.read.parquet(f"{path}/levels{i}") for i, c in enumerate(meta["level_tables"])})
    prepared = M.Prepared(fitted, meta["names"], meta["target"], meta["task"], meta["classes"],
                          M.FitContext(**meta["context"]), None)
    spec = M.ZOO[meta["model"]]
    if spec.name == "KNN":
        c = _read_json(spark, f"{path}/cells")
        cells = neighbours.Cells(np.array(c["tops"]), np.array(c["reach"]), np.array(c["chunks"]), spark.read.parquet(f"{path}/cell_table"))
        model = M.KnnModel(c["k"], meta["task"], spark.read.parquet(f"{path}/base"), cells, c["payload"],
                           c.get("weights", "uniform"))
    else:
        model = PipelineModel.load(f"{path}/ml").stages[0]
    return M.FittedPipeline(spec, prepared, model, meta["params"])
