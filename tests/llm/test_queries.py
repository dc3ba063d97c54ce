"""Queries against their SQL, and the pipeline stage by stage against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tideframe import staging
from tideframe.llm import decontaminate, mixing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "benchmark", "labels"):
        out.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return out


def ordered(rows) -> list:
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = db.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    assert ordered(got.select(columns).collect()) == ordered(want.select(*columns).fetchall())


def test_all_queries_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(queries.SQL) <= set(entry.oracle_sql())


def test_pipeline_stage_by_stage(spark, db):
    docs = queries.table(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(staging.store(stage(spark, kept[-1], SF), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]

    scores = toxicity.score(docs, queries.toxicity_model(docs, queries.table(spark, SF, "labels")))
    assert ids[1] == sorted(r["doc_id"] for r in scores.where("score < 0.5").collect())
    rows = [(r["doc_id"], r["text"]) for r in kept[1].collect()]
    assert ids[2] == sorted(i for i, (_, c) in brute.near_duplicates(rows, 5, 80).items() if i == c)
    db.register("left_docs", kept[2].toPandas())
    bad = db.sql(queries.SQL["op8_decontamination"].replace("FROM documents", "FROM left_docs")).fetchall()
    assert ids[3] == sorted(set(ids[2]) - {r[0] for r in bad})
    db.register("pure_docs", kept[3].toPandas())
    taken = db.sql(queries.SQL["op10_mixing"].replace("FROM documents", "FROM pure_docs")).fetchall()
    copies = {r["_id"]: len(r["_shards"]) for r in mixing.drawn(kept[3], carry=False).collect()}
    assert all(t == copies[i] * n for i, n, _, _, t in taken)
    assert ids[4] == sorted(i for i, n in copies.items() for _ in range(n))
    assert ids[5] == ids[4]
    last = kept[5].withColumn("again", sharding.shard_of(F.col("doc_id"), queries.SHARDS))
    assert last.where("shard <> again").count() == 0
    assert decontaminate.hits(kept[5], queries.table(spark, SF, "benchmark")).count() == 0
