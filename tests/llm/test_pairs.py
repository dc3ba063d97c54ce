"""Near duplicates of texts and vectors, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tideframe.llm import crosspoly, graph, minhash

SF = "/root/testdata/sf0.001"


def edited(words: list[str], share: float, rng: random.Random) -> str:
    return " ".join(rng.choice("abcdefgh") * 5 + str(rng.randrange(10 ** 6)) if rng.random() < share else w for w in words)


def corpus(rng: random.Random, copies: int) -> list[tuple]:
    words = [f"w{rng.randrange(400)}" for _ in range(160)]
    rows = [(i, edited(words, rng.choice([0.0, 0.01, 0.02, 0.04, 0.06, 0.1]), rng)) for i in range(copies)]
    rows += [(copies + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120)))) for i in range(120)]
    rows += [(2000 + i, t) for i, t in enumerate([None, "", "   ", "one", "ONE", "one two", "One  Two", "\n", "two one"])]
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_texts_are_linked_as_by_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(minhash, "PART", 16)        # blocks of a large group
    monkeypatch.setattr(minhash, "HUBS", 2)
    monkeypatch.setattr(minhash, "FEW_HUBS", 1)
    rows = corpus(random.Random(width), 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("kept", F.lit(1))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, width).collect()}
    assert got == brute.near_duplicates(rows, width, 80)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, "z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted([
        ("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "None", True), ("None", "None", True)])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    left = minhash.deduplicated(docs.withColumn("kept", F.lit(7)))
    assert left.columns == ["doc_id", "text", "kept"]
    assert left.where("doc_id is not null").count() == 1


def test_repeated_and_null_ids_lose_no_text_and_keep_no_copy(spark):
    a, b, c, d, e = ("".join(f"{x}{i} " for i in range(30)) for x in "abcde")
    rows = [(3, b), (5, a), (5, b), (7, c), (7, d), (7, c), (7, c + "more"), (8, None), (8, None), (None, a), (None, e), (None, e),
            (None, e.upper()), (None, "")]
    left = minhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    groups = {a: "a", b: "b", c: "c", c + "more": "c", d: "d", e: "e", e.upper(): "e"}
    got = sorted((str(r["doc_id"]), str(groups.get(r["text"], r["text"]))) for r in left)
    assert got == sorted([("3", "b"), ("5", "a"), ("7", "c"), ("7", "d"), ("None", "e"), ("8", "None"), ("8", "None"), ("None", "")])


def test_one_very_long_text(spark):
    long = " ".join(str(i) for i in range(400_000))
    docs = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 3_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == {1: (399_996, 1), 2: (399_997, 1), 3: (1, 3)}


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, **{200 + i: 100 for i in range(50)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_are_linked_as_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(crosspoly, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 20))
    rows = [(i, (centre[i % 6] + rng.normal(size=20) * rng.choice([0.02, 0.15, 0.3])).tolist()) for i in range(240)]
    rows += [(300 + i, (2.5 * centre[0]).tolist()) for i in range(60)]
    rows += [(400, None), (401, []), (402, [0.0] * 20), (403, [float("nan")] + [1.0] * 19), (404, [float("inf")] * 20),
             (405, [None] + [1.0] * 19), (406, [1.0, 2.0]), (407, [2.0, 4.0]), (408, [1e-300] * 20), (409, [1e300] * 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in crosspoly.near_vectors(df, miss=1e-6).collect()}
    want = brute.near_vectors([r for r in rows if r[0] not in (408, 409)], 0.95)
    assert got.pop(408) == (1, 408) and got.pop(409) == (1, 408)
    assert got == want
    assert crosspoly.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_the_table_reach_the_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = {r["vec_id"]: r["n_links"] for r in crosspoly.near_vectors(df).collect()}
    want = {i: n for i, (n, _) in brute.near_vectors(rows, 0.95).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.99 * sum(want.values())
