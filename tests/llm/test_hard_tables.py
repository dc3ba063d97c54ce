"""Texts made to collide, clashing column names, and odd tables through every stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from tideframe import staging
from tideframe.llm import linededup, minhash, mixing, sharding, urlfilter

SF = "/root/testdata/sf0.001"
CLASHES = ("_id", "_tk", "_ID_", "_bad", "_cell", "_before", "_fit", "_row", "_source", "_size", "_draw", "_shard", "_lot", "node", "rep", "kept",
           "tk", "n", "stays", "_stays", "shard", "slot", "h", "seed", "met")


def two_symbol_runs(size: int) -> tuple[str, str]:
    """A Thue-Morse run and its complement, which polynomials modulo 2**64 cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [64, 2048])
def test_patterned_texts_do_not_collide(spark, size):
    one, two = two_symbol_runs(size)
    docs = spark.createDataFrame([(1, f"x {one}"), (2, f"x {two}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 2).collect()} == {1: 1, 2: 2}
    lines = spark.createDataFrame([(i, one) for i in range(3)] + [(i, two) for i in range(3, 6)], "doc_id long, text string")
    out = linededup.cleaned(lines, linededup.build(lines, min_docs=5, min_chars=40))
    assert out.agg(F.sum("n_dropped")).first()[0] == 0


def test_hashes_of_spans():
    import numpy as np

    from tideframe.llm import text as tx
    rng = np.random.default_rng(0)
    pieces = [bytes(rng.integers(33, 127, n, dtype=np.uint8)) for n in [*range(1, 40), 511, 512, 513, 3000] for _ in range(3)]
    data = np.frombuffer(b" ".join(pieces * 2 + [p.swapcase() for p in pieces]), dtype=np.uint8)
    begin, end, _ = tx.spans(data, np.array([0, len(data)]))
    found = tx.folded_hashes(data, begin, end)
    names = [bytes(data[b:e]).lower() for b, e in zip(begin, end)]
    assert len(set(zip(names, found.tolist()))) == len(set(names)) == len(set(found.tolist()))
    assert not set(found.tolist()) & set(tx.folded_hashes(data, begin, end, 1).tolist())


def odd(spark):
    long_ = " ".join(f"word{i}" for i in range(40))
    rows = [(None, None, "en", None, 0), (None, "", None, "a", 0), (None, long_, "en", None, 1), (None, long_, "en", None, 1), (3, long_, "de", "b", 1),
            (3, long_, "de", "b", 1), (3, long_ + " other", "de", "b", 1), (4, " ".join(f"w{i * 7 % 1000}" for i in range(30_000)), "fr", "a", 9),
            (5, "clown trash scum", "en", "a", 2), (6, "ordinary words about a quiet river", "en", "c", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("case", ["clashes", "empty", "source is a number"])
def test_every_stage_takes_odd_tables(spark, case):
    docs = odd(spark)
    if case == "clashes":
        docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])
    elif case == "empty":
        docs = docs.limit(0)
    else:
        docs = docs.withColumn("source", F.length("source"))
    had = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = staging.store(stage(spark, docs, SF), name)
        assert name == "sharding" or out.columns == had
        if case == "empty":
            assert out.count() == 0
        elif name == "near_duplicates":
            texts = [r["text"] for r in out.collect()]
            assert sum((t or "").startswith("word0") for t in texts) == 1 and None in texts and "" in texts
        elif name != "mixing":
            assert out.count() > 0
        docs = out


def test_columns_of_the_user_survive(spark):
    rows = spark.createDataFrame([(i, str(i), "net") for i in range(50)], "doc_id long, text string, _cell string") \
        .withColumns({"_before": F.lit("b"), "_fit": F.lit("f"), "url": F.lit("http://a.net/x")})
    out = sharding.assign(rows, 3, ties=("text",))
    assert set(rows.columns) <= set(out.columns) and out.where("_cell = 'net' and _before = 'b'").count() == 50
    per = {r["shard"]: (r["n"], r["s"]) for r in out.groupBy("shard").agg(F.count("*").alias("n"), F.collect_set("slot").alias("s")).collect()}
    assert all(sorted(s) == list(range(n)) for n, s in per.values())
    judged = urlfilter.judge(rows, [urlfilter.Rule("net", "/", "block"), urlfilter.Rule("net", "/", "allow")])
    assert judged.where("_fit = 'f' and verdict = 'block'").count() == 50


def test_one_key_spreads_over_cells_and_blocks(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text"), F.lit(7).alias("source"))
    out = sharding.assign(rows, 2, ties=("text",))
    assert out.select("shard").distinct().count() == 1 and out.select("slot").distinct().count() == 4000
    got = mixing.drawn(rows, shards=4, carry=False)
    assert got.select("_draw").distinct().count() == 4000
    taken = got.agg(F.sum(F.size("_shards") * F.col("_size")), F.first("_target")).first()
    assert abs(taken[0] - taken[1]) <= 2


def test_shards_of_the_mix_hold_their_share_of_each_source(spark):
    """The tree gives a shard whole blocks; each shard's blocks of a source differ little from an even deal."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"),
                                      F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = mixing.drawn(rows, shards=4, carry=False).select("_source", F.explode("_shards").alias("s")).groupBy("_source", "s").count().collect()
    for source in ("a", "b"):
        counts = [r["count"] for r in got if r["_source"] == source]
        assert len(counts) == 4 and max(counts) < 2 * min(counts)
    whole = [sum(r["count"] for r in got if r["s"] == s) for s in range(4)]
    assert max(whole) - min(whole) < 3 * mixing.BLOCK_ROWS
