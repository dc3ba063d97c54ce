"""Sharding and mixing."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tideframe.llm import mixing, sharding


def test_shards_follow_the_key_and_slots_are_gapless(spark):
    rows = [(i, f"t{i}") for i in range(3000)] + [(5, "t5"), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.assign(df, 7, "doc_id", ("text",)).collect()
    for r in got:
        name = "\0null" if r["doc_id"] is None else str(r["doc_id"])
        key = int(hashlib.md5(name.encode()).hexdigest()[:16], 16)
        assert r["shard"] == brute.jump(key, 7) and r["grown_shard"] == brute.jump(key, 8)
        assert r["grown_shard"] in (r["shard"], 7)
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.assign(df.limit(0), 7).count() == 0


def test_growing_moves_only_the_new_share():
    keys = np.random.default_rng(1).integers(0, 2 ** 63, 100_000).astype(np.uint64)
    for n in (1, 2, 10, 100):
        old, new = sharding.jump(keys.copy(), n), sharding.jump(keys.copy(), n + 1)
        moved = old != new
        assert (new[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.01
        assert np.bincount(new).std() < 4 * np.sqrt(len(keys) / (n + 1))


def test_targets_fill_up():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 0})
    # a weighs 3, b 1, c 2, null 3: of 1665, a takes 20, c nothing, b and null share 1645 by 1 to 3; b holds 200.
    assert got == {"a": 20, "c": 0, "b": 200, None: 1445}
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0}


def test_tree_deals_exact_quotas():
    rng = np.random.default_rng(0)
    quotas = np.array([500, 3, 0, 97])
    deals = [mixing.split(quotas, 6, rng) for _ in range(300)]
    for d in deals:
        assert (d.sum(0) == quotas).all() and d.sum(1).max() - d.sum(1).min() <= 2 and (d >= 0).all()
    assert np.allclose(np.mean(deals, 0), quotas / 6, atol=2.0)


def test_mix_is_near_its_targets_and_repeatable(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 8)
    monkeypatch.setattr(mixing, "GROUP", 4)
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randrange(1, 30)), rng.choice(["a", "a", "a", "b", "Z", None])) for i in range(900)]
    rows += [(1, None, "a"), (1, "", "b"), (None, "x y", "b"), (None, "x y", "b"), (2, "w " * 9000, "a"), (3, None, "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string") \
        .withColumn("_size", F.lit(1)).withColumn("_shards", F.lit("clash"))
    got = mixing.drawn(docs, shards=5, carry=False).collect()
    again = mixing.drawn(docs.repartition(7), shards=5, carry=False).collect()
    key = lambda r: (str(r["_id"]), r["_size"], str(r["_source"]), sorted(r["_shards"]))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    for s in {r["_source"] for r in got}:
        own = [r for r in got if r["_source"] == s]
        taken = sum(r["_size"] * len(r["_shards"]) for r in own)
        assert abs(taken - own[0]["_target"]) <= max(r["_size"] for r in own) / 2 + 1
        assert own[0]["_target"] <= 2 * own[0]["_source_size"] and all(len(r["_shards"]) <= 2 for r in own)
    out = mixing.mixed(docs, shards=5)
    assert out.columns == docs.columns and out.count() == sum(len(r["_shards"]) for r in got)
    assert mixing.mixed(docs.limit(0)).count() == 0
