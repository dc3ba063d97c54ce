"""A mix of sources at target weights, dealt to output shards by a splitting tree.

Each source's rows lie in a fixed random order, cut into blocks. A target is met
by whole passes over the order and a part of one more. The blocks so drawn are
an exact quota per source, and a tree of multivariate hypergeometric draws
splits the quotas among the output shards: every shard gets an exact number of
blocks of each source, as if all drawn blocks had been shuffled together. A
permutation of each source's draws says which blocks these are.

The driver sees one row per source and one number per source and shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
BLOCK_ROWS = 256
GROUP = 1_024           # blocks whose sums are added up together
SOURCES = 100_000       # source rows that may be broadcast: some 20 MB with 16 shards


def targets(sizes: dict, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0) -> dict:
    """The words to take of each source: ``share`` of all words by weight, in the
    sources' code-point order with null last; what a source cannot give at
    ``most`` times its size is shared among the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_weight, out = share * sum(sizes.values()), float(sum(weight.values())), {}
    for s in sorted(names, key=lambda s: most * sizes[s] / weight[s]):
        if left / open_weight * weight[s] <= most * sizes[s]:
            break
        out[s] = most * sizes[s]
        left -= out[s]
        open_weight -= weight[s]
    return {s: out.get(s, left / open_weight * weight[s]) for s in names} if open_weight > 0 else out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """shards x sources: the blocks of each source that each shard gets. The tree
    halves the shards; a half with m of n shards takes its m/n of the blocks."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    take = int(quotas.sum()) * half // shards
    left = rng.multivariate_hypergeometric(quotas, take, method="marginals")
    return np.concatenate((split(left, half, rng), split(quotas - left, shards - half, rng)))


def _stride(n: int, rng: np.random.Generator) -> int:
    """A step that meets all of n places."""
    step = int(rng.integers(1, max(2, n)))
    while math.gcd(step, max(1, n)) != 1:
        step += 1
    return step


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def drawn(docs: DataFrame, shards: int = 16, share: float = 1.5, weights: tuple[float, ...] = WEIGHTS,
          most: float = 2.0, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", carry: bool = True) -> DataFrame:
    """Every row with what the mix takes of it.

    Gives _id, _source, _size (words), _source_size, _target and _shards: the
    output shard of each copy, none to ``ceil(most)`` of them. ``carry`` adds the
    whole row as the struct _row, so no column of ``docs`` can clash. A source's taken words differ from its target by half a row at most. Null
    texts have no words, null sources form a source of their own, which is the
    last; a source that is no string is compared as text. Rows are drawn by id and
    text, so null or repeated ids spread as far as their texts differ, and rows
    alike in both are interchangeable. No rows give no rows.
    """
    spark = docs.sparkSession
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(q(id_col)).cast("string"), F.lit("null")),
                       F.md5(F.coalesce(F.col(q(text_col)), F.lit("")).cast("binary")))
    docs = docs.select(
        F.struct(*[F.col(q(c)) for c in docs.columns]).alias("_row"), F.col(q(id_col)).alias("_id"),
        F.col(q(source_col)).cast("string").alias("_source"), word_count(F.col(q(text_col))).alias("_size"),
        F.crc32(F.coalesce(F.col(q(text_col)), F.lit(""))).alias("_crc"), F.md5(name).alias("_draw"))
    thin = docs.select("_id", "_source", "_size", "_draw", "_crc")
    if not carry:
        docs = thin = staging.store(thin, "sizes")
    stats = {r["_source"]: r for r in thin.groupBy("_source").agg(F.sum("_size").alias("words"),
                                                                  F.count(F.lit(1)).alias("rows")).collect()}
    goal = targets({s: r["words"] for s, r in stats.items()}, share, weights, most)
    plan = spark.createDataFrame(
        [(s, r["words"], goal[s], max(1, -(-r["rows"] // BLOCK_ROWS)), *_passes(goal[s], r["words"])) for s, r in stats.items()],
        "_source string, _source_size long, _target double, _blocks int, _whole int, _rest double")

    def known(df: DataFrame, sources: DataFrame) -> DataFrame:
        sources = sources.withColumnRenamed("_source", "_from")
        return df.join(F.broadcast(sources) if len(stats) <= SOURCES else sources,
                       F.col("_source").eqNullSafe(F.col("_from"))).drop("_from")

    block = F.floor(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") * F.col("_blocks") / 2 ** 32).cast("int")
    sums = known(thin, plan).groupBy("_source", "_rest", "_whole", "_blocks", block.alias("_block")).agg(F.sum("_size").alias("_words")) \
        .withColumn("_group", F.floor(F.col("_block") / GROUP))
    of_source, of_group = (Window.partitionBy("_source", *more) for more in ((), ("_group",)))
    groups = sums.groupBy("_source", "_group").agg(F.sum("_words").alias("_sum"))
    groups = groups.select("_source", "_group", (F.sum("_sum").over(of_source.orderBy("_group")) - F.col("_sum")).alias("_base"))
    within = F.sum("_words").over(of_group.orderBy("_block")) - F.col("_words")
    begins = sums.withColumn("_within", within).alias("x").join(
        groups.alias("y"), F.col("x._source").eqNullSafe(F.col("y._source")) & (F.col("x._group") == F.col("y._group"))) \
        .select("x._source", "x._block", "x._rest", "x._whole", "x._blocks", (F.col("_within") + F.col("_base")).alias("_begin"))
    begins = staging.store(begins, "blocks")

    partial = F.col("_begin") < F.col("_rest")
    quotas = {r["_source"]: r["quota"] for r in begins.groupBy("_source", "_whole", "_blocks").agg(
        (F.col("_whole") * F.col("_blocks") + F.coalesce(F.max(F.when(partial, F.col("_block") + 1)), F.lit(0))).alias("quota")).collect()}
    rng = np.random.default_rng(seed)
    names = sorted(stats, key=lambda s: (s is None, (s or "").encode()))
    tree = split(np.array([quotas[s] for s in names], dtype=np.int64), shards, rng) if names else np.zeros((shards, 0), int)
    dealt = spark.createDataFrame(
        [(s, int(quotas[s]), _stride(quotas[s], rng), int(rng.integers(0, max(1, quotas[s]))),
          [int(x) for x in np.cumsum(tree[:, i])]) for i, s in enumerate(names)],
        "_source string, _quota long, _step long, _first long, _cuts array<long>")

    rows = known(known(docs, plan).withColumn("_block", block), dealt)
    begins = begins.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_begin")
    rows = rows.join(begins, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")
    order = Window.partitionBy("_source", "_block").orderBy("_draw", "_id", "_size", "_crc")
    begin = F.col("_begin") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    copies = F.col("_whole") + (2 * begin + F.col("_size") < 2 * F.col("_rest")).cast("int")
    rows = rows.withColumn("_copies", copies)

    def shard(copy: Column) -> Column:
        draw = F.pmod((copy - 1) * F.col("_blocks") + F.col("_block"), F.col("_quota"))
        place = F.pmod(draw * F.col("_step") + F.col("_first"), F.col("_quota"))
        return F.size(F.filter("_cuts", lambda cut: cut <= place))

    shards_of = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(1), F.col("_copies")), shard)) \
        .otherwise(F.array().cast("array<int>"))
    return rows.withColumn("_shards", shards_of).drop(
        "_blocks", "_whole", "_rest", "_block", "_quota", "_step", "_first", "_cuts", "_begin", "_copies")


def _passes(target: float, size: int) -> tuple[int, float]:
    whole = int(target // size) if size else 0
    return whole, target - whole * size


def mixed(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source", **how) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row per copy, shard after shard
    and shuffled within each. See ``drawn`` for what a row is."""
    rows = drawn(docs, shards, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    copies = rows.select("_row", "_draw", F.posexplode("_shards").alias("_copy", "_shard"))
    lot = F.md5(F.concat_ws(":", "_copy", "_draw"))
    return copies.withColumn("_lot", lot).repartitionByRange("_shard", "_lot").sortWithinPartitions("_shard", "_lot") \
        .select("_row.*")
