"""Near duplicates by bottom-k sketches under one hash function.

Every distinct shingle set is one node. A node's sketch holds the k smallest
hashes of its set. Two sets of Jaccard similarity ``percent`` share so much of
their sketches that some retained values are neighbours in both, and of the
rarest such neighbours, less as many as they are sure to share, one at least is
common. Only these go to inverted lists. Lists yield pairs of a member and one
of the list's few most central members, the union sketch of a pair estimates its
similarity, and full sets confirm it. A list whose members are then still in
several components is compared further: the members outside its main component
against all, in blocks of bounded size on both sides, which return nodes and
spanning links, never pairs. So large groups cost rows in proportion to their
size, and no link that the lists hold is left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm import text as tx
from tideframe.llm.graph import components

K = 64
HUBS = 8
FEW_HUBS = 3
PART = 256
SMALL = 2_000_000       # rows of (id, hash) that may be broadcast: some 50 MB


def floor_of(percent: int, k: int = K) -> float:
    p = percent / 100
    return max(0.05, p - 6 * math.sqrt(p * (1 - p) / k))


def _node(shingles: np.ndarray) -> bytes:
    other = tx.mix(shingles.view(np.uint64) ^ np.uint64(0x9FB21C651E98DF25))
    return b"".join(int(x.sum(dtype=np.uint64)).to_bytes(8, "big") for x in (shingles.view(np.uint64), other))


def _sets(part: pa.RecordBatch, width: int) -> list[np.ndarray]:
    data, offsets = tx.utf8(part.column(part.schema.get_field_index("text")))
    begin, end, first = tx.spans(data, offsets)
    return list(tx.shingles(tx.folded_hashes(data, begin, end), first, width))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tk, n_shingles, node, sketch) of rows (doc_id, text): node names the
    shingle set with 128 bits, null where it is empty; tk is a hash of the text."""
    source = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")

    def sign(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = _sets(part, width)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in found], pa.int64()),
                     pa.array([_node(s) if len(s) else None for s in found], pa.binary()),
                     tx.long_list([s[:K] for s in found])], ["doc_id", "tk", "n_shingles", "node", "sketch"])

    return tx.small_batches(source).mapInArrow(sign, T.StructType([source.schema["doc_id"]]).add("tk", "long").add("n_shingles", "long")
                             .add("node", "binary").add("sketch", T.ArrayType(T.LongType())))


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole sets of ``nodes``, read again from one text of each."""
    own = staging.store(nodes.select(F.col("rep.doc_id").alias("_id"), F.col("rep.tk").alias("_tk")), "wanted")
    if own.count() <= SMALL:
        own = F.broadcast(own)
    source = docs.withColumn("tk", F.xxhash64("text"))
    source = source.join(own, (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def read(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = [s for s in _sets(part, width) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.binary()), tx.long_list(found)],
                                                 ["node", "shingles"])

    sets = tx.small_batches(source).select("text").mapInArrow(read, "node binary, shingles array<bigint>")
    return staging.store(sets.dropDuplicates(["node"]), "sets")


def sure_of(percent: int, length: Column) -> Column:
    """Neighbours in the sketch that two linked sets have in common at least.

    Sets that fit the sketch lose one neighbourhood of their common part for each
    of the at most ``1 - p`` other members. Of larger sets the union's k smallest
    hold mean k * p**2 common neighbours, less six standard deviations here.
    """
    p = percent / 100
    large = max(1, math.floor(K * p ** 2 - 6 * math.sqrt(K * (p ** 2 + 2 * p ** 3 - 3 * p ** 4))))
    return F.greatest(F.lit(1), F.least(F.lit(large), F.floor(length * (2 * p - 1) - 1).cast("int")))


def inverted(nodes: DataFrame, percent: int) -> DataFrame:
    """(v, df, node, weight): what nodes meet on, where at least two do.

    A list is named by two retained values that are neighbours in a sketch. Alone
    common values would bring unrelated texts together as the corpus grows.
    """
    sketch, len_ = F.col("sketch"), F.size("sketch")
    pairs = F.zip_with(F.slice(sketch, 1, len_ - 1), F.slice(sketch, 2, len_ - 1), lambda x, y: F.xxhash64(x, y))
    values = nodes.where(len_ > 1).select("node", (len_ - 1).alias("many"), sure_of(percent, len_).alias("sure"),
                                          F.explode_outer(pairs).alias("v"))
    shared = values.join(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "v")
    rarest = shared.groupBy("node", "many", "sure").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"),
                                                        F.sum("df").alias("weight"))
    take = F.size("vs") + 1 - F.col("sure")
    lists = rarest.where(take > 0).select("node", "weight", F.explode(F.slice("vs", 1, take)).alias("x"))
    return staging.store(lists.select("x.v", "x.df", "node", "weight"), "inverted")


def hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each list's members with its most central ones, those whose sketches hold the
    commonest values. Lists of up to HUBS + 1 members yield all their pairs, longer ones
    have FEW_HUBS. A limited rank is taken map-side first, so no task sorts a whole list."""
    best = Window.partitionBy("v").orderBy(F.desc("weight"), "node")
    rank = F.row_number().over(best)
    tops = lists.withColumn("rank", rank).where(F.col("rank") <= HUBS) \
        .where((F.col("rank") <= FEW_HUBS) | (F.col("df") <= HUBS + 1))
    hubs = tops.groupBy("v").agg(F.sort_array(F.collect_list("node")).alias("hubs"))
    met = lists.select("v", "node").join(hubs, "v").groupBy(F.col("node").alias("a")).agg(F.collect_set("hubs").alias("hubs"))
    return met.select("a", F.explode(F.array_distinct(F.flatten("hubs"))).alias("b")).where("a <> b")


def _two(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}")), side)
    return pairs


def estimated(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The pairs whose union sketch, the k smallest of both, lies in both for ``floor`` at least."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, K)
    both = F.array_intersect(F.array_intersect("sketch_a", "sketch_b"), union)
    return _two(pairs, nodes, "sketch").where(F.size(both) >= floor * F.size(union)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - both
    return _two(pairs, sets, "shingles").where(both * 100 >= union * percent).select("a", "b")


def _common(one: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of one sorted set with the sets that ``flat`` strings together."""
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def crossed(members: DataFrame, table: DataFrame, column: str, least: float, spanning: bool) -> DataFrame:
    """Members outside the main component of their group against all of it.

    ``members`` (main, node, label, outer) meet in blocks. Returns the spanning links
    (a, b) of each block, by the full sets; or, by sketches, (main, node) of all that
    share ``least`` of the smaller sketch with any, which linked sets do.
    """
    counts = members.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"),
                                         F.ceil(F.sum(F.col("outer").cast("int")) / PART).cast("int").alias("outs"))
    rows = members.join(table.select("node", F.col(column).alias("values")), "node").join(counts, "main")
    salt = F.xxhash64("node")
    left = rows.where("outer").select("main", F.pmod(salt, "outs").cast("int").alias("out"), "node", "label", "values",
                                      F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = rows.select("main", F.pmod(salt, "parts").cast("int").alias("part"), "node", "label", "values",
                        F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("out"))

    def compare(key, one: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(all_):
            return pd.DataFrame({"a": [], "b": []})
        main, nodes, labels, sets = key[0], all_["node"].to_numpy(), all_["label"].to_numpy(), list(all_["values"])
        joined: dict = {}

        def root(x):
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        found, touched = [], {}
        flat, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        for node, label, own in zip(one["node"], one["label"], one["values"]):
            both = _common(own, flat, starts)
            whole = sizes + len(own) - both if spanning else np.minimum(sizes, len(own))
            for i in np.flatnonzero((both >= least * whole - 1e-9) & (labels != label)):
                touched[node] = touched[nodes[i]] = True
                a, b = root(label), root(labels[i])
                if spanning and a != b:
                    joined[a] = b
                    found.append((node, nodes[i]))
        if not spanning:
            return pd.DataFrame({"a": [main] * len(touched), "b": list(touched)})
        return pd.DataFrame(found, columns=["a", "b"])

    keys = ["main", "out", "part"]
    left = left.toDF(*left.columns)     # else both sides share their columns' identities
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a binary, b binary")


def unsettled(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(main, node, label, outer) of the lists that lie in several components and
    were too long to yield all their pairs; main is the list's commonest component."""
    rows = lists.where(F.col("df") > HUBS + 1).select("v", "node").join(labels, "node", "left") \
        .select("v", "node", F.coalesce("component", "node").alias("label"))
    mains = rows.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("v") \
        .agg(F.max(F.struct("n", "label")).getField("label").alias("main"), F.count(F.lit(1)).alias("labels"))
    return rows.join(mains.where("labels > 1"), "v").groupBy("main", "node", "label").agg(
        F.max(F.col("label") != F.col("main")).alias("outer"))


def links(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between distinct sets, enough of them to hold every component together."""
    floor = floor_of(percent)
    lists = inverted(nodes, percent)
    pairs = staging.store(estimated(hub_pairs(lists), nodes, floor), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = full_sets(docs, nodes.join(ends, "node", "left_semi"), width)
    first = staging.store(confirmed(pairs, sets, percent), "links")
    members = staging.store(unsettled(lists, components(first)), "members")
    if members.isEmpty():
        return first
    near = staging.store(crossed(members, nodes, "sketch", floor, False).distinct(), "near")
    members = staging.store(members.join(near.select(F.col("a").alias("main"), F.col("b").alias("node")),
                                         ["main", "node"]), "members")
    if members.isEmpty():
        return first
    sets = full_sets(docs, nodes.join(members, "node", "left_semi"), width)
    return first.union(staging.store(crossed(members, sets, "shingles", percent / 100, True), "links"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are split at ASCII white space and A-Z lower-cased. Rows with
    ``100 * intersection >= percent * union`` of their distinct shingles are
    linked, and component_id is the smallest id reachable by links; kept marks
    the row that has it. A text with fewer words than ``width`` is one shingle.
    Null and empty texts have no shingles and link with nothing. Repeated rows
    share a set and so a component; where the smallest id repeats, each of its
    rows is kept. Null ids never name a component unless it holds no other; its
    rows are then kept. No rows give no rows. Other columns are not read.
    """
    out = _grouped(docs, width, percent, id_col, text_col)
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tk, n_shingles, node, rep) for every row. rep names one text of the row's component:
    (none, doc_id, tk) with the smallest id, a null id last, and of its texts the smallest tk."""
    docs = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).alias("text"))
    rows = staging.store(signatures(docs, width), "signatures")
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    nodes = staging.store(rows.where("node is not null").groupBy("node").agg(
        F.min(rep).alias("rep"), F.first("sketch").alias("sketch")), "nodes")
    found = components(links(docs, nodes, width, percent))
    named = nodes.select("node", "rep").join(found, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("rep"))
    of = named.drop("rep").join(least, "component").select("node", "rep")
    return rows.select("doc_id", "tk", "n_shingles", "node").join(of, "node", "left")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns.

    A row is known by its id and a hash of its text, so texts that share an id, or
    have none, are each in their own group; of rows alike in both any one stays.
    Null and empty texts are in no group and all stay. No rows give no rows.
    """
    id_, tk = tx.unused(docs, "_id", "_tk")
    stays = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tk") == F.col("rep.tk"))
    found = staging.store(_grouped(docs, width, percent, id_col, text_col).where("node is not null").select(
        F.col("doc_id").alias(id_), F.col("tk").alias(tk), stays.alias("stays")), "groups")
    same = F.col(q(id_col)).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(q(text_col))) == F.col(tk))
    kept = docs.join(_few(found.where("not stays").select(id_, tk).distinct()), same, "left_anti")
    again = _few(found.where("stays").groupBy(id_, tk).count().where("count > 1").select(id_, tk))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def _few(ids: DataFrame) -> DataFrame:
    ids = staging.store(ids, "ids")
    return F.broadcast(ids) if ids.count() <= SMALL else ids
