"""Agglomerative clusters by single linkage, as joins.

Equal vectors are one point. In each round every cluster finds its nearest point
outside itself and all clusters merge along these links at once, so the rounds
grow with the logarithm of the number of points. Links are ordered by (distance,
smaller point, greater point); this order is strict, so the links form one tree
whatever the partitioning, and two clusters that choose each other chose the
same link.

A point remembers the nearest outsider it found, or a distance below which there
is none. It searches again only when that outsider has joined its cluster and
its cluster has no shorter link from elsewhere; cells that lie wholly in its own
cluster are left out. What the cells rule out depends on the dimension, as for
every neighbour join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from tideframe import staging
from tideframe.operators import axis, neighbours, tiles
from tideframe.operators.axis import ORD

LINK = "struct<dist: double, lo: bigint, hi: bigint>"
NEAREST = 16            # links that a long vector lists at first
SLACK = 1e-9            # roundings between a distance taken here and there


@dataclass
class Merges:
    """``rows`` (ord, features, vec), ``points`` (pid, vec, weight, least) and ``table``
    (round, dist, lo, hi): one merge less than there are points."""

    rows: DataFrame
    points: DataFrame
    table: DataFrame


def roots(hooks: DataFrame) -> DataFrame:
    """(label, root), stored, of (label, parent): each label's end of the chain. Two labels that
    name each other are one root, the smaller; longer circles do not occur."""
    back = hooks.select(F.col("label").alias("parent"), F.col("parent").alias("_back"))
    own = (F.col("_back") == F.col("label")) & (F.col("label") < F.col("parent"))
    at = staging.store(hooks.join(back, "parent", "left").select(
        "label", F.when(own, F.col("label")).otherwise(F.col("parent")).alias("root")), "hooks")
    while True:
        up = at.select(F.col("label").alias("root"), F.col("root").alias("_above"))
        jumped = staging.store(at.join(up, "root").select("label", F.col("_above").alias("root"),
                                                          (F.col("_above") != F.col("root")).alias("_moved")), "hooks")
        at = jumped.select("label", "root")
        if jumped.where("_moved").isEmpty():
            return at


def _outside(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per query: the least link of the block that leaves the query's cluster."""
    cols = ["pid", "dist", "lo", "hi", "near"]
    if not len(left) or not len(right):
        return pd.DataFrame(columns=cols)
    a, b = left["pid"].to_numpy(), right["pid"].to_numpy()
    d = neighbours._distances(neighbours._matrix(left["vec"]), neighbours._matrix(right["vec"]))
    d[left["label"].to_numpy()[:, None] == right["label"].to_numpy()[None]] = np.inf
    row, at = np.nonzero((d == d.min(1)[:, None]) & np.isfinite(d))
    lo, hi = np.minimum(a[row], b[at]), np.maximum(a[row], b[at])
    order = np.lexsort((hi, lo, row))
    row, at, lo, hi = (x[order] for x in (row, at, lo, hi))
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, dtype=bool)
    return pd.DataFrame({"pid": a[row], "dist": d[row, at], "lo": lo, "hi": hi, "near": b[at]})[first]


def _found(visits: DataFrame, asked: DataFrame, base: DataFrame, cells: neighbours.Cells) -> DataFrame:
    return neighbours.in_blocks(visits, asked, base, cells, _outside, "pid bigint, dist double, lo bigint, hi bigint, near bigint")


def _reach(state: DataFrame, points: DataFrame) -> DataFrame:
    """(label, most): a distance at which each cluster surely has a link outside: from the point it
    is named after to that of the first cluster, and for the first one to the second's."""
    names = state.where("pid = label").join(points.select("pid", "vec"), "pid").select("label", "vec")
    two = [r["vec"] for r in names.orderBy("label").limit(2).collect()]
    first = names.agg(F.min("label").alias("_first"))

    def to(v):
        there = F.array(*[F.lit(float(x)) for x in v])
        return F.sqrt(F.aggregate(F.zip_with("vec", there, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))

    far = F.when(F.col("label") == F.col("_first"), to(two[1])).otherwise(to(two[0]))
    return names.crossJoin(F.broadcast(first)).select("label", (far * (1 + SLACK)).alias("most"))     # one row on the right


def _listed(points: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(pid, dist, lo, hi, near) of each point's k nearest, and (pid, far): from there on the list tells nothing."""
    asked = points.select("pid", "vec", F.lit(1.0).alias("one"))
    found = tiles.met(asked, asked, tiles.Nearest(k, True), "pid bigint, near bigint, dist double, weight double", ("one", "one"))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("dist", "near"))
    first = staging.store(found.withColumn("_r", rank).where(F.col("_r") <= k), "lists")
    whole = points.count() <= k + 1
    far = staging.store(first.groupBy("pid").agg((F.lit(float("inf")) if whole else F.max("dist")).alias("far")), "far")
    lists = first.join(far, "pid").where("dist < far")              # of equally far ones, some may be missing
    return lists.select("pid", "dist", F.least("pid", "near").alias("lo"), F.greatest("pid", "near").alias("hi"), "near"), far


def _dense_merges(points: DataFrame) -> DataFrame:
    """The merge table of long vectors. Each point lists its nearest once, in tiles; a cluster takes
    the least link that leaves it when no point whose list has run out can have a shorter one, and all
    others wait, as the least link out of a single cluster belongs to the tree whatever the rest does.
    When none can, points with nothing left search again, all but those of the largest cluster."""
    spark, many = points.sparkSession, points.count()
    taken, number = spark.createDataFrame([], "round int, dist double, lo bigint, hi bigint"), 0
    labels = points.select("pid", F.col("pid").alias("label"))
    if many < 2:
        return taken
    live, far = _listed(points, min(NEAREST, many - 1))
    while many > 1:
        number += 1
        there = labels.select(F.col("pid").alias("near"), F.col("label").alias("there"))
        live = staging.store(live.drop("label", "there").join(labels, "pid").join(there, "near").where("label <> there"), "lists")
        best = live.groupBy("label").agg(F.min(F.struct("dist", "lo", "hi", "there")).alias("b"))
        blind = labels.join(far, "pid").join(live.select("pid").distinct(), "pid", "left_anti")
        limits = blind.groupBy("label").agg(F.min("far").alias("far"))
        status = staging.store(labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(best, "label", "left").join(limits, "label", "left"), "status")
        sure = status.where("b is not null and (far is null or b.dist < far)")
        if sure.isEmpty():
            largest = status.orderBy(F.desc("n"), "label").first()["label"]
            asked = blind.where(F.col("label") != largest).join(status.select("label", F.col("b.dist").alias("most")), "label") \
                .where("most is null or far <= most").join(points.select("pid", "vec"), "pid").select("pid", "vec", "label")
            asked = staging.store(asked, "asked")
            found = tiles.met(asked, points.select("pid", "vec").join(labels, "pid"), tiles.Outside(),
                              "pid bigint, dist double, lo bigint, hi bigint, near bigint", ("label", "label"))
            link = found.groupBy("pid").agg(F.min(F.struct("dist", "lo", "hi", "near")).alias("b")).select("pid", "b.*")
            link = staging.store(link, "found")
            if link.isEmpty():
                raise ValueError("vectors hold null or non-finite entries")
            live = live.select("pid", "dist", "lo", "hi", "near").unionByName(link)
            far = staging.store(far.join(link.select("pid", F.col("dist").alias("_d")), "pid", "left").select(
                "pid", F.coalesce("_d", "far").alias("far")), "far")
            number -= 1
            continue
        chosen = staging.store(sure.select("label", "b.*"), "chosen")
        taken = taken.unionByName(chosen.select(F.lit(number).alias("round"), "dist", "lo", "hi").distinct())
        ends = chosen.select("label", F.col("there").alias("parent"))
        waiting = ends.select(F.col("parent").alias("label")).distinct().join(ends, "label", "left_anti")
        to = roots(ends.unionByName(waiting.select("label", F.col("label").alias("parent"))))
        labels = staging.store(labels.join(to, "label", "left").select("pid", F.coalesce("root", "label").alias("label")), "labels")
        many = labels.select("label").distinct().count()
    return taken


def merges(vectors: DataFrame, seed: int = 42) -> Merges:
    """The merge table of (ord, features). No rows are an error, as there is no point to be near to;
    one point has no merges."""
    rows = vectors.select(ORD, "features", vector_to_array("features").alias("vec"))
    points = neighbours.merged(rows, {"least": F.min(ORD)})
    if tiles.dense(points):
        return Merges(rows, points, staging.store(_dense_merges(points), "merges"))
    base, cells = neighbours.build_cells(points, seed)
    cell_of = staging.store(neighbours._own_cells(points.select("pid", "vec"), cells), "own")
    state = points.select("pid", F.col("pid").alias("label"), F.lit(0.0).alias("low"),
                          F.lit(None).cast(LINK).alias("link"), F.lit(None).cast("bigint").alias("near"))
    many, left, number, taken = points.count(), 0, 0, None
    while many > 1 and many != left:
        left, number = many, number + 1
        labels = state.select("pid", "label")
        known = state.where("link is not null")
        bound = _reach(state, points).unionByName(known.select("label", F.col("link.dist").alias("most"))) \
            .groupBy("label").agg(F.min("most").alias("most"))
        asked = staging.store(state.where("link is null").join(bound, "label").where("low <= most")
                              .join(points.select("pid", "vec"), "pid").select("pid", "vec", "label", "most"), "asked")
        labelled = staging.store(base.join(labels, "pid"), "labelled")
        near = staging.store(_found(cell_of.join(asked.select("pid"), "pid"), asked.drop("most"), labelled, cells), "near")
        closer = near.join(labels, "pid").groupBy("label").agg(F.min("dist").alias("_near"))
        narrowed = staging.store(asked.join(closer, "label", "left")
                                 .withColumn("most", F.least("most", F.coalesce("_near", "most"))).drop("_near"), "asked")
        alike = labelled.groupBy(F.col("cell").alias("target")).agg(F.min("label").alias("_min"), F.max("label").alias("_max"))
        open_to = neighbours.visit(narrowed.select("pid", "vec", "most"), cells, "most").join(cell_of, ["pid", "target"], "left_anti") \
            .join(alike, "target").join(narrowed.select("pid", "label"), "pid") \
            .where("not (_min = _max and _min = label)").select("pid", "target")
        far = _found(staging.store(open_to, "visits"), narrowed.drop("most"), labelled, cells)
        link = F.struct("dist", "lo", "hi", "near")
        best = near.unionByName(far).groupBy("pid").agg(F.min(link).alias("_b"))
        searched = narrowed.select("pid", "label", "most").join(best, "pid", "left").withColumn("_sure", F.col("_b.dist") <= F.col("most"))
        fresh = searched.select("pid", F.when(F.col("_sure"), F.col("_b.dist")).otherwise(F.col("most")).alias("_low"),
                                F.when(F.col("_sure"), F.struct("_b.dist", "_b.lo", "_b.hi")).alias("_link"),
                                F.when(F.col("_sure"), F.col("_b.near")).alias("_next"))
        state = staging.store(state.join(fresh, "pid", "left").select(
            "pid", "label", F.greatest("low", F.coalesce("_low", "low")).alias("low"),
            F.coalesce("link", F.col("_link").cast(LINK)).alias("link"), F.coalesce("near", "_next").alias("near")), "state")
        chosen = state.where("link is not null").groupBy("label").agg(F.min(F.struct("link", "near")).alias("_c")) \
            .select("label", F.col("_c.link").alias("link"), F.col("_c.near").alias("pid"))
        chosen = staging.store(chosen.join(labels.withColumnRenamed("label", "parent"), "pid").drop("pid"), "chosen")
        made = chosen.select(F.lit(number).alias("round"), "link.*").distinct()
        taken = made if taken is None else taken.unionByName(made)
        to = roots(chosen.select("label", "parent"))
        there = to.select(F.col("root"), F.col("label"))
        moved = state.join(there, "label").select("pid", F.col("root").alias("label"), "low", "link", "near")
        others = moved.select(F.col("pid").alias("near"), F.col("label").alias("_there"))
        still = F.col("_there") != F.col("label")
        state = staging.store(moved.join(others, "near", "left").select(
            "pid", "label", "low", F.when(still, F.col("link")).alias("link"), F.when(still, F.col("near")).alias("near")), "state")
        many = to.select("root").distinct().count()
    if many > 1:
        raise ValueError("vectors hold null or non-finite entries")
    if taken is None:
        taken = vectors.sparkSession.createDataFrame([], "round int, dist double, lo bigint, hi bigint")
    return Merges(rows, points, staging.store(taken, "merges"))


def _parts(points: DataFrame, links: DataFrame) -> DataFrame:
    """(pid, label): points joined by the links of a forest. Every tree takes its least link at each
    end, so the number of trees at least halves in a round."""
    labels, live = points.select("pid", F.col("pid").alias("label")), links.select("dist", "lo", "hi", F.col("lo").alias("a"), F.col("hi").alias("b"))
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("label"), F.struct("dist", "lo", "hi", F.col("b").alias("to")).alias("_l")).unionByName(
            live.select(F.col("b").alias("label"), F.struct("dist", "lo", "hi", F.col("a").alias("to")).alias("_l")))
        to = roots(ends.groupBy("label").agg(F.min("_l").alias("_l")).select("label", F.col("_l.to").alias("parent")))
        labels = staging.store(labels.join(to, "label", "left").select("pid", F.coalesce("root", "label").alias("label")), "labels")
        for end in ("a", "b"):
            live = live.join(to.select(F.col("label").alias(end), F.col("root").alias("_r")), end).drop(end).withColumnRenamed("_r", end)
        live = staging.store(live.where("a <> b"), "links")
    return labels


def cut(tree: Merges, ks: list[int]) -> dict[int, DataFrame]:
    """(ord, features, cluster) for each k: the k - 1 greatest merges undone, clusters numbered by
    their least ordinal. Fewer points than k make one cluster each."""
    most = max(ks)
    greatest = tree.table.orderBy(F.desc("dist"), F.desc("lo"), F.desc("hi")).limit(most - 1).select("dist", "lo", "hi")
    undone = staging.store(greatest, "undone")          # k - 1 rows
    parts = staging.store(_parts(tree.points, tree.table.join(F.broadcast(undone), ["dist", "lo", "hi"], "left_anti")), "parts")
    ends = undone.join(parts.select(F.col("pid").alias("lo"), F.col("label").alias("a")), "lo") \
                 .join(parts.select(F.col("pid").alias("hi"), F.col("label").alias("b")), "hi") \
                 .orderBy("dist", "lo", "hi").collect()
    least = {r["label"]: r["least"] for r in parts.join(tree.points, "pid").groupBy("label").agg(F.min("least").alias("least")).collect()}
    spark, of = tree.points.sparkSession, {c: {c} for c in least}       # at most the greatest k clusters
    members = neighbours.matched(tree.rows, staging.store(tree.points.join(parts, "pid").select("vec", "weight", "label"), "labels"),
                                 ["label"]).drop("vec")
    out, waiting = {}, [(r["a"], r["b"]) for r in ends]
    for k in sorted(set(ks), reverse=True):
        while len(waiting) > k - 1:
            a, b = waiting.pop(0)
            joined = of[a] | of[b]
            of.update(dict.fromkeys(joined, joined))
        groups = sorted({min(least[c] for c in g): g for g in of.values()}.items())
        numbers = spark.createDataFrame([(c, i) for i, (_, g) in enumerate(groups) for c in g], "label bigint, cluster int")
        out[k] = members.join(F.broadcast(numbers), "label").select(ORD, "features", "cluster")
    return out


def _numbered(rows: DataFrame, points: DataFrame, parts: DataFrame) -> DataFrame:
    """(ord, features, cluster) of (pid, label), clusters numbered by their least ordinal."""
    held = staging.store(points.join(parts, "pid").select("vec", "weight", "label", "least"), "labels")
    first = held.groupBy("label").agg(F.min("least").alias("_first"))
    numbered = axis.ordinal(first, ["_first"], name="cluster").df.select("label", F.col("cluster").cast("int"))
    placed = staging.store(held.join(numbered, "label").select("vec", "weight", "cluster"), "labels")
    return neighbours.matched(rows, placed, ["cluster"]).select(ORD, "features", "cluster")


def cut_at(tree: Merges, distance: float) -> DataFrame:
    """(ord, features, cluster): all merges of at most ``distance`` done, clusters numbered by their
    least ordinal, however many there are."""
    parts = staging.store(_parts(tree.points, tree.table.where(F.col("dist") <= float(distance))), "parts")
    return _numbered(tree.rows, tree.points, parts)


def linked(points: DataFrame, distance: float) -> DataFrame:
    """(pid, label), stored: points (pid, vec) joined by the pairs at most ``distance`` apart. Blocks
    are joined within first; a tile then names the labels it joins, never its pairs."""
    labels = points.select("pid", F.col("pid").alias("label"))
    for inside in (True, False):
        asked = staging.store(points.select("pid", "vec").join(labels, "pid"), "labelled")
        joins = tiles.Joins(float(distance))
        found = tiles.within_blocks(asked, joins, "lo bigint, hi bigint", "label") if inside else \
            tiles.met(asked, asked, joins, "lo bigint, hi bigint", ("label", "label"))
        links = staging.store(found.distinct().select(F.lit(0.0).alias("dist"), "lo", "hi"), "links")
        names = labels.select(F.col("label").alias("pid")).distinct()
        to = _parts(names, links).select(F.col("pid").alias("label"), F.col("label").alias("root"))
        labels = staging.store(labels.join(to, "label").select("pid", F.col("root").alias("label")), "labels")
    return labels


def cut_vectors(vectors: DataFrame, distance: float, seed: int = 42) -> DataFrame:
    """What ``cut_at`` makes of all merges, without those beyond ``distance``: long vectors are joined
    in tiles at once, as a cut of single linkage is what short links connect."""
    rows = vectors.select(ORD, "features", vector_to_array("features").alias("vec"))
    points = neighbours.merged(rows, {"least": F.min(ORD)})
    if not tiles.dense(points):
        return cut_at(merges(vectors, seed), distance)
    if points.where(F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).limit(1).count():
        raise ValueError("vectors hold null or non-finite entries")
    return _numbered(rows, points, linked(points, distance))
