"""Exact nearest-neighbour joins, partitioned by a two-level hierarchy of pivots.

Points are numbered, equal vectors merged to one point with a weight. At most
``TOPS`` pivots are known to the driver; under each, one point in ``CELL_ROWS``
is a pivot of its own, kept in a table, so cells stay small however many points
there are. A query first meets its own cell, which bounds its k-th distance; the
triangle inequality rules out tops, then cells, that cannot hold anything
nearer, and the rest are visited. Visits are (point, cell) numbers only; vectors
are joined to them per cell. Cells meet in blocks of bounded size on both sides,
so a crowded cell spreads over many tasks, and a block returns at most k rows
per query. A top with many cells is dealt to chunks of ``CHUNK`` pivots.

Any assignment of points to cells gives exact results. How much is ruled out
depends on the dimension: a cell of true dimension beyond some 15 is as wide as
the distances between points, so nearly all are visited and the work is that of
all blocks against all blocks, on any number of machines.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tideframe import staging
from tideframe.operators import leaves, tiles

TOPS = 2_048
CELL_ROWS = 1_024
CHUNK = 4_096           # pivots under a top that are met at once
BASE_BLOCK = 4_096
QUERY_BLOCK = 2_048
HOT_SHARE = 1_024       # a vector held by more than one row in so many is joined by broadcast
OPEN_SHARE = 0.2        # of all pairs of long vectors; where boxes leave more open, all meet in tiles
FEW = 500_000           # rows of a table of numbers that may be broadcast: some 20 MB


@dataclass
class Cells:
    """``tops`` with the farthest point under each and its number of chunks; ``table`` has
    (top, chunk, cell, pivot, radius, n) for every cell that holds points."""

    tops: np.ndarray
    reach: np.ndarray
    chunks: np.ndarray
    table: DataFrame


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairwise Euclidean distances by plain differences, a slice at a time, so
    that equal vectors are exactly 0 apart."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(b.size, 1))
    for i in range(0, len(a), step):
        out[i:i + step] = np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(-1))
    return out


def merged(points: DataFrame, payload: dict[str, Column]) -> DataFrame:
    """(pid, vec, weight, payload...), stored: equal vectors made one point, points numbered."""
    one = points.groupBy("vec").agg(F.count(F.lit(1)).cast("double").alias("weight"), *[e.alias(k) for k, e in payload.items()])
    return staging.store(one.withColumn("pid", F.monotonically_increasing_id()), "points")


def matched(rows: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` (with ``vec``) and ``columns`` of the point (vec, weight, ...) they are at. Vectors
    that many rows hold go by broadcast, so no task gets all their rows."""
    total = points.agg(F.sum("weight")).first()[0] or 0.0
    at = F.struct(*columns).alias("_at")
    hot = points.where(F.col("weight") * HOT_SHARE > total).select(F.col("vec").alias("_vec"), at)      # HOT_SHARE rows at most
    met = rows.join(F.broadcast(hot), F.col("vec") == F.col("_vec"), "left").drop("_vec")
    rest = met.where(F.col("_at").isNull()).drop("_at").join(points.select("vec", at), "vec")
    return met.where(F.col("_at").isNotNull()).unionByName(rest).select(*[c for c in rows.columns], "_at.*")


def _topped(df: DataFrame, tops: np.ndarray) -> DataFrame:
    """Adds the nearest top and the distance to it."""
    schema = T.StructType([*df.schema.fields, T.StructField("top", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def nearest(batches):
        for pdf in batches:
            d = _distances(_matrix(pdf["vec"]), tops) if len(pdf) else np.zeros((0, 1))
            at = d.argmin(1)
            yield pdf.assign(top=at.astype("int32"), away=d[np.arange(len(pdf)), at])

    return df.mapInPandas(nearest, schema)


def _of_each(values: np.ndarray) -> Column:
    """A number per top, looked up by ``top``."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("top") + 1) if len(values) <= 64 else \
        F.element_at(F.from_json(F.lit(str([int(v) for v in values])), "array<int>"), F.col("top") + 1)


def build_cells(base: DataFrame, seed: int = 42) -> tuple[DataFrame, Cells]:
    """Pivots drawn by hash, every base point (with its distance to the pivot) assigned and stored."""
    n = base.count()
    if not n:
        raise ValueError("no point to be near to")
    many = max(1, min(TOPS, math.ceil(math.sqrt(n / CELL_ROWS))))
    drawn = base.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(many).select("vec").collect()
    tops = np.array([r["vec"] for r in drawn], dtype=float).reshape(len(drawn), -1)
    under = staging.store(_topped(base, tops), "tops")
    picked = F.pmod(F.xxhash64("pid", F.lit(seed + 1)), F.lit(CELL_ROWS)) == 0
    reach, rows, pivots = (np.zeros(len(tops)) for _ in range(3))
    for r in under.groupBy("top").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.count_if(picked).alias("p")).collect():
        reach[r["top"]], rows[r["top"]], pivots[r["top"]] = r["r"], r["n"], r["p"]
    chunks = np.maximum(1, np.ceil(pivots / CHUNK)).astype(int)
    salts = np.maximum(1, np.ceil(rows / chunks / BASE_BLOCK)).astype(int)

    def dealt(df: DataFrame) -> DataFrame:
        return df.withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(3)), _of_each(chunks)).cast("int"))

    subs = dealt(under.where(picked).select("top", "pid", "vec")).withColumn("salt", F.explode(F.sequence(F.lit(0), _of_each(salts) - 1)))
    own = dealt(under).withColumn("salt", F.pmod(F.xxhash64("pid", F.lit(5)), _of_each(salts)).cast("int"))
    keys, cols = ["top", "chunk", "salt"], base.columns

    def settle(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=[*cols, "top", "chunk", "cell", "reach"])
        top = int(left["top"].iloc[0])
        ids = np.append(right["pid"].to_numpy(dtype=np.int64), -1 - (top << 32) - int(left["chunk"].iloc[0]))   # the top is a pivot of each chunk
        places = np.concatenate((_matrix(right["vec"]).reshape(len(right), -1), tops[top][None])) if len(right) else tops[top][None]
        d = _distances(_matrix(left["vec"]), places)
        at = d.argmin(1)
        return left[[*cols, "top", "chunk"]].assign(cell=ids[at], reach=d[np.arange(len(left)), at])

    schema = T.StructType([*base.schema.fields, T.StructField("top", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                           T.StructField("cell", T.LongType()), T.StructField("reach", T.DoubleType())])
    placed = staging.store(own.groupBy(*keys).cogroup(subs.groupBy(*keys)).applyInPandas(settle, schema), "cells")
    held = placed.groupBy("top", "chunk", "cell").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
    pivot = under.where(picked).select(F.col("pid").alias("cell"), F.col("vec").alias("pivot"))
    table = staging.store(held.join(pivot, "cell", "left").select("top", "chunk", "cell", "pivot", "radius", "n"), "cell_table")
    return placed, Cells(tops, reach, chunks, table)


def visit(queries: DataFrame, cells: Cells, limit: str) -> DataFrame:
    """(pid, target), stored: every cell that may hold a point within ``limit`` of the query
    (pid, vec, limit); a null limit rules out none."""
    tops, reach, chunks = cells.tops, cells.reach, cells.chunks
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def over(d: np.ndarray, radius: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.where(np.isnan(most), np.inf, most)
        return np.nonzero(d - radius[None, :] <= most[:, None] * (1 + 1e-9) + 1e-12)

    def open_tops(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            row, at = over(_distances(_matrix(pdf["vec"]), tops), reach, pdf[limit].to_numpy(dtype=float))
            many = chunks[at]
            chunk = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            yield pd.DataFrame({"pid": pdf["pid"].to_numpy()[np.repeat(row, many)], "top": np.repeat(at, many).astype("int32"),
                                "chunk": chunk.astype("int32")})

    asked = queries.select("pid", "vec", limit).mapInPandas(open_tops, "pid bigint, top int, chunk int")
    asked = asked.join(queries.select("pid", "vec", F.col(limit).alias("most")), "pid") \
                 .withColumn("salt", F.pmod(F.xxhash64("pid", F.lit(9)), F.lit(blocks)).cast("int"))
    table = cells.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["top", "chunk", "salt"]

    def open_cells(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": [], "target": []})
        places = np.stack([tops[t] if p is None else np.asarray(p, dtype=float) for t, p in zip(right["top"], right["pivot"])])
        row, at = over(_distances(_matrix(left["vec"]), places), right["radius"].to_numpy(), left["most"].to_numpy(dtype=float))
        return pd.DataFrame({"pid": left["pid"].to_numpy()[row], "target": right["cell"].to_numpy()[at]})

    found = asked.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(open_cells, "pid bigint, target bigint")
    return staging.store(found, "visits")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df


def in_blocks(visits: DataFrame, queries: DataFrame, base: DataFrame, cells: Cells, fold, schema: str) -> DataFrame:
    """Run ``fold(queries, base)`` for each pair of blocks of a cell.

    ``visits`` (pid, target) say which of ``queries`` meet which cell. Base rows
    are split by hash into blocks, queries too; each side is copied once per
    block of the other.
    """
    sizes = visits.groupBy("target").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("_q")).join(
        cells.table.groupBy(F.col("cell").alias("target")).agg(F.ceil(F.sum("n") / BASE_BLOCK).cast("int").alias("_b")), "target")
    sizes = _small(staging.store(sizes, "sizes"))

    def split(df: DataFrame, mine: str, theirs: str, own: str, other: str) -> DataFrame:
        salt = F.pmod(F.xxhash64("pid", F.lit(7)), F.col(own)).cast("int")
        return df.withColumn(mine, salt).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_q", "_b")

    b = split(base.drop("top", "chunk", "reach").withColumnRenamed("cell", "target").join(sizes, "target"), "bpart", "qpart", "_b", "_q")
    asked = visits.join(sizes, "target").join(queries, "pid")
    qs = split(asked, "qpart", "bpart", "_q", "_b")
    keys = ["target", "bpart", "qpart"]
    return qs.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fold, schema)


def knn(queries: DataFrame, base: DataFrame, cells: Cells, k: int, payload: dict[str, str],
        skip_self: bool = False) -> DataFrame:
    """(pid, near, dist, weight, payload..., before): the nearest base points of
    each query until their weights reach k; ``before`` is the weight nearer by.

    ``queries`` holds (pid, vec) with distinct vectors. With ``skip_self`` they
    are numbered as the base, and one copy of the query itself is not its own neighbour.
    """
    schema = "pid bigint, near bigint, dist double, weight double" + "".join(f", {c} {t}" for c, t in payload.items())
    extra = list(payload)

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["pid", "near", "dist", "weight", *extra]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=cols)
        weight, pids, asks = right["weight"].to_numpy(dtype=float), right["pid"].to_numpy(), left["pid"].to_numpy()
        d = _distances(_matrix(left["vec"]), _matrix(right["vec"]))
        w = np.repeat(weight[None, :], len(left), axis=0)
        if skip_self:
            w = w - (asks[:, None] == pids[None, :])
            d = np.where(w > 0, d, np.inf)
        if d.shape[1] > k + 1:
            row, at = np.nonzero(d <= np.partition(d, k, axis=1)[:, k:k + 1])
        else:
            row, at = (a.ravel() for a in np.indices(d.shape))
        kept = np.isfinite(d[row, at])
        row, at = row[kept], at[kept]
        order = np.lexsort((pids[at], d[row, at], row))
        row, at = row[order], at[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) <= k
        row, at = row[first], at[first]
        found = {c: right[c].to_numpy()[at] for c in extra}
        return pd.DataFrame({"pid": asks[row], "near": pids[at], "dist": d[row, at], "weight": w[row, at], **found})[cols]

    closest = Window.partitionBy("pid").orderBy("dist", "near")

    def best(found: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("weight").over(closest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        return found.withColumn("before", before).where(F.col("before") < k)

    queries = staging.store(queries.select("pid", "vec"), "queries")
    if tiles.dense(base):
        found = _long(queries, base, k, skip_self, best)
        return found.join(base.select(F.col("pid").alias("near"), *extra), "near") if extra else found
    cells_of = staging.store(_own_cells(queries, cells), "own")
    first = staging.store(best(in_blocks(cells_of, queries, base, cells, fold, schema)), "knn")
    more = visit(_bounds(queries, first, k), cells, "limit").join(cells_of, ["pid", "target"], "left_anti")
    second = in_blocks(staging.store(more, "visits"), queries, base, cells, fold, schema)
    return best(first.drop("before").unionByName(second))


def _bounds(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(pid, vec, limit), stored: how far the neighbours known so far reach, null where they are too few."""
    known = first.groupBy("pid").agg(F.sum("weight").alias("got"), F.max("dist").alias("far"))
    bound = queries.join(known, "pid", "left").select("pid", "vec", F.when(F.col("got") >= k, F.col("far")).alias("limit"))
    return staging.store(bound, "bounds")


def _long(queries: DataFrame, base: DataFrame, k: int, skip_self: bool, best) -> DataFrame:
    """Neighbours of long vectors: those of the own leaf, then of the leaves that they leave open; where
    these are many, of all points in tiles."""
    fold, schema = tiles.Nearest(k, skip_self), "pid bigint, near bigint, dist double, weight double"
    asked, many = queries.withColumn("one", F.lit(1.0)), base.select("pid", "vec", "weight")
    grown = leaves.grown(many)
    if grown is not None:
        placed, tree = grown
        met = tiles.met_rows(fold, ("one", "weight"))
        first = staging.store(best(in_blocks(leaves.own(queries, tree), asked, placed, tree, met, schema)), "knn")
        bound = _bounds(queries, first, k)
        if leaves.pairs(bound, tree, "limit") <= OPEN_SHARE * queries.count() * many.count():
            second = in_blocks(leaves.visits(bound, tree, "limit"), asked, placed, tree, met, schema)
            return best(first.drop("before").unionByName(second))
    return best(tiles.met(asked, many, fold, schema, ("one", "weight")))


def _own_cells(queries: DataFrame, cells: Cells) -> DataFrame:
    """(pid, target): under the nearest top, the cell of the nearest pivot; of one chunk, if there are more."""
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    keys, tops = ["top", "chunk", "salt"], cells.tops
    asked = _topped(queries, tops).withColumn("chunk", F.pmod(F.xxhash64("pid", F.lit(3)), _of_each(cells.chunks)).cast("int")) \
        .withColumn("salt", F.pmod(F.xxhash64("pid", F.lit(9)), F.lit(blocks)).cast("int"))
    table = cells.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def own(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": [], "target": []})
        places = np.stack([tops[t] if p is None else np.asarray(p, dtype=float) for t, p in zip(right["top"], right["pivot"])])
        at = _distances(_matrix(left["vec"]), places).argmin(1)
        return pd.DataFrame({"pid": left["pid"].to_numpy(), "target": right["cell"].to_numpy()[at]})

    return asked.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(own, "pid bigint, target bigint")
