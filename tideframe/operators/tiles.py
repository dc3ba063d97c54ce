"""Long vectors against each other: blocks meet in tiles, one matrix product a slice.

From ``DENSE`` entries on, cells rule out hardly anything, so every block of
queries meets every block of points. A tile bounds its distances by one product
in single precision (in double, where numbers are large) with a bound on its
rounding; only the pairs that this leaves open are measured by plain
differences, so results are those of comparing all pairs. A block travels as one
row, in half the bytes where its numbers are floats. Tiles are bounded in rows
and bytes on both sides, and hashed blocks are alike in size; the work is
quadratic, some 4 ns a pair of 64 entries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

DENSE = 16
BLOCK_BYTES = 8 << 20       # of a block, as doubles
SEGMENT = 16                # largest blocks of points in a tile
LEAST_BLOCK = 1_024
SPREAD = 24                 # blocks of queries, unless these grow too large
ASK, MEET = 512, 8_192      # rows of a slice
EXACT = 65_536              # pairs measured at once


def dense(points: DataFrame) -> bool:
    """Whether the vectors are long enough for tiles."""
    one = points.select(F.size("vec")).first()
    return one is not None and one[0] >= DENSE


class Side:
    """Rows of a tile: pid, extra, x, and what bounds distances to them."""

    def __init__(self, pid, extra, x, centre, kind):
        with np.errstate(over="ignore", invalid="ignore"):
            y = x.astype(float) - centre
            sq = (y * y).sum(1)
        self.odd = ~np.isfinite(sq)             # null or huge entries: never ruled out
        y[self.odd], sq[self.odd] = 0.0, 0.0
        self.pid, self.extra, self.x, self.sq = pid, extra, x, sq
        self.y = np.hstack([y, np.ones((len(y), 1))]).astype(kind)
        self.half = (-sq / 2).astype(kind)

    def part(self, at) -> "Side":
        out = object.__new__(Side)
        for name in ("odd", "pid", "extra", "x", "sq", "y", "half"):
            setattr(out, name, getattr(self, name)[at])
        return out

    def __len__(self):
        return len(self.pid)


def near(asked: Side, there: Side, most: np.ndarray, k: int = 0, apart=None):
    """(row, at, dist) of all pairs at most ``most`` (one per query) apart. With ``k``, a query may
    leave out what is farther than its k nearest here; with ``apart``, pairs of equal labels."""
    kind = asked.y.dtype
    other = there.y.copy()
    other[:, -1] = there.half
    s = asked.y @ other.T               # half of (the query's square - the squared distance)
    eps, top = float(np.finfo(kind).eps), float(there.sq.max(initial=0.0))
    slack = (asked.y.shape[1] + 8) * eps * (asked.sq + top + np.sqrt(asked.sq * top)) + 1e-36
    floor = (asked.sq - most.astype(float) ** 2) / 2
    if there.odd.any():
        s[:, there.odd] = -np.inf
    if k and apart is not None:
        s[apart[0][:, None] == apart[1][None]] = -np.inf
    if k and s.shape[1] > k and np.isinf(most).any():
        floor = np.maximum(floor, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] - slack)
    floor = floor - slack - 2 * eps * np.abs(floor)
    open_to = s >= floor.astype(kind)[:, None]
    if there.odd.any() or asked.odd.any():
        open_to[:, there.odd] = True
        open_to[asked.odd] = True
    flat = np.flatnonzero(open_to)
    row, at = np.divmod(flat, s.shape[1]) if s.shape[1] else (flat, flat)
    if apart is not None:
        differ = apart[0][row] != apart[1][at]
        row, at = row[differ], at[differ]
    dist = np.empty(len(row))
    with np.errstate(over="ignore", invalid="ignore"):
        for i in range(0, len(row), EXACT):
            d = asked.x[row[i:i + EXACT]].astype(float) - there.x[at[i:i + EXACT]].astype(float)
            dist[i:i + EXACT] = np.sqrt((d ** 2).sum(-1))
        kept = (dist <= most[row]) & np.isfinite(dist)
    return row[kept], at[kept], dist[kept]


def _packed(df: DataFrame, blocks: int, extra: str) -> DataFrame:
    """One row per block of (pid, vec, extra)."""
    kind = df.schema[extra].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            short = x.astype("f4")
        data = short if np.array_equal(short.astype(float), x) else x
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "pid": [pdf["pid"].to_numpy()],
                             "extra": [pdf[extra].to_numpy()], "data": [data.tobytes()], "short": [data is short]})

    own = F.pmod(F.xxhash64("pid", F.lit(11)), F.lit(blocks)).cast("int").alias("block")
    return df.select(own, "pid", "vec", extra).repartition(min(blocks, 2_000), "block").groupBy("block").applyInPandas(
        pack, f"block int, pid array<bigint>, extra array<{kind}>, data binary, short boolean")


def _sides(left: pd.DataFrame, right: pd.DataFrame) -> tuple[list[Side], list[Side]]:
    def read(pdf):
        return [(np.asarray(r.pid), np.asarray(r.extra), np.frombuffer(r.data, dtype="f4" if r.short else "f8").reshape(len(r.pid), -1))
                for r in pdf.itertuples(index=False)]

    return sides(read(left), read(right))


def sides(asked: list[tuple], there: list[tuple]) -> tuple[list[Side], list[Side]]:
    """Both sides of a tile, of (pid, extra, x) each, about one centre."""
    sound = there[0][2][np.isfinite(there[0][2]).all(1)].astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        centre = sound.mean(0) if len(sound) else np.zeros(there[0][2].shape[1])
    centre = np.where(np.isfinite(centre), centre, 0.0)
    greatest = max(float(np.abs(x[np.isfinite(x)]).max(initial=0.0)) for _, _, x in asked + there)
    kind = "f4" if greatest < 1e13 else "f8"
    return [Side(*x, centre, kind) for x in asked], [Side(*x, centre, kind) for x in there]


def met_rows(fold, extra: tuple[str, str]):
    """``fold`` for frames of (pid, vec, extra) as groups hold them, one row a vector."""
    def read(pdf, name):
        return [(pdf["pid"].to_numpy(), pdf[name].to_numpy(), np.stack(pdf["vec"].to_numpy()).astype(float))]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(left) and len(right):
            asked, there = sides(read(left, extra[0]), read(right, extra[1]))
            made = [pd.DataFrame(dict(zip(fold.columns, got))) for got in fold(asked[0], there)]
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=list(fold.columns))
    return run


def _folded(fold):
    """``fold(asked, there)`` yields columns; their rows make the tile's."""
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, made = fold.columns, []
        if len(left) and len(right):
            asked, there = _sides(left, right)
            made = [pd.DataFrame(dict(zip(names, got))) for one in asked for got in fold(one, there)]
        return pd.concat(made, ignore_index=True) if made else pd.DataFrame(columns=names)
    return run


def met(queries: DataFrame, base: DataFrame, fold, schema: str, extra: tuple[str, str]) -> DataFrame:
    """``fold`` over every tile of queries (pid, vec, extra[0]) and points (pid, vec, extra[1])."""
    asks, many = queries.count(), base.count()
    one = base.select(F.size("vec")).first()
    room = max(64, BLOCK_BYTES // (8 * max(1, one[0] if one else 1)))
    asking = max(1, math.ceil(asks / min(room, max(LEAST_BLOCK, asks // SPREAD))))
    blocks = max(1, math.ceil(many / min(room, max(LEAST_BLOCK, many // (2 * SPREAD)))))
    segments = min(blocks, max(math.ceil(many / (room * SEGMENT)), math.ceil(2 * SPREAD / asking)))
    keys, parts = ["ask", "segment"], min(2 * asking * segments, 2_000)
    left = _packed(queries, asking, extra[0]).withColumnRenamed("block", "ask") \
        .withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))))
    right = _packed(base, blocks, extra[1]).withColumn("segment", F.pmod(F.col("block"), F.lit(segments))).drop("block") \
        .withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asking - 1))))
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)) \
        .applyInPandas(_folded(fold), schema)


def within_blocks(points: DataFrame, fold, schema: str, extra: str) -> DataFrame:
    """``fold`` over blocks of points, each with itself."""
    one = points.select(F.size("vec")).first()
    room = max(64, BLOCK_BYTES // (8 * max(1, one[0] if one else 1)))
    run = _folded(fold)
    return _packed(points, max(1, math.ceil(points.count() / room)), extra).groupBy("block") \
        .applyInPandas(lambda pdf: run(pdf, pdf), schema)


def _slices(n: int, size: int, first: int | None = None):
    at, step = 0, first or size
    while at < n:
        yield slice(at, at + step)
        at, step = at + step, min(size, 2 * step)


class Nearest:
    """The ``k`` nearest points of each query; extras of points are weights."""

    columns = ("pid", "near", "dist", "weight")

    def __init__(self, k: int, skip_self: bool):
        self.k, self.skip_self = k, skip_self

    def __call__(self, asked: Side, there: list[Side]):
        k = self.k
        for mine in (asked.part(at) for at in _slices(len(asked), ASK)):
            most = np.full(len(mine), np.inf)
            row, ids, dist, weight = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
            for block in there:
                for b in (block.part(at) for at in _slices(len(block), MEET)):
                    r, at, d = near(mine, b, most, k + self.skip_self)
                    w = b.extra[at].astype(float)
                    if self.skip_self:
                        w = w - (mine.pid[r] == b.pid[at])
                    r, at, d, w = (x[w > 0] for x in (r, at, d, w))
                    if not len(r):
                        continue
                    row, ids, dist, weight = (np.concatenate(p) for p in ((row, r), (ids, b.pid[at]), (dist, d), (weight, w)))
                    order = np.lexsort((ids, dist, row))
                    row, ids, dist, weight = (x[order] for x in (row, ids, dist, weight))
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    most[row[rank == k - 1]] = dist[rank == k - 1]
                    row, ids, dist, weight = (x[rank < k] for x in (row, ids, dist, weight))
            yield mine.pid[row], ids, dist, weight


class Counted:
    """The weight of the points at most ``eps`` away, or one of at least ``enough``."""

    columns = ("pid", "weight")

    def __init__(self, eps: float, enough: float):
        self.eps, self.enough = eps, enough

    def __call__(self, asked: Side, there: list[Side]):
        for mine in (asked.part(at) for at in _slices(len(asked), ASK)):
            have = np.zeros(len(mine))
            for block in there:
                for at in _slices(len(block), MEET, ASK):
                    left = np.flatnonzero(have < self.enough)
                    if not len(left):
                        break
                    b = block.part(at)
                    r, c, _ = near(mine.part(left), b, np.full(len(left), self.eps))
                    have[left] += np.bincount(r, b.extra[c], len(left))
            yield mine.pid, have


class LeastLabel:
    """The least label (extra) among the points at most ``eps`` away, of queries that have one."""

    columns = ("pid", "label")

    def __init__(self, eps: float):
        self.eps = eps

    def __call__(self, asked: Side, there: list[Side]):
        for mine in (asked.part(at) for at in _slices(len(asked), ASK)):
            none = np.iinfo(np.int64).max
            least = np.full(len(mine), none)
            for block in there:
                for b in (block.part(at) for at in _slices(len(block), MEET)):
                    r, c, _ = near(mine, b, np.full(len(mine), self.eps))
                    np.minimum.at(least, r, b.extra[c])
            yield mine.pid[least < none], least[least < none]


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (each the least of its set) after joining a with b."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


class Joins:
    """Links (lo, hi) that join the labels (extras) which some pair at most ``eps`` apart joins; one
    less than there are labels in a joined set. Rows of one label are not compared."""

    columns = ("lo", "hi")

    def __init__(self, eps: float):
        self.eps = eps

    def __call__(self, asked: Side, there: list[Side]):
        names = np.unique(np.concatenate([asked.extra, *[b.extra for b in there]]))
        root = np.arange(len(names))
        places = [(b, np.searchsorted(names, b.extra)) for b in there]
        own = np.searchsorted(names, asked.extra)
        for rows in _slices(len(asked), ASK):
            for block, place in places:
                for cols in _slices(len(block), MEET, ASK):
                    a, b = root[own[rows]], root[place[cols]]
                    common = np.bincount(b).argmax()
                    q, p = asked.part(rows), block.part(cols)
                    for some, others in ((a != common, np.ones(len(b), bool)), (a == common, b != common)):
                        some, others = np.flatnonzero(some), np.flatnonzero(others)
                        if len(some) and len(others):
                            la, lb = root[own[rows][some]], root[place[cols][others]]
                            r, c, _ = near(q.part(some), p.part(others), np.full(len(some), self.eps), apart=(la, lb))
                            root = _united(root, la[r], lb[c])
        moved = np.flatnonzero(root != np.arange(len(names)))
        yield names[root[moved]], names[moved]


class Outside:
    """The least link (dist, lo, hi) of each query to a point of another label (extra)."""

    columns = ("pid", "dist", "lo", "hi", "near")

    def __call__(self, asked: Side, there: list[Side]):
        for mine in (asked.part(at) for at in _slices(len(asked), ASK)):
            most = np.full(len(mine), np.inf)
            row, ids, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for block in there:
                for b in (block.part(at) for at in _slices(len(block), MEET)):
                    r, at, d = near(mine, b, most, 1, apart=(mine.extra, b.extra))
                    if not len(r):
                        continue
                    row, ids, dist = np.concatenate((row, r)), np.concatenate((ids, b.pid[at])), np.concatenate((dist, d))
                    own = mine.pid[row]
                    order = np.lexsort((np.maximum(own, ids), np.minimum(own, ids), dist, row))
                    row, ids, dist = (x[order] for x in (row, ids, dist))
                    first = np.append(True, row[1:] != row[:-1])
                    row, ids, dist = row[first], ids[first], dist[first]
                    most[row] = dist
            own = mine.pid[row]
            yield own, dist, np.minimum(own, ids), np.maximum(own, ids), ids
