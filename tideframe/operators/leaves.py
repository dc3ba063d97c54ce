"""Points dealt to boxes by a tree of cuts, so that long vectors that lie along few lines meet few others.

Vectors of one-hot columns beside a few numbers have many entries but hardly any
spread: a box of neighbouring points leaves nearly all other boxes farther off
than the nearest in its own. The cuts come from at most ``DRAWN`` points a leaf,
drawn by hash, and go to every task; any tree gives exact results, as a box is
the extremes of all the points it holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from tideframe import staging

LEAF_ROWS = 3_072
LEAVES = 4_096
NUMBERS = 100_000       # leaves x entries
DRAWN = 32
LEAST = 8               # leaves; fewer points meet all at once
SLICE = 2_000_000       # distances to boxes at once


@dataclass
class Leaves:
    """``cut`` has (entry, value, node where entry <= value, node elsewhere) for each node, a leaf's
    entry being -1; ``cells`` numbers the leaves that hold points, with extremes ``lo`` and ``hi``;
    ``table`` has (cell, n)."""

    cut: list[tuple[int, float, int, int]]
    cells: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None
    table: DataFrame | None = None

    def of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            entry, value, low, high = self.cut[node]
            if entry < 0 or not len(rows):
                out[rows] = node
                continue
            under = x[rows, entry] <= value
            todo += [(low, rows[under]), (high, rows[~under])]
        return out

    def away(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to boxes; an entry that is no number adds nothing."""
        total = np.zeros((len(x), len(self.cells)))
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(x.shape[1]):
                gap = np.fmax(np.fmax(self.lo[None, :, i] - x[:, None, i], x[:, None, i] - self.hi[None, :, i]), 0.0)
                total += gap * gap
        return np.sqrt(total)


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def _cuts(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """The fullest node is halved at the entry that varies most, until there are enough."""
    cut, held = [(-1, 0.0, -1, -1)], {0: x}
    while len(held) < leaves:
        node = max(held, key=lambda i: len(held[i]))
        rows = held[node]
        entry = int(rows.var(0).argmax()) if len(rows) > 1 else 0
        value = float(np.median(rows[:, entry])) if len(rows) > 1 else 0.0
        under = rows[:, entry] <= value
        if under.all() and len(rows) > 1 and (rows[:, entry] < value).any():
            value = float(rows[rows[:, entry] < value, entry].max())
            under = rows[:, entry] <= value
        if under.all() or not under.any():
            break
        cut[node] = (entry, value, len(cut), len(cut) + 1)
        held.update({len(cut): rows[under], len(cut) + 1: rows[~under]})
        del held[node]
        cut += [(-1, 0.0, -1, -1)] * 2
    return cut


def grown(base: DataFrame, seed: int = 42) -> tuple[DataFrame, Leaves] | None:
    """``base`` (pid, vec, weight) with its leaf as ``cell``, stored, and the leaves; None for few points."""
    n = base.count()
    one = base.select(F.size("vec")).first()
    leaves = min(math.ceil(n / LEAF_ROWS), LEAVES, NUMBERS // max(1, one[0] if one else 1))
    if leaves < LEAST:
        return None
    drawn = base.orderBy(F.xxhash64("pid", F.lit(seed)), "pid").limit(leaves * DRAWN).select("vec").toArrow()["vec"].to_pandas()
    x = _rows(drawn)
    with np.errstate(over="ignore"):
        x = x[np.isfinite((x * x).sum(1))]
    tree = Leaves(_cuts(x, leaves) if len(x) else [(-1, 0.0, -1, -1)])
    placed = staging.store(_placed(base.select("pid", "vec", "weight"), tree, "cell"), "leaves")
    width = one[0]

    def extremes(batches):
        many = len(tree.cut)
        lo, hi, held = np.full((many, width), np.nan), np.full((many, width), np.nan), np.zeros(many, np.int64)
        for pdf in batches:
            if not len(pdf):
                continue
            at, rows = pdf["cell"].to_numpy(), _rows(pdf["vec"])
            order = np.argsort(at, kind="stable")
            own, first = np.unique(at[order], return_index=True)
            lo[own] = np.fmin(lo[own], np.fmin.reduceat(rows[order], first))
            hi[own] = np.fmax(hi[own], np.fmax.reduceat(rows[order], first))
            held += np.bincount(at, minlength=many)
        own = np.flatnonzero(held)
        if not len(own):        # a task without rows; an empty column of lists has no type
            return
        yield pd.DataFrame({"cell": own, "n": held[own], "lo": list(lo[own]), "hi": list(hi[own])})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"cell": pdf["cell"].iloc[:1], "n": [pdf["n"].sum()], "lo": [np.fmin.reduce(_rows(pdf["lo"]))],
                             "hi": [np.fmax.reduce(_rows(pdf["hi"]))]})

    schema = "cell bigint, n bigint, lo array<double>, hi array<double>"
    boxes = staging.store(placed.select("cell", "vec").mapInPandas(extremes, schema).groupBy("cell").applyInPandas(joined, schema), "boxes")
    found = boxes.orderBy("cell").toArrow().to_pandas()      # a row per leaf
    return placed, Leaves(tree.cut, found["cell"].to_numpy(), _rows(found["lo"]), _rows(found["hi"]), boxes.select("cell", "n"))


def _placed(df: DataFrame, tree: Leaves, name: str) -> DataFrame:
    bare = Leaves(tree.cut)

    def place(batches):
        for pdf in batches:
            yield pdf.assign(**{name: bare.of(_rows(pdf["vec"])) if len(pdf) else np.zeros(0, np.int64)})

    return df.mapInPandas(place, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))


def own(queries: DataFrame, tree: Leaves) -> DataFrame:
    """(pid, target): the leaf of each query (pid, vec)."""
    return _placed(queries.select("pid", "vec"), tree, "target").select("pid", "target")


def _open(tree: Leaves, limit: str, give):
    """Runs ``give(pid, own, open)`` over slices; ``open`` says which boxes other than the query's own may
    hold a point within ``limit``; a null limit rules out none."""
    bare = Leaves(tree.cut, tree.cells, tree.lo, tree.hi)

    def run(batches):
        for pdf in batches:
            step = max(1, SLICE // max(1, len(bare.cells)))
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                x, most = _rows(part["vec"]), part[limit].to_numpy(dtype=float)
                most = np.where(np.isnan(most), np.inf, most)
                may = bare.away(x) <= most[:, None] * (1 + 1e-9) + 1e-12
                may &= bare.of(x)[:, None] != bare.cells[None]
                yield give(part["pid"].to_numpy(), may)

    return run


def pairs(queries: DataFrame, tree: Leaves, limit: str) -> int:
    """How many pairs of a query (pid, vec, limit) and a point of another leaf the limits leave open."""
    sizes = {r["cell"]: r["n"] for r in tree.table.collect()}        # a row per leaf
    held = np.array([sizes[c] for c in tree.cells], dtype=np.int64)
    counted = queries.mapInPandas(_open(tree, limit, lambda pid, may: pd.DataFrame({"n": [int(may.sum(0) @ held)]})), "n bigint")
    return counted.agg(F.sum("n")).first()[0] or 0


def visits(queries: DataFrame, tree: Leaves, limit: str) -> DataFrame:
    """(pid, target), stored: every leaf but its own that may hold a point within the query's limit."""
    cells = tree.cells

    def give(pid, may):
        row, at = np.nonzero(may)
        return pd.DataFrame({"pid": pid[row], "target": cells[at]})

    return staging.store(queries.mapInPandas(_open(tree, limit, give), "pid bigint, target bigint"), "visits")
