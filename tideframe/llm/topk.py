"""Exact top-k by inner product from an impact-ordered, score-at-a-time index.

Vectors become small integers. The index deals rows to shards and a shard's rows
to blocks; in a block, a posting segment holds the rows with one value (the
impact) in one dimension, and segments are kept by descending impact in a few
levels. With each level goes, for every row, the energy (sum of squares) of what
it still has in later levels.

Queries go past a shard in blocks. Level by level their scores grow by what the
level's segments give; what a row may still gain or lose is bounded by the
energy it has left times the energy the query has in those dimensions. A query
stops when few rows can still reach its k-th best score. These, and only these,
are scored exactly, so the result is exact whatever the levels are. Rows that
cannot be ruled out early just meet more levels, up to all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm.whiten import integer_vectors, matrix

SCALE = 64
BLOCK = 2_048           # rows of an index block
QUERIES = 256           # queries of a block
SHARD_BYTES = 16 << 20  # of a shard's vectors, in 32-bit numbers
ENERGY = (0.6, 0.85, 0.94, 0.98)    # of a block's energy within the first levels; the last has the rest
ENOUGH = 4              # a query stops at so many times k possible rows of a block
EXACT32, ROUNDING = 1 << 24, 1e-6
INDEX = "shard int, kind int, part long, dims int, ids binary, rows binary, vectors binary, segments binary, postings binary, levels binary, tails binary"


def _cut(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segments, postings, levels, tails) of a block of integer vectors.

    segments: dim, impact, end within postings, by descending size of the impact;
    levels: the number of segments up to each; tails: levels x rows energy left.
    """
    n, dims = x.shape
    row, dim = np.nonzero(x)
    value = x[row, dim]
    order = np.lexsort((row, value, dim, -np.abs(value)))
    row, dim, value = row[order], dim[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (dim[1:] != dim[:-1]) | (value[1:] != value[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(row)) if len(row) else start
    energy = value.astype(float) ** 2
    reached = np.cumsum(energy) / max(energy.sum(), 1.0)
    levels = sorted({int(np.searchsorted(reached[end - 1], share)) + 1 for share in ENERGY} | {len(end)}) if len(end) else [0]
    levels = [min(at, len(end)) for at in levels]
    levels = sorted(set(levels))
    left = (x.astype(float) ** 2).sum(1)
    tails = np.empty((len(levels), n))
    before = 0
    for i, at in enumerate(levels):
        to = int(end[at - 1]) if at else 0
        left = left - np.bincount(row[before:to], weights=energy[before:to], minlength=n)
        tails[i], before = left, to
    tails[-1] = 0.0
    segments = np.stack((dim[start], value[start], end), 1) if len(row) else np.zeros((0, 3), dtype=np.int64)
    return segments.astype(np.int64), row.astype(np.int32), np.array(levels, dtype=np.int64), np.maximum(tails, 0.0)


class Block:
    """An index block as its levels' panels: per level a matrix of what its segments hold."""

    def __init__(self, ids, rows, vectors, segments, postings, levels, tails):
        self.ids, self.rows, self.x, self.tails = ids, rows, vectors, np.sqrt(tails)
        self.energy = int((vectors ** 2).sum(1).max(initial=0))
        self.segments, self.postings, self.levels = segments, postings, levels

    def panel(self, level: int, kind: type) -> np.ndarray:
        first, last = (int(self.levels[level - 1]) if level else 0), int(self.levels[level])
        out = np.zeros(self.x.shape, dtype=kind)
        ends = self.segments[:, 2]
        low = int(ends[first - 1]) if first else 0
        many = np.diff(np.concatenate(([low], ends[first:last])))
        out[self.postings[low:int(ends[last - 1]) if last else 0], np.repeat(self.segments[first:last, 0], many)] = \
            np.repeat(self.segments[first:last, 1], many)
        return out

    def panels(self, kind: type) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level its values and where they are, made once for each number type."""
        if getattr(self, "_kind", None) is not kind:
            made = [self.panel(level, kind) for level in range(len(self.levels))]
            self._kind, self._panels = kind, [(p, (p != 0).astype(kind)) for p in made]
        return self._panels


class Search:
    """The k best rows of a shard for a block of queries, block by block."""

    def __init__(self, query_rows: np.ndarray, queries: np.ndarray, k: int):
        self.rows, self.q, self.k = query_rows, queries, k
        self.floor = np.full(len(queries), -np.inf)     # a score that k rows are known to reach
        self.at, self.score, self.id, self.row = (np.zeros(0, dtype=np.int64) for _ in range(4))
        self.energy = int((queries ** 2).sum(1).max(initial=0))

    def possible(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of a block that may be among the k best."""
        exact = max(block.energy, self.energy) < EXACT32    # single precision holds every sum of products in full
        kind = np.float32 if exact else np.float64
        slack = 0.0 if exact else ROUNDING * math.sqrt(block.energy) * math.sqrt(self.energy)
        panels = block.panels(kind)
        todo = np.arange(len(self.q))
        whole = self.q.astype(kind)
        parts = []
        score = left = None
        begun = np.full(len(self.q), -np.inf)
        for level, (values, there) in enumerate(panels):
            wide, square = whole[todo], whole[todo] ** 2
            gained, seen = values @ wide.T, there @ square.T
            if score is None:
                score, left = gained, square.sum(1)[None, :] - seen
            else:
                score += gained
                left -= seen
            last = level == len(panels) - 1
            gap = (1 + 1e-6) * np.sqrt(np.maximum(left, 0)) * block.tails[level][:, None].astype(kind) + slack if not last else np.full((1, 1), slack)
            if len(score) > self.k and np.isinf(self.floor).any():      # the first block; one row may be the query itself
                known = np.partition(score - gap, len(score) - self.k - 1, axis=0)[len(score) - self.k - 1]
                begun[todo] = np.maximum(begun[todo], known)
            may = score + gap >= np.maximum(self.floor, begun)[todo]
            stop = (may.sum(0) <= ENOUGH * self.k) | last
            row, col = np.nonzero(may & stop)
            parts.append((todo[col], row))
            if stop.all():
                break
            score, left, todo = score[:, ~stop], left[:, ~stop], todo[~stop]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def meet(self, block: Block) -> None:
        at, row = self.possible(block)
        other = block.rows[row] != self.rows[at]
        at, row = at[other], row[other]
        score = np.empty(len(at), dtype=np.int64)
        for lo in range(0, len(at), 1 << 16):
            score[lo:lo + (1 << 16)] = (self.q[at[lo:lo + (1 << 16)]] * block.x[row[lo:lo + (1 << 16)]]).sum(1)
        self.at, self.score = np.concatenate((self.at, at)), np.concatenate((self.score, score))
        self.id, self.row = np.concatenate((self.id, block.ids[row])), np.concatenate((self.row, block.rows[row]))
        order = np.lexsort((self.row, self.id, -self.score, self.at))
        at = self.at[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = order[rank < self.k]
        self.at, self.score, self.id, self.row = self.at[kept], self.score[kept], self.id[kept], self.row[kept]
        many = np.bincount(self.at, minlength=len(self.q))
        worst = np.cumsum(many)[many == self.k] - 1
        self.floor[many == self.k] = np.maximum(self.floor[many == self.k], self.score[worst])


def integer_rows(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(_row, _id, _x), stored: _row numbers the rows that take part."""
    kept = integer_vectors(rows, id_col, vec_col, scale).where(F.col("_id").isNotNull())
    small = F.aggregate("_x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < float(1 << 62)
    return staging.store(kept.where(small).select(F.monotonically_increasing_id().alias("_row"), F.col("_id").cast("long").alias("_id"), "_x"),
                         "topk_rows")


def index(kept: DataFrame, dims: int, shards: int) -> DataFrame:
    """The index of rows (_row, _id, _x) of one length, stored: one row a block."""
    def build(batches):
        ids, rows, vectors = {}, {}, {}
        made = 0

        def cut(shard: int, least: int):
            nonlocal made
            while sum(map(len, ids[shard])) >= least > 0:
                i, r, x = np.concatenate(ids[shard]), np.concatenate(rows[shard]), np.concatenate(vectors[shard])
                ids[shard], rows[shard], vectors[shard] = [i[BLOCK:]], [r[BLOCK:]], [x[BLOCK:]]
                i, r, x = i[:BLOCK], r[:BLOCK], x[:BLOCK]
                segments, postings, levels, tails = _cut(x)
                parts = [i, r, x.astype(np.int64), segments, postings, levels, tails]
                made += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([0], pa.int32()), pa.array([made], pa.int64()), pa.array([dims], pa.int32()),
                     *[pa.array([p.tobytes()], pa.binary()) for p in parts]],
                    names=["shard", "kind", "part", "dims", "ids", "rows", "vectors", "segments", "postings", "levels", "tails"])

        for batch in batches:
            shard = np.asarray(batch.column(0), dtype=np.int64)
            row, id_, x = np.asarray(batch.column(1), dtype=np.int64), np.asarray(batch.column(2), dtype=np.int64), matrix(batch, dims)
            for s in np.unique(shard).tolist():
                here = shard == s
                for store, part in ((ids, id_), (rows, row), (vectors, x)):
                    store.setdefault(s, []).append(part[here])
                yield from cut(s, BLOCK)
        for s in list(ids):
            yield from cut(s, 1)

    dealt = kept.where(F.size("_x") == dims).select(F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("shard"), "_row", "_id", "_x")
    return staging.store(dealt.repartition(shards, "shard").mapInArrow(build, INDEX), "topk_index")


def query_blocks(asked: DataFrame, dims: int) -> DataFrame:
    """Queries (_row, _id, _x) packed to blocks, in the columns of the index."""
    def pack(batches):
        rows, ids, vectors = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dims), np.int64)

        def block(n: int) -> pa.RecordBatch:
            parts = [ids[:n], rows[:n], vectors[:n]]
            empty = pa.array([b""], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([int(rows[0])], pa.int64()), pa.array([dims], pa.int32()),
                 *[pa.array([p.tobytes()], pa.binary()) for p in parts], empty, empty, empty, empty],
                names=["shard", "kind", "part", "dims", "ids", "rows", "vectors", "segments", "postings", "levels", "tails"])

        for batch in batches:
            rows = np.concatenate((rows, np.asarray(batch.column(0), dtype=np.int64)))
            ids = np.concatenate((ids, np.asarray(batch.column(1), dtype=np.int64)))
            vectors = np.concatenate((vectors, matrix(batch, dims)))
            while len(rows) >= QUERIES:
                yield block(QUERIES)
                rows, ids, vectors = rows[QUERIES:], ids[QUERIES:], vectors[QUERIES:]
        if len(rows):
            yield block(len(rows))

    return staging.store(asked.where(F.size("_x") == dims).select("_row", "_id", "_x").mapInArrow(pack, INDEX), "topk_queries")


def search(blocks: DataFrame, asked: DataFrame, shards: int, k: int) -> DataFrame:
    """(query_row, query_id, vec_id, row, score): each shard's k best for each query."""
    def run(batches):
        held, names = {}, ["query_row", "query_id", "vec_id", "row", "score"]
        for batch in batches:
            for r in range(batch.num_rows):
                shard, kind, dims = (batch.column(i)[r].as_py() for i in (0, 1, 3))
                raw = [batch.column(i)[r].as_buffer() for i in range(4, 11)]
                ids, rows = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[1], np.int64)
                x = np.frombuffer(raw[2], np.int64).reshape(-1, dims)
                if kind == 0:
                    if shard not in held:       # sorted by shard: those before are done
                        held = {shard: []}
                    held[shard].append(Block(ids.copy(), rows.copy(), x.copy(), np.frombuffer(raw[3], np.int64).reshape(-1, 3).copy(),
                                             np.frombuffer(raw[4], np.int32).copy(), np.frombuffer(raw[5], np.int64).copy(),
                                             np.frombuffer(raw[6], float).reshape(-1, len(ids)).copy()))
                    continue
                if shard not in held:
                    continue
                found = Search(rows, x, k)
                for block in held[shard]:
                    found.meet(block)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (rows[found.at], ids[found.at], found.id, found.row, found.score)], names=names)

    spread = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*blocks.columns)
    met = blocks.unionByName(spread).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "part")
    return met.mapInArrow(run, "query_row long, query_id long, vec_id long, row long, score long")


def top_k(rows: DataFrame, queries: str = "_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest integer inner product with each query.

    Entries count as the floor of ``scale`` times them. ``queries`` is a SQL
    condition on the id, called ``_id``; a query's candidates are all rows but
    itself, ties go to the smaller id. Rows without an id, or whose vector is
    null, empty, holds an entry that is null or not finite, or has a squared
    length of 2^62 or more once scaled take no part. Vectors are compared with
    those of equal length. Rows repeated with the same id are candidates of each
    other, each a query of its own. Fewer candidates than ``k`` all return; an
    empty table gives no row. Other columns are ignored.
    """
    spark = rows.sparkSession
    kept = integer_rows(rows, id_col, vec_col, scale)
    found = []
    for r in kept.groupBy(F.size("_x").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect():
        dims, n = r["d"], r["n"]
        most = max(BLOCK, SHARD_BYTES // (4 * dims))
        shards = max(math.ceil(n / most), min(math.ceil(n / BLOCK), 2 * spark.sparkContext.defaultParallelism))
        found.append(search(index(kept, dims, shards), query_blocks(kept.where(queries), dims), shards, k))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
