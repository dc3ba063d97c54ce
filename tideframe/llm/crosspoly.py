"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the largest coordinate with its sign. A table joins a few
such hashes to a bucket, and each vector also probes the buckets that its
second-largest coordinates would have given. Enough tables are taken, by
simulation on the driver, that a pair at the similarity sought is missed less
often than ``miss``. Within a bucket all cosines are taken in double precision,
in blocks of bounded size on both sides; a block returns counts and spanning
links, never pairs. A pair that meets in several buckets counts in the first.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm.graph import components

BLOCK = 256
LOAD = 1_024        # vectors to a bucket, were they spread evenly
CHUNK = 50_000


class Hash:
    """``tables`` x ``width`` cross-polytope hashes of vectors of ``dims`` numbers."""

    def __init__(self, dims: int, tables: int, width: int, seed: int = 42):
        self.dims, self.side, self.tables, self.width = dims, 1 << max(1, (dims - 1).bit_length()), tables, width
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], size=(tables * width, 3, self.side))

    def _turned(self, x: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros((len(x), self.side))
        out[:, :self.dims] = x
        for signs in self.signs[at]:
            out *= signs
            half = 1
            while half < self.side:
                pair = out.reshape(len(x), -1, 2, half)
                out = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(len(x), -1)
                half *= 2
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x (1 + width): the own bucket, then the probed ones."""
        n, step = len(x), 2 * self.side
        out = np.zeros((n, self.tables, 1 + self.width), dtype=np.int64)
        for t in range(self.tables):
            best = np.zeros((self.width, 2, n), dtype=np.int64)
            for w in range(self.width):
                y = self._turned(x, t * self.width + w)
                top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
                value = np.take_along_axis(y, top, 1)
                swap = np.abs(value[:, 1]) > np.abs(value[:, 0])
                top[swap], value[swap] = top[swap][:, ::-1], value[swap][:, ::-1]
                best[w] = (2 * top + (value < 0)).T
            power = step ** np.arange(self.width)
            own = (best[:, 0] * power[:, None]).sum(0)
            out[:, t, 0] = own
            for w in range(self.width):
                out[:, t, 1 + w] = own + (best[w, 1] - best[w, 0]) * power[w]
        return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """rows x tables x 3: own bucket shared, b's own probed by a, a's own probed by b."""
    return np.stack((a[:, :, 0] == b[:, :, 0], (a[:, :, 1:] == b[:, :, :1]).any(2), (b[:, :, 1:] == a[:, :, :1]).any(2)), 2)


def tables_for(dims: int, width: int, cosine: float, miss: float, pairs: int = 4_000) -> int:
    """Tables after which pairs at ``cosine`` are missed less often than ``miss``."""
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, pairs, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-300)[:, None]
    hash_ = Hash(dims, 1, width, seed=11)
    found = _met(hash_.codes(a), hash_.codes(cosine * a + math.sqrt(1 - cosine ** 2) * b)).any((1, 2)).mean()
    return max(2, math.ceil(math.log(miss) / math.log(max(1e-9, 1 - min(found, 1 - 1e-9)))))


def unit_vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, node, unit, dims) of rows (vec_id, embedding): unit has length 1; all
    but vec_id are null where the vector is null, empty, zero or not finite throughout."""
    def scale(batches):
        for batch in batches:
            units, nodes = [], []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], dtype=float) if v else np.full(1, np.nan)
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                x = x / top if top > 0 else x       # so that squares neither vanish nor overflow
                units.append(x / np.sqrt((x * x).sum()) + 0.0 if top > 0 else None)
                nodes.append(hashlib.md5(units[-1].tobytes()).digest() if top > 0 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.binary()), pa.array(units, pa.list_(pa.float64())),
                 pa.array([None if u is None else len(u) for u in units], pa.int32())], ["vec_id", "node", "unit", "dims"])

    return rows.mapInArrow(scale, T.StructType([rows.schema["vec_id"]]).add("node", "binary")
                           .add("unit", T.ArrayType(T.DoubleType())).add("dims", "integer"))


def _block(left: pd.DataFrame, right: pd.DataFrame, table: int, cosine: float) -> pd.DataFrame:
    """For the pairs at ``cosine`` that meet here first: (a, null, weight linked) by node, and spanning
    links (a, b, null). ``right`` are the bucket's own vectors, ``left`` also those that probe it."""
    x, y = np.stack(left["unit"].to_numpy()), np.stack(right["unit"].to_numpy())
    shape = [int(n) for n in left["shape"].iloc[0]]
    a, b = (np.frombuffer(b"".join(df["codes"]), dtype=np.int64).reshape(-1, *shape) for df in (left, right))
    names, place = np.unique(np.concatenate((left["node"].to_numpy(), right["node"].to_numpy())), return_inverse=True)
    p, r = place[:len(x)], place[len(x):]
    wx, wy = left["weight"].to_numpy(dtype=float), right["weight"].to_numpy(dtype=float)
    links, joined = np.zeros(len(names)), np.arange(len(names))

    def root(n: int) -> int:
        while joined[n] != n:
            joined[n] = joined[joined[n]]
            n = joined[n]
        return n

    spans = []
    rows, cols = np.nonzero(x @ y.T >= cosine)
    for at in range(0, len(rows), CHUNK):
        i, j = rows[at:at + CHUNK], cols[at:at + CHUNK]
        lower, same = p[i] < r[j], a[i, table, 0] == b[j, table, 0]
        met = _met(a[i], b[j])
        met[~lower] = met[~lower][:, :, [0, 2, 1]]                  # as seen from the lower name
        here = table * 3 + np.where(same, 0, np.where(lower, 1, 2))
        new = (met.reshape(len(i), -1).argmax(1) == here) & (p[i] != r[j]) & (lower | ~same)
        i, j = i[new], j[new]
        links += np.bincount(p[i], wy[j], len(names)) + np.bincount(r[j], wx[i], len(names))
        for m, n in zip(p[i].tolist(), r[j].tolist()):
            m, n = root(m), root(n)
            if m != n:
                joined[max(m, n)] = min(m, n)
                spans.append((names[m], names[n], np.nan))
    some = np.flatnonzero(links)
    return pd.DataFrame([*zip(names[some], [None] * len(some), links[some]), *spans], columns=["a", "b", "links"])


def near_vectors(df: DataFrame, cosine: float = 0.95, miss: float = 0.001, id_col: str = "vec_id",
                 vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    n_links counts the other rows at ``cosine`` or more, copies too; component_id
    is the smallest id reachable by links, itself included; kept marks the row
    that has it. Vectors that are null, empty, zero or hold null or non-finite
    numbers link with nothing; so do vectors of different lengths with each
    other. Copies and repeated rows are one vector with a weight; where the
    smallest id repeats, each of its rows is kept. Null ids never name a
    component unless it holds no other. No rows give no rows. The hash width
    follows the number of vectors, so that buckets stay small; a pair right at
    ``cosine`` is missed with probability ``miss``, nearer ones much more rarely.
    """
    rows = staging.store(unit_vectors(df.select(F.col(q(id_col)).alias("vec_id"), F.col(q(vector_col)).alias("embedding"))),
                         "units")
    nodes = staging.store(rows.where("node is not null").groupBy("node").agg(
        F.first("unit").alias("unit"), F.first("dims").alias("dims"), F.count(F.lit(1)).alias("weight"),
        F.min("vec_id").alias("least_id")), "nodes")
    kinds = {r["dims"]: r["n"] for r in nodes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashes = {}
    for dims, n in kinds.items():
        side = 2 << max(1, (dims - 1).bit_length())
        width = max(1, math.ceil(math.log(max(1, n / LOAD)) / math.log(side)))
        hashes[dims] = Hash(dims, tables_for(dims, width, cosine, miss), width, seed)

    def place(batches):
        for pdf in batches:
            for dims, part in pdf.groupby("dims"):
                hash_ = hashes[dims]
                codes = hash_.codes(np.stack(part["unit"].to_numpy()))
                packed, shape = [c.tobytes() for c in codes], [list(codes.shape[1:])] * len(part)
                for t in range(hash_.tables):
                    for w in range(1 + hash_.width):
                        yield pd.DataFrame({"node": part["node"], "unit": part["unit"], "codes": packed, "shape": shape,
                                            "weight": part["weight"], "dims": dims, "t": t, "bucket": codes[:, t, w], "own": w == 0})

    fields = "node binary, unit array<double>, codes binary, shape array<int>, weight long, dims int, t int, bucket long, own boolean"
    placed = staging.store(nodes.select("node", "unit", "weight", "dims").mapInPandas(place, fields), "placed")
    key = ["dims", "t", "bucket"]
    counts = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("own").cast("int")) / BLOCK).cast("int").alias("parts"),
                                      F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("outs"),
                                      F.count(F.lit(1)).alias("size")).where("parts > 0 and size > 1").drop("size")
    dealt = placed.join(counts, key)
    salt = F.xxhash64("node")
    base = ["node", "unit", "codes", "weight"]
    left = dealt.select(*key, F.pmod(salt, "outs").cast("int").alias("out"), *base, "shape",
                        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = dealt.where("own").select(*key, F.pmod(salt, "parts").cast("int").alias("part"), *base,
                                      F.explode(F.sequence(F.lit(0), F.col("outs") - 1)).alias("out"))
    left, keys = left.toDF(*left.columns), [*key, "out", "part"]

    def compare(key, one: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(own):
            return pd.DataFrame({"a": [], "b": [], "links": []})
        return _block(one, own, int(key[1]), cosine)

    met = staging.store(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        compare, "a binary, b binary, links double"), "met")
    tally = met.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").cast("long").alias("links"))
    found = components(met.where("b is not null").select("a", "b"))
    named = nodes.select("node", "weight", "least_id").join(found, "node", "left").join(tally, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of = named.join(least, "component").select("node", "component_id",
                                               (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.select("vec_id", "node").join(of, "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"))
