"""Repeated lines, kept count of so that documents can come and go.

The exact part is two tables: references, a row for each line key and document
that holds it, and counts, a row for each key with its number of documents and
the largest id. Beside them stand cuckoo filters, one per shard of the keys,
that hold the keys found often enough. Inserting and deleting documents changes
references and counts exactly, and the filters by the keys that cross the
bound, so any order of the two leads to the same index. When lines are dropped
the filters sort out what cannot be repeated, and only the rest meets the counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm import text as tx

SLOTS = 4
SHARD_KEYS = 32_768
FILTER_BYTES = 64 << 20     # filters beyond this are not sent round; every line then meets the counts


class Cuckoo:
    """16-bit fingerprints in buckets of four; keys are pairs of 64-bit numbers."""

    def __init__(self, table: np.ndarray):
        self.table = table.reshape(-1, SLOTS)
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def of(cls, keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(keys / SLOTS / 0.5).bit_length())
        return cls(np.zeros(buckets * SLOTS, dtype=np.uint16))

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k1, k2 = (np.asarray(k).astype(np.int64).view(np.uint64) for k in (k1, k2))
        print_ = np.maximum(k2 & np.uint64(0xFFFF), 1).astype(np.uint16)
        one = (k1 >> np.uint64(8)) & self.mask
        return print_, one.astype(np.int64), self._other(one, print_).astype(np.int64)

    def _other(self, bucket: np.ndarray, print_: np.ndarray) -> np.ndarray:
        return (bucket.astype(np.uint64) ^ tx.mix(print_.astype(np.uint64))) & self.mask

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        print_, one, two = self.places(k1, k2)
        return (self.table[one] == print_[:, None]).any(1) | (self.table[two] == print_[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """False if a key found no place; the filter is then to be made anew, larger."""
        return all(self._put(p, a, b) for p, a, b in zip(*self.places(k1, k2)))

    def _put(self, print_, one, two) -> bool:
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        bucket = two
        for kick in range(500):
            slot = (kick * 7 + int(bucket)) % SLOTS
            self.table[bucket, slot], print_ = print_, self.table[bucket, slot]
            bucket = int(self._other(np.array([bucket]), np.array([print_]))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = print_
                return True
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        for print_, one, two in zip(*self.places(k1, k2)):
            for bucket in (one, two):
                at = np.flatnonzero(self.table[bucket] == print_)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break

    @classmethod
    def holding(cls, k1: np.ndarray, k2: np.ndarray) -> Cuckoo:
        room = len(k1)
        while True:
            out = cls.of(room)
            if out.insert(k1, k2):
                return out
            room = 2 * room + 1


@dataclass
class Index:
    refs: DataFrame         # doc_id, k1, k2
    counts: DataFrame       # shard, k1, k2, n, last
    filters: DataFrame      # shard, bits
    shards: int
    min_docs: int
    min_chars: int


def lines(part: pa.RecordBatch, text: str = "text"):
    """(row, begin, end, key begin, key end, code points of the key) of every line, and the bytes."""
    data, offsets = tx.utf8(part.column(part.schema.get_field_index(text)))
    breaks = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    begin = np.concatenate((offsets[:-1], breaks + 1))
    row = np.concatenate((np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1))
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    last = np.append(row[1:] != row[:-1], True)[:len(row)]
    end = np.where(last, offsets[row + 1], np.append(begin[1:], 0)[:len(row)] - 1)
    solid = np.flatnonzero(~tx.SPACE[data])
    left = np.append(solid, len(data))[np.searchsorted(solid, begin)]
    right = np.append(-1, solid)[np.searchsorted(solid, end)] + 1
    left = np.minimum(left, end)
    right = np.maximum(right, left)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return data, row, begin, end, left, right, points[right] - points[left]


def _keys(data, left, right) -> tuple[np.ndarray, np.ndarray]:
    return (tx.folded_hashes(data, left, right).view(np.int64),
            tx.folded_hashes(data, left, right, 1).view(np.int64))


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(q(id_col)).alias("doc_id"), F.xxhash64(F.col(q(text_col))).alias("tk"),
                       F.col(q(text_col)).alias("text"))


def line_keys(named: DataFrame, min_chars: int, filters: dict | None = None, shards: int = 1) -> DataFrame:
    """(doc_id, tk, k1, k2): the distinct keys of each text's lines of ``min_chars`` code
    points or more, stripped of white space and A-Z lower-cased; with filters, of those they hold."""
    sent = named.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def read(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                data, row, _, _, left, right, points = lines(part)
                long = points >= min_chars
                row, (k1, k2) = row[long], _keys(data, left[long], right[long])
                if sent is not None:
                    row, k1, k2 = (x[_held(sent.value, shards, k1, k2)] for x in (row, k1, k2))
                order = np.lexsort((k2, k1, row))
                row, k1, k2 = row[order], k1[order], k2[order]
                first = np.append(True, (row[1:] != row[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))[:len(row)]
                at = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at),
                                                  pa.array(k1[first]), pa.array(k2[first])], ["doc_id", "tk", "k1", "k2"])

    return tx.small_batches(named).mapInArrow(read, T.StructType([named.schema["doc_id"]]).add("tk", "long").add("k1", "long").add("k2", "long"))


def _held(filters: dict, shards: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(k1), dtype=bool)
    shard = k1 % shards
    for s in np.unique(shard):
        if int(s) in filters:
            own = shard == s
            out[own] = Cuckoo(np.frombuffer(filters[int(s)], dtype=np.uint16)).holds(k1[own], k2[own])
    return out


def _counts(refs: DataFrame, shards: int) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")) \
        .select(F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", "k2", "n", "last")


def _filters(often: DataFrame) -> DataFrame:
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        made = Cuckoo.holding(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "bits": [made.table.tobytes()]})

    return often.select("shard", "k1", "k2").groupBy("shard").applyInPandas(make, "shard int, bits binary")


def build(docs: DataFrame, min_docs: int = 5, min_chars: int = 40, id_col: str = "doc_id",
          text_col: str = "text", shards: int | None = None) -> Index:
    """The index of ``docs``. A null id counts as one document. Without ``shards``
    there are so many that a shard's filter starts with SHARD_KEYS keys at most."""
    found = line_keys(_named(docs, id_col, text_col), min_chars)
    refs = staging.store(found.select("doc_id", "k1", "k2").distinct(), "refs")
    if shards is None:
        often = refs.groupBy("k1", "k2").count().where(F.col("count") >= min_docs).count()
        shards = 1 << max(4, (often // SHARD_KEYS).bit_length())
    counts = staging.store(_counts(refs, shards), "counts")
    filters = staging.store(_filters(counts.where(F.col("n") >= min_docs)), "filters")
    return Index(refs, counts, filters, shards, min_docs, min_chars)


def _changed(index: Index, refs: DataFrame, touched: DataFrame) -> Index:
    """The index with new references; ``touched`` are the keys whose references changed."""
    refs = staging.store(refs, "refs")
    touched = staging.store(touched.select("k1", "k2").distinct(), "touched")
    fresh = staging.store(_counts(refs.join(touched, ["k1", "k2"], "left_semi"), index.shards), "fresh")
    counts = staging.store(index.counts.join(touched, ["k1", "k2"], "left_anti")
                           .select("shard", "k1", "k2", "n", "last").unionByName(fresh), "counts")
    key = ["shard", "k1", "k2"]
    was = index.counts.join(touched, ["k1", "k2"], "left_semi").where(F.col("n") >= index.min_docs).select(*key)
    now = fresh.where(F.col("n") >= index.min_docs).select(*key)
    moves = now.join(was, key, "left_anti").withColumn("put", F.lit(True)).unionByName(
        was.join(now, key, "left_anti").withColumn("put", F.lit(False)))

    def move(key, old: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        put = pdf["put"].to_numpy(dtype=bool)
        out = Cuckoo(np.frombuffer(old["bits"].iloc[0], dtype=np.uint16).copy()) if len(old) else Cuckoo.of(SHARD_KEYS // 8)
        k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
        out.delete(k1[~put], k2[~put])
        fits = out.insert(k1[put], k2[put])
        return pd.DataFrame({"shard": [key[0]], "bits": [out.table.tobytes() if fits else None]})

    filters = staging.store(index.filters.groupBy("shard").cogroup(moves.groupBy("shard"))
                            .applyInPandas(move, "shard int, bits binary"), "filters")
    full = filters.where("bits is null").select("shard")
    again = _filters(counts.where(F.col("n") >= index.min_docs).join(full, "shard", "left_semi"))
    filters = staging.store(filters.where("bits is not null").unionByName(again), "filters")
    return Index(refs, counts, filters, index.shards, index.min_docs, index.min_chars)


def insert(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with more documents; what it holds already is not counted twice."""
    found = line_keys(_named(docs, id_col, text_col), index.min_chars).select("doc_id", "k1", "k2").distinct()
    old = index.refs.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    new = staging.store(found.join(old, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1"))
                                   & (F.col("k2") == F.col("_k2")), "left_anti"), "new")
    return _changed(index, index.refs.unionByName(new), new)


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the documents named in the first column of ``ids``."""
    gone = ids.select(F.col(q(ids.columns[0])).alias("_id")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    return _changed(index, index.refs.join(gone, same, "left_anti"), index.refs.join(gone, same, "left_semi"))


def cleaned(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for every row: its text without the lines
    whose key is in ``min_docs`` documents or more, unless its id is the key's largest.

    Null and empty texts are one empty line. Rows that repeat an id share its
    lines; rows with a null id are never the largest unless all of a key's are.
    No rows give no rows. Other columns are not read.
    """
    named = _named(docs, id_col, text_col)
    size = index.filters.agg(F.sum(F.length("bits"))).first()[0] or 0
    filters = {r["shard"]: bytes(r["bits"]) for r in index.filters.collect()} if size <= FILTER_BYTES else None
    maybe = line_keys(named, index.min_chars, filters, index.shards).distinct()
    often = index.counts.where(F.col("n") >= index.min_docs).select("k1", "k2", "last")
    drops = maybe.join(often, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("last"))) \
        .groupBy("doc_id", "tk").agg(F.collect_list("k1").alias("d1"), F.collect_list("k2").alias("d2")) \
        .select(F.col("doc_id").alias("_id"), F.col("tk").alias("_tk"), "d1", "d2")
    rows = named.join(drops, (F.col("tk") == F.col("_tk")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left") \
        .select("doc_id", "text", "d1", "d2")
    min_chars = index.min_chars

    def cut(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                texts = part.column(1).fill_null("").to_pylist()
                data, row, begin, end, left, right, points = lines(part)
                total = np.bincount(row, minlength=part.num_rows)
                dropped = np.zeros(part.num_rows, dtype=np.int64)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                longs = np.flatnonzero(points >= min_chars)
                keys = _keys(data, left[longs], right[longs])
                for i in np.flatnonzero(np.asarray(part.column(2).is_valid())):
                    away = set(zip(part.column(2)[i].as_py(), part.column(3)[i].as_py()))
                    own = np.arange(first[i], first[i + 1])
                    mine = slice(*np.searchsorted(longs, first[i:i + 2]))
                    long, k1, k2 = longs[mine], keys[0][mine], keys[1][mine]
                    gone = {at for at, *k in zip(long.tolist(), k1.tolist(), k2.tolist()) if tuple(k) in away}
                    texts[i] = b"\n".join(data[begin[at]:end[at]].tobytes() for at in own.tolist() if at not in gone).decode()
                    dropped[i] = len(gone)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(total), pa.array(dropped), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_lines", "n_dropped", "kept"])

    return tx.small_batches(rows).mapInArrow(cut, T.StructType([named.schema["doc_id"]]).add("n_lines", "long").add("n_dropped", "long")
                           .add("kept", "string"))
