"""Quality by supervised subword embeddings.

A text is the mean of learned vectors, one for each of its words and each
character n-gram (3 to 5 bytes) within them, hashed to a fixed number of rows;
a softmax over it gives the classes. numpy trains it by stochastic gradient
descent on a bounded sample of labelled rows. For scoring, each row of the
embedding is multiplied by the softmax weights beforehand, so a text's logits
are a mean of table entries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideframe.functions.names import q
from tideframe.llm import text as tx

BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
SAMPLE = 4_000          # labelled rows, at most, that the model is fitted on
LABELS = 5_000_000      # label rows (id, class) that may be broadcast: some 100 MB


def held_out(id_: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, label) of rows with an id and a 0 or 1 for a label; an id with several labels has none."""
    own = labels.select(F.col(q(id_col)).alias("_id"), F.col(q(label)).cast("int").alias("label")) \
        .where("_id is not null and label in (0, 1)").groupBy("_id") \
        .agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    if labels.count() <= LABELS:
        own = F.broadcast(own)
    docs = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).alias("text"))
    return docs.join(own, F.col("doc_id") == F.col("_id")).drop("_id")


def drawn(rows: DataFrame, sample: int, seed: int = 42) -> DataFrame:
    """Up to ``sample`` of the rows, by a hash of doc_id. A share a little larger is taken where
    the rows are, so the task that ends the draw reads no more than that from all of them."""
    share = min(1.0, 1.2 * sample / max(1, rows.count()))
    lot = F.xxhash64("doc_id", F.lit(seed))
    return rows.where(F.pmod(lot, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(lot, "doc_id").limit(sample)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and n-gram. An n-gram may begin or end with the
    white space beside a word, which marks its border, but holds none inside."""
    begin, end, first = tx.spans(data, offsets)
    top = np.uint64(64 - (buckets - 1).bit_length())
    out = [(tx.hash_spans(data, begin, end, tx.BYTE) >> top).astype(np.int32)]
    rows = [np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))]
    space = tx.SPACE[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    spaces = np.concatenate(([0], np.cumsum(space, dtype=np.int64)))
    for n in GRAMS:
        many = max(0, len(data) - n + 1)
        at = np.flatnonzero((spaces[n - 1:n - 1 + many] == spaces[1:1 + many]) & (row[:many] == row[n - 1:n - 1 + many]))
        gram = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            gram = (gram << np.uint64(8)) | np.where(space[at + j], 32, data[at + j]).astype(np.uint64)
        out.append(((gram * np.uint64(0x9E3779B97F4A7C15)) >> top).astype(np.int32))
        rows.append(row[at])
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Model:
    table: np.ndarray       # buckets x classes: embedding times softmax weights
    bias: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        """The probability of class 1 of each text."""
        data, offsets = tx.utf8(column)
        bucket, row = features(data, offsets, len(self.table))
        count = np.maximum(1, np.bincount(row, minlength=len(column)))
        margin = (self.table[:, 1] - self.table[:, 0]).astype(np.float64)
        mean = np.bincount(row, margin[bucket], len(column)) / count
        return 1 / (1 + np.exp(-np.clip(mean + self.bias[1] - self.bias[0], -40, 40)))


def _counted(rows: DataFrame, buckets: int) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", tx.BATCH_BYTES // 4):
                data, offsets = tx.utf8(part.column(0))
                bucket, row = features(data, offsets, buckets)
                key, n = np.unique(row.astype(np.int64) * buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) * buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(key[a:b] % buckets).astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     pa.array([n[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                     part.column(1)], ["bucket", "n", "label"])

    return tx.small_batches(rows).select("text", "label").mapInArrow(count, "bucket binary, n binary, label int")


def train(rows: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS, dims: int = 8, epochs: int = 8,
          rate: float = 0.5, seed: int = 42) -> Model:
    """Fit on up to ``sample`` rows of (doc_id, text, label), drawn by a hash of the id. The driver
    holds the sample's feature counts, some 20 KB for a text of a few pages. Classes weigh alike."""
    got = _counted(drawn(rows, sample, seed), buckets).collect()
    seen = [(np.frombuffer(r["bucket"], dtype=np.int32), np.frombuffer(r["n"], dtype=np.float32), r["label"]) for r in got]
    seen = [(b, n / n.sum(), y) for b, n, y in seen if len(b)]
    rng = np.random.default_rng(seed)
    embedding = (rng.random((buckets, dims), dtype=np.float32) - np.float32(0.5)) / np.float32(dims)
    out, bias = np.zeros((dims, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    share = np.bincount([y for _, _, y in seen], minlength=2)
    weigh = len(seen) / np.maximum(1, 2 * share)
    for step, i in enumerate(i for _ in range(epochs) for i in rng.permutation(len(seen))):
        bucket, n, y = seen[i]
        pace = np.float32(rate * (1 - step / (epochs * len(seen))) * min(3.0, weigh[y]))
        hidden = n @ embedding[bucket]
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        p[y] -= 1
        back = out @ p
        out -= pace * np.outer(hidden, p)
        bias -= pace * p
        embedding[bucket] -= (pace * len(bucket) / 50) * n[:, None] * back
    return Model((embedding @ out).astype(np.float32), bias.astype(np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row: the probability of class 1, from the text alone.
    Null and empty texts have no features and get the model's bias. No rows give no rows."""
    rows = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            for part in tx.slices(batch, "text", tx.BATCH_BYTES // 4):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sent.value.scores(part.column(1)))], ["doc_id", "score"])

    return tx.small_batches(rows).mapInArrow(judge, T.StructType([rows.schema["doc_id"]]).add("score", "double"))
