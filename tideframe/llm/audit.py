"""How filters overlap, audited for every order in which they may run.

A document's mask has one bit for each filter it fails and two for its labels.
A mask stands for one big integer: a field of ``BITS`` bits for each count at
each step of each order (120 orders of 5 steps make 600), holding 0 or 1. Adding
the integers of the documents of a part adds all its counts at once. No field
can run over into the next: none exceeds the number of documents, which the
topmost field counts and which is checked before unpacking.

Masks are found in Spark. A copy is told from the first of its texts by joining
(id, digest) pairs to the smallest id of each digest, so a text that a third of
the documents share is spread by their ids. Tasks add integers over their rows,
lanes add the sums of tasks, and one integer a lane and part is left at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BITS = 64
LANES = 16
PARTS = 256         # integers a task holds before it passes them on
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")

#: Conditions under which a text (never null here) fails; words are split at ASCII white space.
Filters = Mapping[str, Callable[[Column, Column], Column]]
FILTERS: Filters = {
    "A": lambda text, words: F.size(words) < 100,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
    "C": lambda text, words: 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))) > 10 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
COPIES = "E"


def outcomes(names: str) -> list[np.ndarray]:
    """By mask (a bit for each name, then good, then toxic): orders x steps x COUNTS of 0 and 1."""
    k = len(names)
    orders = np.array(list(permutations(range(k))), dtype=np.int64).reshape(-1, k)
    out = []
    for mask in range(1 << (k + 2)):
        fails = (mask >> orders) & 1
        gone = np.cumsum(fails, axis=1) > 0
        before = np.concatenate((np.zeros((len(orders), 1), dtype=bool), gone[:, :-1]), axis=1)
        removed = (fails == 1) & ~before
        alone = (fails == 1) & (fails.sum(axis=1, keepdims=True) == 1)
        out.append(np.stack((~gone, removed, (fails == 1) & before, alone, removed & bool(mask >> k & 1),
                             removed & bool(mask >> k + 1 & 1)), axis=2))
    return out


def packed(names: str) -> list[int]:
    """The integer of each mask; its topmost field is 1, for the document itself."""
    out = []
    for counts in outcomes(names):
        fields = np.zeros((counts.size + 1, BITS // 8), dtype=np.uint8)
        fields[:-1, 0] = counts.ravel()
        fields[-1, 0] = 1
        out.append(int.from_bytes(fields.tobytes(), "little"))
    return out


def unpacked(total: int, names: str) -> np.ndarray:
    """orders x steps x COUNTS of a sum of such integers."""
    k = len(names)
    orders = len(list(permutations(names)))
    fields = orders * k * len(COUNTS)
    if total >> (fields * BITS) >= 1 << 63:
        raise OverflowError("more documents than a field can count")
    raw = total.to_bytes((fields + 1) * BITS // 8, "little")
    return np.frombuffer(raw, dtype=np.int64)[:-1].reshape(orders, k, len(COUNTS))


def masks(docs: DataFrame, filters: Filters = FILTERS, copies: str | None = COPIES, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "lang") -> DataFrame:
    """(_id, _part, _mask, _n): how many documents of an id and part have each mask.

    Bits follow the names in ``filters``, then ``copies``: the text is that of
    a document with a smaller id. A null text is empty. A document without an id
    is larger than none and smaller than none.
    """
    rows = docs.select(F.col(q(id_col)).alias("_id"), F.coalesce(F.col(q(part_col)).cast("string"), F.lit("")).alias("_part"),
                       F.coalesce(F.col(q(text_col)).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.when(fails(F.col("_text"), F.col("_words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int").alias("_mask")
    if not copies:
        return rows.select("_id", "_part", mask).groupBy("_id", "_part", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    rows = staging.store(rows.select("_id", "_part", mask, F.unhex(F.sha2("_text", 256)).alias("_digest")), "audit")
    first = rows.where(F.col("_id").isNotNull()).groupBy("_digest").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    rows = rows.groupBy("_id", "_digest", "_part", "_mask").agg(F.count(F.lit(1)).alias("_n")).join(first, ["_id", "_digest"], "left")
    copy = F.when(F.col("_id").isNotNull() & F.col("_first").isNull(), 1 << len(filters)).otherwise(0)
    return rows.groupBy("_id", "_part", (F.col("_mask") + copy).cast("int").alias("_mask")).agg(F.sum("_n").alias("_n"))


def interactions(docs: DataFrame, labels: DataFrame, filters: Filters = FILTERS, copies: str | None = COPIES, id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "lang", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """Per part, order of the filters and step: documents kept after the step, removed
    by it, redundant (failing its filter, gone already), unique_fails (failing no
    other filter), good_lost and toxic_lost (removed here with that label at 1),
    and shapley, the filter's removals added over all orders.

    ``filters`` are named by one letter each, ``copies`` names the filter on
    repeated texts (None for none); five filters make 120 orders, and both the
    integers and the result grow with the factorial. Null and empty texts are
    equal and empty; a null part is the empty string; documents without a label
    count in no loss; several labels of an id count as 1 if any is. Rows repeated
    with the same id and text all count, none as the other's copy. An empty table
    gives no row. Other columns of both tables are ignored, whatever their names.
    """
    names = "".join(filters) + (copies or "")
    if len(set(names)) != len(names) or any(len(n) != 1 for n in filters):
        raise ValueError("name each filter by one letter of its own")
    k = len(names)
    labelled = labels.select(F.col(q(id_col)).alias("_id"), *[(F.col(q(c)) == 1).alias(a) for c, a in ((good_col, "_good"), (toxic_col, "_toxic"))])
    labelled = labelled.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_good").alias("_good"), F.max("_toxic").alias("_toxic"))
    rows = masks(docs, filters, copies, id_col, text_col, part_col).join(labelled, "_id", "left")
    mask = F.col("_mask") + F.when(F.col("_good"), 1 << k).otherwise(0) + F.when(F.col("_toxic"), 2 << k).otherwise(0)
    rows = rows.select("_part", mask.cast("int").alias("_mask"), "_n")
    size = (len(list(permutations(names))) * k * len(COUNTS) + 2) * BITS // 8

    def sent(totals: dict[str, int]) -> pa.RecordBatch:
        lane = TaskContext.get().partitionId() % LANES
        return pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.string()), "lane": pa.array([lane] * len(totals), pa.int32()),
                                           "sums": pa.array([t.to_bytes(size, "little") for t in totals.values()], pa.binary())})

    def count(batches):
        integers, totals = packed(names), {}
        for batch in batches:
            part = batch.column(0).dictionary_encode()
            cells = np.asarray(part.indices, dtype=np.int64) * len(integers) + np.asarray(batch.column(1), dtype=np.int64)
            which, at = np.unique(cells, return_inverse=True)
            many = np.zeros(len(which), dtype=np.int64)
            np.add.at(many, at, np.asarray(batch.column(2), dtype=np.int64))
            values = part.dictionary.to_pylist()
            for cell, n in zip(which.tolist(), many.tolist()):
                name = values[cell // len(integers)]
                totals[name] = totals.get(name, 0) + n * integers[cell % len(integers)]
                if len(totals) > PARTS:
                    yield sent(totals)
                    totals = {}
        if totals:
            yield sent(totals)

    def add(batches):
        totals = {}
        for batch in batches:
            for name, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
                totals[name] = totals.get(name, 0) + int.from_bytes(sums.as_buffer(), "little")
                if len(totals) > PARTS:
                    yield sent(totals)
                    totals = {}
        if totals:
            yield sent(totals)

    def report(batches):
        orders = ["".join(o) for o in permutations(names)]
        filter_at = np.array([[names.index(c) for c in o] for o in orders])

        def rows_of(name: str, total: int) -> pa.RecordBatch:
            counts = unpacked(total, names)
            shapley = np.array([counts[:, :, 1][filter_at == i].sum() for i in range(k)])
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(orders) * k), pa.array(np.repeat(orders, k).tolist(), pa.string()),
                 pa.array(np.tile(np.arange(1, k + 1), len(orders)), pa.int32()),
                 *[pa.array(counts[:, :, i].ravel()) for i in range(len(COUNTS))], pa.array(shapley[filter_at].ravel())],
                names=["part", "filter_order", "step", *COUNTS, "shapley"])

        name, total = None, 0           # sorted by part, so one sum at a time
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
                if part != name and name is not None:
                    yield rows_of(name, total)
                    total = 0
                name, total = part, total + int.from_bytes(sums.as_buffer(), "little")
        if name is not None:
            yield rows_of(name, total)

    sums = "part string, lane int, sums binary"
    laned = rows.mapInArrow(count, sums).repartition("part", "lane").mapInArrow(add, sums)
    return laned.repartition("part").sortWithinPartitions("part").mapInArrow(report, SCHEMA)
