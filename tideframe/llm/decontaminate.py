"""Benchmark passages found by spaced seeds, with plain DataFrame functions.

A mask keeps some token positions of a window and ignores the others, so a
window still matches when ignored tokens were replaced. Benchmark and text
windows are hashed under each mask at every token, and equal hashes join. Each
hit lays the two texts alongside: it counts when some stretch of WINDOW tokens
(or the whole item, if shorter) has three quarters of its tokens equal, place
by place. The masks of a family are chosen so that no replacements within this
rule can hit all of their places: whatever counts is found. Items of few tokens
need shorter masks, which the texts are hashed under only if there are such items.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm import text as tx

WINDOW = 16
#: (least tokens of an item, masks), by that number. Masks that serve n tokens of which k were replaced serve n + 1 with k, too, and n - 1 with k - 1.
FAMILIES = ((1, ("1",)), (2, ("11",)), (3, ("111",)), (4, ("111", "1011", "1101")), (8, ("11011", "1111", "1100011")),
            (12, ("110111", "110001011", "11010011", "10101100001")), (15, ("110111", "1101000011", "100010000111")))
SMALL = 500_000         # rows that may be broadcast: ids, alignments or hashes of benchmark windows; some 100 MB


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _at(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def _window(t: Column, mask: str, number: int, start: Column) -> Column:
    """Hash of the kept tokens of the window that begins at ``start``, from 0."""
    return F.xxhash64(F.lit(number), *[F.get(t, start + i) for i in _at(mask)])


def _starts(t: Column, mask: str) -> Column:
    """Every start of a whole window."""
    last = F.size(t) - len(mask)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _family(item: Column) -> Column:
    """The place in FAMILIES of an item's masks; null if it has no tokens."""
    out = F.lit(None).cast("int")
    for number, (least, _) in enumerate(FAMILIES):
        out = F.when(F.size(item) >= least, number).otherwise(out)
    return out


def _numbered(families: list[int]) -> list[tuple[int, str]]:
    """The masks of some families, each once, with a number that names it in hashes."""
    every = sorted({m for _, masks in FAMILIES for m in masks})
    return [(i, m) for i, m in enumerate(every) if any(m in FAMILIES[f][1] for f in families)]


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    items = items.select(F.col(q(id_col)).alias("item_id"), _hashed(F.col(q(text_col))).alias("item"))
    return items.withColumn("family", _family(F.col("item")))


def families_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[int]:
    """The places in FAMILIES of those that the items need."""
    rows = _items(items, id_col, text_col).where("family is not null").select("family").distinct().collect()
    return sorted(r["family"] for r in rows)


def seeds(items: DataFrame, id_col: str = "item_id", text_col: str = "text", families: list[int] | None = None) -> DataFrame:
    """(seed, item_id, at): every hash of the benchmark with its place."""
    items = _items(items, id_col, text_col)
    each = [items.where(F.col("family").isin([f for f, (_, masks) in enumerate(FAMILIES) if m in masks]))
            .select("item_id", "item", F.explode_outer(_starts(F.col("item"), m)).alias("at")).where("at is not null")
            .select(_window(F.col("item"), m, i, F.col("at")).alias("seed"), "item_id", "at")
            for i, m in _numbered(list(range(len(FAMILIES))) if families is None else families)]
    return functools.reduce(DataFrame.union, each)


def overlap(text: Column, item: Column, shift: Column) -> tuple[Column, Column]:
    """(matched, best): equal tokens with the item laid on the text at ``shift``,
    and the most of them in one stretch of WINDOW tokens."""
    begin = F.greatest(F.lit(0), -shift)
    many = F.least(F.size(item), F.size(text) - shift) - begin
    same = F.zip_with(F.slice(text, begin + shift + 1, many), F.slice(item, begin + 1, many),
                      lambda x, y: (x == y).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    width = F.least(F.lit(WINDOW), F.size(item))
    runs = F.transform(F.sequence(F.lit(1), many - width + 1), lambda i: total(F.slice(same, i, width)))
    return total(same), F.when(many >= width, F.array_max(runs)).otherwise(0)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, tk, item_id, matched, item_tokens): the benchmark items found in each text.

    tk is a hash of the text, to know the row by where ids repeat or are null.
    matched is the largest number of equal tokens in one alignment. Null and empty
    texts hold nothing, and such items are in none. A token is a run of letters and
    digits, so in a script without spaces a part of a run is not found. Repeated rows are one, equal items are found each for itself, and no rows on
    either side give no rows. Other columns are not read.
    """
    t, item = F.col("t"), F.col("item")
    docs = docs.select(F.col(q(id_col)).alias("doc_id"), F.xxhash64(F.col(q(text_col))).alias("tk"), F.col(q(text_col)).alias("text"))

    def windows(number: int, mask: str) -> Column:
        return F.transform(_starts(t, mask), lambda at: _window(t, mask, number, at))

    # Without any item to find, the last family stands in, so that the plan stays the same.
    families = families_of(items, item_col, item_text) or [len(FAMILIES) - 1]

    # Outer, for a plain explode is given a filter that computes the tokens again for each window; no seed is null.
    rows = docs.select("doc_id", "tk", _hashed(F.col("text")).alias("t")) \
        .select("doc_id", "tk", F.array(*[windows(i, m) for i, m in _numbered(families)]).alias("h")) \
        .select("doc_id", "tk", F.explode_outer("h").alias("h")) \
        .select("doc_id", "tk", F.posexplode_outer("h").alias("place", "seed"))
    known = seeds(items, item_col, item_text, families)
    met = rows.join(_few(known), "seed").select("doc_id", "tk", "item_id", (F.col("place") - F.col("at")).alias("shift"))
    met = met.distinct().groupBy("doc_id", "tk").agg(F.collect_list(F.struct("item_id", "shift")).alias("met"))
    met = staging.store(met.withColumnsRenamed({"doc_id": "_id", "tk": "_tk"}), "met")

    # Once more the texts with hits, each row's tokens beside its alignments.
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tk") == F.col("_tk"))
    texts = docs.join(_few(met), same).select("doc_id", "tk", "met", _hashed(F.col("text")).alias("t"))
    laid = texts.select("doc_id", "tk", "t", F.explode_outer("met").alias("x"))
    whole = items.select(F.col(q(item_col)).alias("_item"), _hashed(F.col(q(item_text))).alias("item"))
    laid = laid.join(_few(whole), F.col("x.item_id").eqNullSafe(F.col("_item")))
    matched, best = overlap(t, item, F.col("x.shift"))
    found = laid.where(best >= F.ceil(F.least(F.lit(WINDOW), F.size(item)) * 0.75))
    return found.groupBy("doc_id", "tk", F.col("x.item_id").alias("item_id")).agg(
        F.max(matched).alias("matched"), F.max(F.size(item)).alias("item_tokens"))


def _few(rows: DataFrame) -> DataFrame:
    """The rows, to be broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns.

    Rows that repeat stay or go together; null and empty texts stay, as does
    everything if there is no item. No rows give no rows.
    """
    id_, tk = tx.unused(docs, "_id", "_tk")
    bad = hits(docs, items, id_col, text_col, **how).select(F.col("doc_id").alias(id_), F.col("tk").alias(tk))
    bad = staging.store(bad.distinct(), "bad")
    same = F.col(q(id_col)).eqNullSafe(F.col(id_)) & (F.xxhash64(F.col(q(text_col))) == F.col(tk))
    return docs.join(_few(bad), same, "left_anti")
