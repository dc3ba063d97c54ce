"""Language by words first, then by ever shorter character n-grams.

Training counts every word of every text by language, and the n-grams (5 down
to 1 characters, with the word's borders) of all words. A known word scores by
its log frequency in each language; an unseen word by the mean of those of its
longest n-grams that are known. Nothing that was counted is dropped: all counts
are a table. The commonest words and n-grams of each language, a bounded number,
also go to every task; what a task does not find among them is looked up in the
table by joins, once for each distinct word of the texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm import text as tx

GRAMS = (5, 4, 3, 2, 1)
WORDS = 50_000          # words of a language sent to every task, at most
PARTS = 20_000          # n-grams of a language and length sent to every task, at most
HOT_SHARE = 1_024       # a word that is more than one in so many of those looked up is joined by broadcast
EDGE = 32
CODES = tx.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the offsets counted in them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    if len(codes) == len(data):
        return codes, offsets
    return codes, np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))[offsets]


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and offsets of the lower-cased texts, everything but letters made a space."""
    codes, offsets = code_points(*tx.utf8(pc.utf8_lower(column.fill_null(""))))
    letter = (codes >= 128) | (codes >= 97) & (codes <= 122) | (codes >= 65) & (codes <= 90)
    return np.where(letter, codes, np.uint32(EDGE)), offsets


def spans(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tx.spans(np.where(codes == EDGE, EDGE, 97).astype(np.uint8), offsets)


def grams(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the word) of the n-grams of words, a space at either border counted
    in; n-grams of one character leave the borders out."""
    edge = int(n > 1)
    many = np.maximum(0, end - begin + 2 * edge - n + 1)
    word = np.repeat(np.arange(len(begin)), many)
    at = np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many) + (begin - edge)[word]
    out = np.full(len(word), n, dtype=np.uint64)
    for j in range(n):
        x = at + j
        inside = (x >= begin[word]) & (x < end[word])
        code = np.where(inside, codes[np.clip(x, 0, max(len(codes) - 1, 0))], EDGE) if len(codes) else np.zeros(0, dtype=np.uint64)
        out = out * np.uint64(0x9E3779B97F4A7C15) + code.astype(np.uint64) + np.uint64(1)
    return tx.mix(out).view(np.int64), word


def word_and_gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, kind, h, n) of rows (lang, text): kind 0 counts words, kind k n-grams of k characters."""
    def count(batches):
        totals: dict = {}
        for batch in batches:
            for part in tx.slices(batch, "text", tx.BATCH_BYTES):
                data, offsets = lowered(part.column(1))
                begin, end, first = spans(data, offsets)
                langs, code = np.unique(np.array(part.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
                of = np.repeat(code, np.diff(first))
                hashes = tx.hash_spans(data, begin, end, CODES).view(np.int64)
                for i, lang in enumerate(langs):
                    own = np.flatnonzero(of == i)
                    words, place, n = np.unique(hashes[own], return_index=True, return_counts=True)
                    _add(totals, (lang, 0), words, n)
                    b, e = begin[own[place]], end[own[place]]
                    for k in GRAMS:
                        h, word = grams(data, b, e, k)
                        keys, inverse = np.unique(h, return_inverse=True)
                        _add(totals, (lang, k), keys, np.bincount(inverse, n[word], len(keys)).astype(np.int64))
                if sum(len(x) for pairs in totals.values() for x, _ in pairs) > 2_000_000:
                    yield from _drain(totals)
        yield from _drain(totals)

    return tx.small_batches(rows).mapInArrow(count, "lang string, kind int, h long, n long")


def _add(totals: dict, key: tuple, hashes: np.ndarray, n: np.ndarray) -> None:
    totals.setdefault(key, []).append((hashes, n))


def _drain(totals: dict):
    for (lang, kind), pairs in totals.items():
        keys, inverse = np.unique(np.concatenate([h for h, _ in pairs]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n for _, n in pairs]), len(keys)).astype(np.int64)
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            size = len(keys[part])
            yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * size), pa.array(np.full(size, kind, dtype=np.int32)),
                                              pa.array(keys[part]), pa.array(n[part])], ["lang", "kind", "h", "n"])
    totals.clear()


@dataclass
class Cache:
    """What goes to every task: the commonest keys of each kind with their log frequencies."""

    langs: list[str] = field(default_factory=list)
    prior: np.ndarray = field(default_factory=lambda: np.zeros(0))
    tables: dict = field(default_factory=dict)      # kind -> (sorted hashes, hashes x langs)

    def find(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return keys[place] == hashes, place

    def sums(self, kind: int, place: np.ndarray, to: np.ndarray, times: np.ndarray | None, n: int) -> np.ndarray:
        """n x langs: log frequencies at ``place``, each ``times`` over, added up where ``to`` says."""
        w = self.tables[kind][1]
        columns = [np.bincount(to, w[place, i] if times is None else w[place, i] * times, n) for i in range(len(self.langs))]
        return np.stack(columns, axis=1).astype(float)


@dataclass
class Model:
    """``table`` has (kind, h, w): the log frequency in each language of everything counted."""

    cache: Cache
    table: DataFrame | None = None


def train(rows: DataFrame, words: int = WORDS, parts: int = PARTS) -> Model:
    """Counts over all rows (lang, text) with a lang. ``words`` and ``parts`` bound what goes to
    every task: the commonest of each language, fewer where counts tie. They change no score."""
    narrow = staging.store(word_and_gram_counts(rows.where("lang is not null")).groupBy("lang", "kind", "h")
                           .agg(F.sum("n").alias("n")), "counts")

    def level(n: Column) -> Column:
        return F.when(n < 64, n).otherwise(F.floor(F.log2(n) * 16) - 32).cast("int")        # rises with n

    rungs = narrow.groupBy("lang", "kind", level(F.col("n")).alias("level")) \
        .agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rungs})
    totals: dict = {}
    least: dict = {}
    for lang, kind in {(r["lang"], r["kind"]) for r in rungs}:
        own = sorted((r for r in rungs if (r["lang"], r["kind"]) == (lang, kind)), key=lambda r: -r["level"])
        at = langs.index(lang)
        totals[at, kind] = sum(r["n"] for r in own)
        fits = np.cumsum([r["keys"] for r in own]) <= (parts if kind else words)
        least[at, kind] = own[int(fits.sum()) - 1]["level"] if fits.any() else own[0]["level"] + 1
    if not totals:
        return Model(Cache())
    counts = staging.store(narrow.groupBy("kind", "h").agg(
        *[F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for i, lang in enumerate(langs)]), "counts")
    learnt = range(len(langs))
    many = {r["kind"]: r["keys"] for r in counts.groupBy("kind").agg(F.count(F.lit(1)).alias("keys")).collect()}

    def of_kind(value) -> Column:
        out = F.lit(None)
        for kind in many:
            out = F.when(F.col("kind") == kind, F.lit(value(kind))).otherwise(out)
        return out

    def weight(at: int) -> Column:
        whole = of_kind(lambda kind: float(np.log(totals.get((at, kind), 0) + 0.5 * many[kind] + 1)))
        return F.log(F.coalesce(F.col(f"n{at}"), F.lit(0)) + 0.5) - whole

    table = counts.select("kind", "h", F.array(*[weight(at) for at in learnt]).alias("w"))
    common = F.lit(False)
    for at in learnt:
        common = common | F.coalesce(level(F.col(f"n{at}")) >= of_kind(lambda kind, at=at: least.get((at, kind))), F.lit(False))
    kept = counts.where(common).select("kind", "h", *[weight(at).alias(f"w{at}") for at in learnt]).toPandas()       # words + 5 x parts for each language at most
    tables = {}
    for kind in (0, *GRAMS):
        own = kept[kept["kind"] == kind].sort_values("h")
        tables[kind] = (own["h"].to_numpy(dtype=np.int64),
                        own[[f"w{at}" for at in learnt]].to_numpy(dtype=float))
    size = np.array([totals.get((at, 0), 0) for at in learnt], dtype=float)
    return Model(Cache(langs, np.log((size + 1) / (size + 1).sum()), tables), table)


def _words(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words as binary, in UTF-8."""
    size = end - begin
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    own = codes[at]
    data = own.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (own >= 0x80) + (own >= 0x800) + (own >= 0x10000)
    offsets = np.concatenate(([0], np.cumsum(width)))[np.concatenate(([0], np.cumsum(size)))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _letters(column: pa.Array, codes: np.ndarray, offsets: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which texts have a letter; beyond ASCII not every character is one."""
    out = np.bincount(doc, minlength=len(column)) > 0
    for i in np.flatnonzero(out):
        own = codes[offsets[i]:offsets[i + 1]]
        if not (own[own < 128] != EDGE).any():
            out[i] = any(c.isalpha() for c in column[i].as_py())
    return out


def _first_look(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """(row, doc_id, total, letters, missed), stored: what the commonest words say of each text, and
    its distinct other words with their counts."""
    kinds = T.StructType([T.StructField("row", T.LongType()), rows.schema["doc_id"]]) \
        .add("total", T.ArrayType(T.DoubleType())).add("letters", T.BooleanType()) \
        .add("missed", T.ArrayType(T.StructType().add("h", T.LongType()).add("n", T.LongType()).add("word", T.BinaryType())))

    def look(batches):
        own, row = sent.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in tx.slices(batch, "text", tx.BATCH_BYTES // 4):
                n = part.num_rows
                codes, offsets = lowered(part.column(1))
                begin, end, first = spans(codes, offsets)
                doc = np.repeat(np.arange(n), np.diff(first))
                hashes = tx.hash_spans(codes, begin, end, CODES).view(np.int64)
                known, place = own.find(0, hashes)
                total = own.sums(0, place[known], doc[known], None, n)
                rest = np.flatnonzero(~known)
                rest = rest[np.lexsort((hashes[rest], doc[rest]))]
                new = np.append(True, (np.diff(doc[rest]) != 0) | (np.diff(hashes[rest]) != 0)) if len(rest) else np.zeros(0, dtype=bool)
                at = np.flatnonzero(new)
                one = rest[at]
                structs = pa.StructArray.from_arrays(
                    [pa.array(hashes[one]), pa.array(np.diff(np.append(at, len(rest)))), _words(codes, begin[one], end[one])], ["h", "n", "word"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[one], np.arange(n + 1)).astype(np.int32)), structs)
                totals = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * len(own.langs)).astype(np.int32)), pa.array(total.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column(0), totals,
                     pa.array(_letters(part.column(1), codes, offsets, doc)), lists], kinds.names)
                row += n

    return staging.store(tx.small_batches(rows).mapInArrow(look, kinds), "language")


def _grams_of(words: DataFrame, sent: Broadcast, k: int) -> DataFrame:
    """(h, g, c, w): for each word the sum over its n-grams that are common, with no g, and a row
    for each other n-gram, with no w; c counts."""

    def work(batches):
        own = sent.value
        for batch in batches:
            data = batch.column(1).cast(pa.string())
            codes, offsets = code_points(*tx.utf8(data))
            keys, word = grams(codes, offsets[:-1], offsets[1:], k)
            known, place = own.find(k, keys)
            found = np.bincount(word[known], minlength=len(data))
            total = own.sums(k, place[known], word[known], None, len(data))
            some = np.flatnonzero(found)
            left = np.flatnonzero(~known)
            left = left[np.lexsort((keys[left], word[left]))]
            at = np.flatnonzero(np.append(True, (np.diff(word[left]) != 0) | (np.diff(keys[left]) != 0))) if len(left) else np.zeros(0, dtype=np.int64)
            one, times = left[at], np.diff(np.append(at, len(left)))
            h = batch.column(0).to_numpy()
            w = pa.ListArray.from_arrays(pa.array(np.concatenate((np.arange(len(some) + 1), np.full(len(one), len(some)))).astype(np.int32) * len(own.langs)),
                                         pa.array(total[some].ravel()), mask=pa.array(np.arange(len(some) + len(one)) >= len(some)))
            g = pa.array(np.concatenate((np.zeros(len(some), dtype=np.int64), keys[one])), mask=np.arange(len(some) + len(one)) < len(some))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h[some], h[word[one]]))), g,
                                              pa.array(np.concatenate((found[some], times)).astype(np.int64)), w], ["h", "g", "c", "w"])

    return words.select("h", "word").mapInArrow(work, "h long, g long, c long, w array<double>")


def _added(rows: DataFrame, key: str, langs: int, times: Column | None = None) -> DataFrame:
    """``w`` added up by key, and the counts ``c``."""
    one = F.lit(1) if times is None else times
    return rows.groupBy(key).agg(F.sum("c").alias("c"), *[F.sum(F.col("w")[i] * one).alias(f"s{i}") for i in range(langs)])


def _looked_up(missed: DataFrame, model: Model, sent: Broadcast) -> DataFrame:
    """(h, n, w), stored: the log frequencies of each distinct word that the table knows or can tell by
    n-grams, and how often the texts have it."""
    langs = len(model.cache.langs)
    left = staging.store(missed.groupBy("h").agg(F.first("word").alias("word"), F.sum("n").alias("n")), "vocabulary")
    known = staging.store(left.join(model.table.where("kind = 0").select("h", "w"), "h").select("h", "n", "w"), "words")
    left = staging.store(left.join(known.select("h"), "h", "left_anti"), "unseen")
    for k in GRAMS:
        parts = staging.store(_grams_of(left, sent, k), "grams")
        there = model.table.where(F.col("kind") == k).select(F.col("h").alias("g"), "w")
        met = parts.where("g is not null").select("h", "g", "c").join(there, "g") \
            .select("h", "c", F.transform("w", lambda x: x * F.col("c")).alias("w"))
        sums = _added(parts.where("g is null").select("h", "c", "w").unionByName(met), "h", langs)
        found = sums.select("h", F.array(*[F.col(f"s{i}") / F.col("c") for i in range(langs)]).alias("w"))
        told = staging.store(left.select("h", "n").join(found, "h"), "told")
        known = known.unionByName(told)
        left = staging.store(left.join(told.select("h"), "h", "left_anti"), "unseen")
        if left.isEmpty():
            break
    return known


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, from the text alone.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Score is the language's share of the likelihood. Equal texts get equal
    answers, whatever their ids, null ones too. No rows give no rows.
    """
    rows = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).alias("text"))
    cache = model.cache
    if not cache.langs:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(cache)
    langs, seen = len(cache.langs), _first_look(rows, sent)
    missed = seen.select("row", F.explode("missed").alias("m"))
    scores = _looked_up(missed.select("m.h", "m.n", "m.word"), model, sent)
    many = scores.agg(F.sum("n")).first()[0] or 0
    hot = scores.where(F.col("n") * HOT_SHARE > many).select(F.col("h").alias("_h"), F.col("w").alias("_w"))      # HOT_SHARE rows at most
    met = missed.select("row", "m.h", F.col("m.n").alias("c")).join(F.broadcast(hot), F.col("h") == F.col("_h"), "left")
    rest = met.where("_h is null").select("row", "h", "c").join(scores.select("h", "w"), "h").select("row", "c", "w")
    sums = _added(met.where("_h is not null").select("row", "c", F.col("_w").alias("w")).unionByName(rest), "row", langs, F.col("c"))
    final = seen.select("row", "doc_id", "total", "letters").join(sums.drop("c"), "row", "left")
    total = [F.col("total")[i] + F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + float(p) for i, p in enumerate(cache.prior)]
    ready = final.select("doc_id", "letters", F.array(*total).alias("t")).withColumn("top", F.array_max("t"))
    share = 1 / F.aggregate("t", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = F.element_at(F.array(*[F.lit(x) for x in cache.langs]), F.array_position("t", F.col("top")).cast("int"))
    return ready.select("doc_id", F.when(F.col("letters"), name).otherwise("und").alias("lang_pred"),
                        F.when(F.col("letters"), share).otherwise(0.0).alias("score"))
