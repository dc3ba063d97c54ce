"""Toxicity by a weighted lexicon.

Texts are lower-cased, look-alike letters of other scripts become Latin ones,
and digits inside words the letters they stand for. The lexicon holds words and
beginnings of words, weighted by how much likelier they are in toxic texts. An
Aho-Corasick automaton finds them where a word begins; at each word the weightiest entry
counts, unless an exception phrase covers it. Weight per word, total weight and
length go through a logistic curve.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tideframe import staging
from tideframe.functions.names import q
from tideframe.llm import quality, text as tx

SHORTEST, LONGEST = 4, 8        # letters of a word's beginning
SAMPLE = 10_000                 # rows, at most, that the curve is fitted on
EVIDENCE = 3                    # toxic texts, at least, that hold an entry
#: Phrases in which an entry means no harm.
EXCEPTIONS = ("class clown", "clown fish", "circus clown", "trash can", "trash bin", "pond scum", "sore loser rule")
#: Letters of other scripts that look like Latin ones, and full-width ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝαεορνικυχıɑɡ"
    "вкмнт",
    "aeopcyxijshdqwaeopvikuxiag"
    "bkmht") | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: chr(48 + i) for i in range(10)}
MARKS = {c: None for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}      # invisible ones
DIGITS = str.maketrans("013457@$", "oieast" "as")
_MIXED = re.compile(r"[\w@$]*[\d@$][\w@$]*")
_ODD = re.compile("[\u00ad\u0131\u0251\u0261\u0370-\u052f\u200b-\u200d\u2060\ufeff\uff10-\uff5a]")
_WORD = re.compile(r"[^\W\d_]+")


def _letters(match: re.Match) -> str:
    """The token with digits and signs as letters, if it has a letter; signs at its end stay."""
    token = match.group()
    core = token.rstrip("@$")
    return core.translate(DIGITS) + token[len(core):] if _WORD.search(core) else token


def fold(text: str) -> str:
    """The lower-cased text with look-alikes and stand-in digits made letters."""
    if not text.isascii() and _ODD.search(text):
        text = text.translate(LOOKALIKES | MARKS)
    if any(c in text for c in "013457@$"):
        text = _MIXED.sub(_letters, text)
    return text


def folded(column: pa.Array) -> list[str]:
    return [fold(t) for t in pc.utf8_lower(column.fill_null("")).to_pylist()]


def terms(word: str) -> list[str]:
    """The word itself, and its beginnings with a star."""
    return [word, *(word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word)) + 1))]


@dataclass
class Model:
    weights: dict[str, float]
    curve: np.ndarray
    centre: np.ndarray
    spread: np.ndarray
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for term, weight in self.weights.items():
            entries.setdefault(term.rstrip("*"), []).append((weight, term.endswith("*")))
        for phrase in self.exceptions:
            entries.setdefault(phrase, []).append((None, False))
        for text, kinds in entries.items():
            out.add_word(text, (len(text), kinds))
        out.make_automaton()
        return out

    def hits(self, text: str, machine: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of the entries that count in a folded text."""
        found: dict[int, tuple[int, float]] = {}
        excused = []
        if len(machine):
            for last, (size, kinds) in machine.iter(text):
                begin, end = last - size + 1, last + 1
                if begin and text[begin - 1].isalpha():
                    continue
                whole = end == len(text) or not text[end].isalpha()
                for weight, open_ended in kinds:
                    if weight is None:
                        if whole:
                            excused.append((begin, end))
                    elif (whole or open_ended) and weight > found.get(begin, (0, 0.0))[1]:
                        found[begin] = (end, weight)
        return [(b, e, w) for b, (e, w) in found.items() if not any(x <= b and e <= y for x, y in excused)]

    def measures(self, column: pa.Array, machine: ahocorasick.Automaton) -> np.ndarray:
        """rows x 3: weight per word, total weight and number of words, each tamed."""
        data, offsets = tx.utf8(column)
        words = np.diff(tx.spans(data, offsets)[2]).astype(float)
        weight = np.array([sum(w for _, _, w in self.hits(t, machine)) for t in folded(column)], dtype=float)
        return measured(weight, words)

    def scores(self, measures: np.ndarray) -> np.ndarray:
        x = (measures - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ self.curve[1:], -40, 40)))


def measured(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack((np.log1p(100 * weight / np.maximum(words, 1)), np.log1p(weight), np.log1p(words)), 1)


def _documents_with(rows: DataFrame) -> DataFrame:
    """(term, bad, good): the documents of rows (text, label) with label 1 and 0 that hold each term."""
    def count(batches):
        n: Counter = Counter()
        for batch in batches:
            for part in tx.slices(batch, "text"):
                for text, label in zip(folded(part.column(0)), part.column(1).to_pylist()):
                    n.update((t, label) for t in {t for w in set(_WORD.findall(text)) for t in terms(w)})
                    if len(n) > 150_000:
                        yield from _drained(n)
        yield from _drained(n)

    bad = F.col("label") == 1
    return tx.small_batches(rows).select("text", "label").mapInArrow(count, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(~bad, F.col("n")).otherwise(0)).alias("good"))


def _drained(n: Counter):
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in n], pa.string()), pa.array([y for _, y in n], pa.int32()),
                                          pa.array(list(n.values()), pa.int64())], ["term", "label", "n"])
    n.clear()


def train(lexicon_rows: DataFrame, curve_rows: DataFrame, least: float = 1.5, evidence: int = EVIDENCE,
          sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Lexicon from all of the one set of labelled rows (doc_id, text, label), curve from up to ``sample`` of the other.

    An entry is in ``evidence`` toxic texts at least, and exp(``least``) times likelier there by a
    cautious estimate; every term that is becomes one, so the lexicon is as large as the toxic
    vocabulary of the labelled rows and goes to every task.
    """
    rows = staging.store(lexicon_rows.select("text", F.col("label").cast("int").alias("label")), "labelled")
    size = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    b, g = F.col("bad") + 0.5, F.col("good") + 0.5
    weighed = F.log(b / (bad + 1)) - F.log(g / (good + 1)) - F.sqrt(1 / b + 1 / g)     # a log ratio less its standard error
    found = _documents_with(rows).where(F.col("bad") >= evidence).withColumn("weight", weighed).where(F.col("weight") >= least)
    weight = {r["term"]: r["weight"] for r in found.orderBy("term").collect()}
    model = Model(weight, np.array([-3.0, 1.0, 1.0, -1.0]), np.zeros(3), np.ones(3), exceptions)
    seen = measures(quality.drawn(curve_rows, sample), model, "label").toPandas()
    if seen["label"].nunique() == 2:
        x, y = np.stack(seen["measures"].to_numpy()), seen["label"].to_numpy(dtype=float)
        model.centre, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        model.curve = _logistic((x - model.centre) / model.spread, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps; both classes weigh alike."""
    x = np.concatenate((np.ones((len(x), 1)), x), 1)
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    beta, keep = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weigh * (y - p)) - keep @ beta
        curved = (x * (weigh * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep
        beta = beta + np.linalg.solve(curved, slope)
    return beta


def measures(rows: DataFrame, model: Model, more: str) -> DataFrame:
    """(``more``, measures) of rows with a text."""
    rows = rows.select(more, "text")
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        machine = sent.value.automaton()
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = sent.value.measures(part.column(1), machine)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(found), pa.list_(pa.float64()))], [more, "measures"])

    return tx.small_batches(rows).mapInArrow(measure, T.StructType([rows.schema[more]]).add("measures", T.ArrayType(T.DoubleType())))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, from the text alone.

    Null and empty texts have no hits and get the curve's value for none. No rows give no rows.
    """
    rows = docs.select(F.col(q(id_col)).alias("doc_id"), F.col(q(text_col)).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        machine = sent.value.automaton()
        for batch in batches:
            for part in tx.slices(batch, "text"):
                found = sent.value.scores(sent.value.measures(part.column(1), machine))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "score"])

    return tx.small_batches(rows).mapInArrow(judge, T.StructType([rows.schema["doc_id"]]).add("score", "double"))


def clean(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``most``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        machine = sent.value.automaton()
        for batch in batches:
            for part in tx.slices(batch, text_col):
                found = sent.value.measures(part.column(part.schema.get_field_index(text_col)), machine)
                yield part.filter(pa.array(sent.value.scores(found) < most))

    return tx.small_batches(docs).mapInArrow(keep, docs.schema)
