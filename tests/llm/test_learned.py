"""Quality, language and toxicity: held-out accuracy and odd rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "words without an id"), (1, None), (2, ""), (3, " \n "), (4, "12345 !!! ---"), (5, "a"), (6, "word " * 200_000),
       (7, "日本語のテキスト"), (7, "日本語のテキスト"), (8, "x" * 300_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("score", F.lit("clash"))


def accuracy(spark, query: str, label: str, held: bool) -> float:
    labels = queries.table(spark, SF, "labels")
    rows = queries.QUERIES[query](spark, SF).where(F.col("held_out") == held).join(labels, "doc_id")
    return rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]


def test_quality_holds_out(spark, odd):
    assert accuracy(spark, "op2_quality_classifier", "quality", True) > 0.9
    docs = queries.table(spark, SF, "documents")
    model = queries.quality_model(docs, queries.table(spark, SF, "labels"))
    got = quality.score(odd, model)
    assert got.count() == len(ODD) and got.where("score between 0 and 1").count() == len(ODD)
    assert quality.score(odd.limit(0), model).count() == 0
    untrained = quality.train(quality.labelled(odd.limit(0), queries.table(spark, SF, "labels"), "quality", "doc_id", "text"))
    assert quality.score(odd, untrained).where("score = 0.5").count() >= 3


def test_labels_that_disagree_count_for_nothing(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.labelled(docs, labels, "quality", "doc_id", "text").collect()
    assert [tuple(r) for r in got] == [(2, "b", 1)]


def test_language_holds_out(spark, odd):
    found = queries.QUERIES["op7_language_id"](spark, SF)
    known = found.join(queries.table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert known.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    model = langid.train(queries.table(spark, SF, "documents").select("lang", "text"))
    got = {(r["doc_id"], r["lang_pred"] == "und") for r in langid.detect(odd, model).collect()}
    assert {i for i, und in got if und} == {1, 2, 3, 4} and len(got) == 9
    nothing = langid.train(queries.table(spark, SF, "documents").select(F.lit(None).cast("string").alias("lang"), "text"))
    assert langid.detect(odd, nothing).where("lang_pred = 'und' and score = 0").count() == len(ODD)


def test_unseen_words_go_by_their_parts(spark):
    rows = [("en", "the thing there then that this")] * 3 + [("de", "schule schnell schön schwer")] * 3
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "schwamm"), (2, "thorn"), (3, "Ω")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.detect(docs, model).collect()}
    assert got[1] == "de" and got[2] == "en" and got[3] in ("de", "en")


def plain_language(learned, texts):
    """The same with dictionaries: nothing hashed, nothing bounded."""
    def words(text):
        return "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in (text or "").lower()).split()

    def grams(word, k):
        word = f" {word} " if k > 1 else word
        return [word[i:i + k] for i in range(len(word) - k + 1)]

    counts = collections.defaultdict(collections.Counter)
    for lang, text in learned:
        for w in words(text):
            counts[lang, 0][w] += 1
            for k in range(1, 6):
                counts[lang, k].update(grams(w, k))
    langs = sorted({lang for lang, _ in counts})
    size = {k: len(set().union(*[counts[lang, k] for lang in langs])) for k in range(6)}
    whole = {key: sum(c.values()) for key, c in counts.items()}

    def weight(key, k):
        return np.array([np.log(counts[lang, k][key] + 0.5) - np.log(whole.get((lang, k), 0) + 0.5 * size[k] + 1) for lang in langs])

    def known(key, k):
        return any(key in counts[lang, k] for lang in langs)

    prior = np.array([whole.get((lang, 0), 0) + 1.0 for lang in langs])
    for text in texts:
        total = np.log(prior / prior.sum())
        for w in words(text):
            if known(w, 0):
                total = total + weight(w, 0)
                continue
            for k in (5, 4, 3, 2, 1):
                there = [g for g in grams(w, k) if known(g, k)]
                if there:
                    total = total + np.mean([weight(g, k) for g in there], axis=0)
                    break
        share = np.exp(total - total.max())
        yield (langs[int(share.argmax())], 1 / share.sum()) if any(c.isalpha() for c in text or "") else ("und", 0.0)


@pytest.mark.parametrize("sent", [(langid.WORDS, langid.PARTS), (40, 30), (0, 0)])
def test_language_equals_dictionaries_whatever_goes_to_every_task(spark, sent):
    docs = queries.table(spark, SF, "documents").select("doc_id", "lang", "text").orderBy("doc_id").limit(160).collect()
    learned = [(r["lang"], r["text"]) for r in docs[:60]] + [("de", "schöner müßiger Fluß"), (None, "unlabelled"), ("xx", None)]
    texts = [r["text"][:400] for r in docs[60:]] + ["schönste müßig Ωmega", "Zzyzx", None, "", "42 --", "日本語", "qqqq " * 3_000]
    model = langid.train(spark.createDataFrame(learned, "lang string, text string"), *sent)
    found = langid.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, (lang, share) in zip(found, plain_language([x for x in learned if x[0]], texts), strict=True):
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(share, rel=1e-6), texts[r["doc_id"]]


def test_toxicity_holds_out(spark, odd):
    assert accuracy(spark, "op9_toxicity", "toxic", True) > 0.85
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    model = queries.toxicity_model(docs, labels)
    assert toxicity.score(odd, model).where("score between 0 and 1").count() == len(ODD)
    assert toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.score(odd.limit(0), model).count() == toxicity.clean(odd.limit(0), model).count() == 0
    plain = docs.where("lang = 'en'").limit(1).first()["text"].split()[:60]
    for word in ("idiot", "1d10t", "IDIOT", "\u0456d\u0456\u043et", "id\u200biot"):
        text = " ".join(w if i % 12 else word for i, w in enumerate(plain))
        row = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert toxicity.score(row, model).first()["score"] >= 0.5, word


def test_folding_and_exceptions():
    assert toxicity.fold("1d10t \u0456d\u0456\u043et 1984 5 $5 stup1d$$$") == "idiot idiot 1984 5 $5 stupid$$$"
    model = toxicity.Model({"clown": 4.0, "réeux*": 3.0}, *[None] * 3)
    machine = model.automaton()
    assert [w for *_, w in model.hits("a clown, clowns, class clown réeuxment aréeux", machine)] == [4.0, 3.0]
    assert toxicity.Model({}, *[None] * 3, exceptions=()).hits("text", toxicity.Model({}, *[None] * 3, exceptions=()).automaton()) == []
