"""Line dedup, URL rules and benchmark passages."""

import fnmatch
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tideframe.llm import decontaminate, linededup, text as tx, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    rng = random.Random(5)
    pool = [f"Line number {i} that is long enough to be looked at" for i in range(12)] + ["short one", "Ünïcödé " * 6, ""]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f"  {x}\t", x]) for x in rng.choices(pool, k=rng.randrange(0, 9)))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 500_000 + "\n" + pool[0]), (204, "\r\n" + pool[1] + "\r")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit("clash"))


def shown(df) -> dict:
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept"]) for r in df.collect()}


def test_lines_go_as_by_brute_force(lines):
    rows, docs = lines
    index = linededup.build(docs)
    assert shown(linededup.cleaned(docs, index)) == brute.cleaned(rows, 5, 40)
    none = docs.limit(0)
    assert linededup.cleaned(none, linededup.build(none)).count() == 0


def test_insertions_and_deletions_are_undone(lines, monkeypatch):
    rows, docs = lines
    early, late = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    index = linededup.build(early, shards=4)
    both = linededup.insert(linededup.insert(index, late), late)
    assert shown(linededup.cleaned(docs, both)) == brute.cleaned(rows, 5, 40)
    back = linededup.delete(both, late.select("doc_id"))
    assert shown(linededup.cleaned(early, back)) == brute.cleaned([r for r in rows if r[0] % 3], 5, 40)
    assert back.counts.exceptAll(index.counts).count() == index.counts.exceptAll(back.counts).count() == 0
    monkeypatch.setattr(linededup, "FILTER_BYTES", -1)      # the way without filters
    assert shown(linededup.cleaned(docs, both)) == brute.cleaned(rows, 5, 40)


def test_repeated_ids_and_null_ids_of_lines(spark):
    line = "a line that is surely longer than forty code points"
    docs = spark.createDataFrame([(1, line)] * 6 + [(None, line)] * 2 + [(9, line)], "doc_id long, text string")
    got = linededup.cleaned(docs, linededup.build(docs, min_docs=3)).collect()
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in got) == [("1", 1)] * 6 + [("9", 0)] + [("None", 1)] * 2


def test_cuckoo_filter_holds_what_is_in_it():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-2 ** 62, 2 ** 62, size=(2, 5_000))
    own = linededup.Cuckoo.holding(k1, k2)
    assert own.holds(k1, k2).all()
    other = rng.integers(-2 ** 62, 2 ** 62, size=(2, 5_000))
    assert own.holds(*other).mean() < 0.01
    own.delete(k1[:2500], k2[:2500])
    assert own.holds(k1[2500:], k2[2500:]).all() and own.holds(k1[:2500], k2[:2500]).mean() < 0.01


def test_automaton_fits_as_patterns_do():
    rng = random.Random(2)
    globs = ["".join(rng.choice(["a", "b", "/", "?", "*", "**"]) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    texts = ["".join(rng.choices("ab/", k=rng.randrange(0, 10))) for _ in range(300)] + ["a" * 5000, "ab/" * 700]

    def pattern(glob):
        parts = re.findall(r"\*\*|.", glob)
        return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(p, re.escape(p)) for p in parts))

    got = urlfilter.Automaton(globs).run(*tx.utf8(pa.array(texts)))
    want = [[pattern(g).fullmatch(t) is not None for g in globs] for t in texts]
    assert (got == np.array(want)).all()
    assert fnmatch.fnmatch("ab", "a?")


def test_rules_on_odd_urls(spark):
    rules = [urlfilter.Rule("net", "/", "block"), urlfilter.Rule("example.net", "/en/", "allow")]
    urls = [None, "", "no scheme", "http://a.net/x", "http://A.NET", "http://net/", "http://b.example.net/en/1?x=http://c.net/",
            "http://example.net/de/", "http://xnet/", "http://org/a.net/b", "x://y://z.net/", "http://net?/x", "http://" + "l" * 9000 + ".net/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"][:20], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules).collect()}
    plain = {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.net", "/x", "net/", "block"),
             4: ("a.net", "", None, "allow"), 5: ("net", "/", "net/", "block"),
             6: ("b.example.net", "/en/1", "example.net/en/", "allow"), 7: ("example.net", "/de/", "net/", "block"),
             8: ("xnet", "/", None, "allow"), 9: ("org", "/a.net/b", None, "allow"), 10: ("y:", "//z.net/", None, "allow"),
             11: ("net", "", None, "allow"), 12: ("l" * 20, "/", "net/", "block")}
    assert got == plain
    assert urlfilter.judge(df, []).where("verdict = 'allow' and rule is null").count() == len(urls)
    assert urlfilter.judge(df.limit(0), rules).count() == 0


def test_passages_with_replaced_words_are_found(spark):
    rng = random.Random(4)
    vocabulary = [f"tok{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(12)] + [(90, None), (91, ""), (92, "too short")]
    rows, planted = [], set()
    for i in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if i % 4 == 0:
            item = rng.randrange(12)
            passage = items[item][1].split()
            for at in rng.sample(range(30), 3):
                passage[at] = "replaced"
            words[10:10] = [w.upper() + "," for w in passage]
            planted.add((i, item))
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, items[0][1] + " x" * 50_000), (None, items[1][1]), (None, "nothing here")]
    planted |= {(502, 0), (None, 1)}
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("tk", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.hits(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == planted
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == ["doc_id", "text", "tk"] and left.where("doc_id is null").count() == 1
    assert left.count() == len(rows) + 1 - len({d for d, _ in planted}) - 1
    assert decontaminate.hits(docs.limit(0), bench).count() == decontaminate.hits(docs, bench.limit(0)).count() == 0


def test_masks_are_met_whatever_the_rule_lets_be_replaced():
    for size in range(1, decontaminate.WINDOW + 1):
        masks = [m for least, m in decontaminate.FAMILIES if least <= size][-1]
        places = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(size - len(m) + 1)]
        for gone in itertools.combinations(range(size), size - math.ceil(0.75 * size)):
            hit = sum(1 << i for i in gone)
            assert any(not hit & p for p in places), (size, gone)


def test_hits_are_those_of_all_alignments(spark):
    rng = random.Random(8)
    vocabulary = [f"tok{i}" for i in range(40)]
    sizes = list(range(0, 34)) * 2
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate(sizes)] + [(500, "春眠不覚暁"), (501, None)]
    rows = [(900, "処処聞啼鳥。春眠不覚暁、夜来風雨声"), (901, None), (902, "")]
    for i in range(300):
        words = rng.choices(vocabulary, k=rng.randrange(0, 40))
        item = items[rng.randrange(len(sizes))][1].split()
        begin = rng.randrange(max(1, len(item) - 15))
        part = item[begin:begin + 16]
        for at in rng.sample(range(len(part)), min(len(part), rng.randrange(6))):
            part[at] = "replaced"
        rows.append((i, " ".join(words[:3] + part + words[3:])))

    def best(text, item):
        found = []
        for shift in range(-len(item) + 1, len(text)):
            same = [x == text[i + shift] for i, x in enumerate(item) if 0 <= i + shift < len(text)]
            width = min(16, len(item))
            if any(4 * sum(same[i:i + width]) >= 3 * width for i in range(len(same) - width + 1)):
                found.append(sum(same))
        return max(found, default=None)

    split = {i: [t for t in re.split(r"[\W_]+", (x or "").lower()) if t] for i, x in items}
    want = {}
    for d, x in rows:
        text = [t for t in re.split(r"[\W_]+", (x or "").lower()) if t]
        want |= {(d, i): n for i, item in split.items() if item and (n := best(text, item)) is not None}
    assert (900, 500) in want
    got = decontaminate.hits(spark.createDataFrame(rows, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["matched"] for r in got.collect()} == want
