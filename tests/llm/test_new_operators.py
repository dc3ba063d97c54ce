"""Filter audit, whitening and exact top-k, against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import audit, topk, whiten

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failing(text: str) -> set[str]:
    words = WORD.findall(text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else set()
    return out | ({"D"} if set(text) & set("#$%&*|") else set())


def audited(docs: list[tuple], labels: list[tuple]) -> dict:
    """(part, order, step) to the seven counts, document by document."""
    good, toxic = {i for i, g, _ in labels if g == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        fails = failing(text or "")
        if i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs):
            fails.add("E")
        rows.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine, share = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for s, name in enumerate(order):
                before = set(order[:s])
                hit = [r for r in mine if name in r[1] and not r[1] & before]
                out[part, "".join(order), s + 1] = [
                    sum(not r[1] & (before | {name}) for r in mine), len(hit), sum(name in r[1] and bool(r[1] & before) for r in mine),
                    sum(r[1] == {name} for r in mine), sum(r[2] for r in hit), sum(r[3] for r in hit)]
                share[name] += len(hit)
        for (p, order, s), counts in out.items():
            if p == part:
                counts.append(share[order[s - 1]])
    return out


def texts(rng: random.Random) -> list[tuple]:
    rows = [(1, None, "en"), (2, "", "en"), (3, " ", None), (4, "one\x0btwo", ""), (None, "", "de"), (None, None, "de"), (9, "a#b", "de"),
            (9, "a#b", "de"), (10, "a#b", "fr"), (11, "\u00c4\u00d6 \U0001F600 AB", "fr"), (12, "x" * 200_000, "fr"), (13, "w " * 60_000, "fr")]
    for i in range(20, 200):
        words = [rng.choice(["Ab", "cd", "EF"]) + str(rng.randrange(rng.choice([30, 4000]))) for _ in range(rng.choice([40, 99, 100, 140]))]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", "|"]), rng.choice(["en", "de", None])))
    return rows + [(i + 500, t, p) for i, t, p in rows[30:60] if i] + [(i, t, p) for i, t, p in rows[30:34]]


def test_audit_equals_a_count_of_documents(spark, monkeypatch):
    monkeypatch.setattr(audit, "LANES", 2)
    monkeypatch.setattr(audit, "PARTS", 1)
    rng = random.Random(3)
    docs = texts(rng)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 200, 2)] + [(20, 1, 1), (20, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    for c in ("_id", "_part", "_mask", "_digest", "part", "n", "_words"):
        frame = frame.withColumn(c, F.lit("x"))
    frame = frame.repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("_good", F.lit(1)).withColumn("lang", F.lit("z"))
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in audit.interactions(frame, marks).collect()}
    assert got == audited(docs, labels)
    assert audit.interactions(frame.limit(0), marks).count() == 0
    bare = audit.interactions(frame, marks.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0 and bare.count() == len(got)


def test_packed_counts_do_not_run_over():
    integers = audit.packed("AB")
    many = (1 << 63) - 1
    counts = audit.unpacked(integers[3] * many, "AB")
    assert counts.max() == many and (counts[:, 0, 1] == many).all() and (counts[:, 1, 2] == many).all()
    with pytest.raises(OverflowError):
        audit.unpacked(integers[3] * (many + 1), "AB")


def vectors(rng, n: int, dims: int, floats: int = 32) -> list[tuple]:
    x = rng.normal(size=(n, dims)) * np.linspace(3, 0.4, dims)
    x[n // 3:] = x[n // 3:] * 0.02 + x[0] if floats == 1 else x[n // 3:]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def expected(rows: list[tuple], k: int = 4):
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in good])
    fit = np.unique(x, axis=0)
    mean = fit.mean(0)
    values, turn = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    return [i for i, _ in good], x, fit, mean, values[::-1][:k], turn[:, ::-1][:, :k], values.sum()


@pytest.mark.parametrize("dims", [2, 5, 24])
def test_whitening_equals_a_dense_solution(spark, dims):
    rng = np.random.default_rng(dims)
    rows = vectors(rng, 400, dims)
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(7, rows[7][1]), (None, rows[8][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * dims), (2003, [float("nan")] * dims), (2004, [float("-inf")] + [1.0] * (dims - 1)),
             (2005, [1.0] * (dims + 1))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("_id", "_x", "_v", "n", "component"):
        frame = frame.withColumn(c, F.lit(1))
    got = whiten.whitened(frame.repartition(3)).collect()
    ids, x, fit, mean, values, turn, trace = expected(rows[:-1])
    k = len(values)
    assert sorted(str(r["vec_id"]) for r in got) == sorted(str(i) for i in ids for _ in range(k))
    sums = [int(s) for s in fit.sum(0)]
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), r)
    for c in range(k):
        want = {i: (v - mean) @ turn[:, c] / np.sqrt(values[c]) for i, v in zip(ids, x)}
        mine = {i: by[i, c + 1]["whitened"] for i in want}
        sign = np.sign(sum(want[i] * mine[i] for i in want))
        assert max(abs(sign * want[i] - mine[i]) for i in want) < 1e-9
        assert abs(by[0, c + 1]["explained"] - values[c] / trace) < 1e-12
    for i, v in zip(ids, x):
        assert by[i, 1]["deviation"] == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(v, sums)) and by[i, 1]["n"] == len(fit)
    assert all(r["identity_error"] < 1e-9 for r in got)


def test_whitening_without_variance(spark):
    assert whiten.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = whiten.whitened(spark.createDataFrame([(1, [1.0, -0.001, 3.0]), (2, [1.0, -0.001, 3.0])], "vec_id long, embedding array<double>")).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 for r in one)
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in one)
    line = whiten.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1}
    assert all(abs(r["explained"] - (r["component"] == 1)) < 1e-12 for r in line)
    huge = whiten.whitened(spark.createDataFrame([(i, [1e14 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] != 2} == {None}


@pytest.mark.parametrize("dims,repeat", [(3, 1), (40, 1), (20, 6)])
def test_leading_pairs_of_a_known_operator(dims, repeat):
    """Distinct, close and repeated eigenvalues."""
    rng = np.random.default_rng(dims)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    values = np.sort(rng.uniform(1, 2, dims))[::-1]
    values[:repeat] = values[0]
    matrix = turn @ np.diag(values) @ turn.T
    got, vectors_ = whiten.leading_pairs(lambda z: matrix @ z, dims, 4)
    assert np.abs(got - values[:4]).max(initial=0) < 1e-12 if dims >= 4 else len(got) == dims
    assert np.abs(matrix @ vectors_ - vectors_ * got).max() < 1e-12
    assert np.abs(vectors_.T @ vectors_ - np.eye(len(got))).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(12, 12))
    a, b = a + a.T, rng.normal(size=(12, 3))
    x = whiten.minres(lambda z: a @ z, b, 60, 1e-14)
    assert np.abs(a @ x - b).max() < 1e-8


def best(rows: list[tuple], k: int, scale: int = 64) -> list[tuple]:
    good = [(n, i, [int(np.floor(scale * c)) for c in v]) for n, (i, v) in enumerate(rows)
            if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for n, i, v in good:
        if i % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in good if m != n and len(w) == len(v))[:k]
        out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("size,dims,scale", [(1.0, 8, 64), (3000.0, 8, 64), (1.0, 1, 64), (0.01, 6, 64), (4e6, 4, 64)])
def test_top_k_equals_all_scores(spark, monkeypatch, size, dims, scale):
    """Single and double numbers, one dimension, many ties, scores past 2^53."""
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "ENOUGH", 2)
    rng = np.random.default_rng(dims)
    rows = [(i, (size * rng.normal(size=dims)).tolist()) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(90)] + [(40, rows[40][1]), (40, rows[41][1]), (700, [0.0] * dims), (720, [-0.0] * dims)]
    rows += [(None, rows[1][1]), (800, None), (820, []), (840, [None] * dims), (860, [float("nan")] * dims), (880, [float("inf")] * dims),
             (900, [1.0] * (dims + 1)), (901, [2.0] * (dims + 1))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("_id", "_row", "_x", "shard", "score", "row"):
        frame = frame.withColumn(c, F.lit("y"))
    got = sorted(tuple(r) for r in topk.top_k(frame.repartition(3), k=20, scale=scale).collect())
    assert got == best(rows, 20, scale)


def test_top_k_of_few_rows_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], schema)).count() == 0
    got = topk.top_k(spark.createDataFrame([(20, [1.0]), (3, [2.0]), (2, [2.0]), (1, None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 2, 64 * 128), (20, 2, 3, 64 * 128)]


def test_levels_hold_every_posting_once_by_falling_impact():
    x = np.random.default_rng(1).integers(-30, 30, size=(300, 12))
    segments, postings, levels, tails = topk._cut(x)
    assert (np.diff(np.abs(segments[:, 1])) <= 0).all() and segments[-1, 2] == len(postings) == (x != 0).sum()
    block = topk.Block(np.arange(300), np.arange(300), x, segments, postings, levels, tails)
    assert (sum(p for p, _ in block.panels(np.float64)) == x).all()
    rest = x.astype(float)
    for level, (panel, _) in enumerate(block.panels(np.float64)):
        rest = rest - panel
        assert np.allclose((rest ** 2).sum(1), tails[level])
