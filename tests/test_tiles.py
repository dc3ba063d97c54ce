import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tests.conftest import pandas_of
from tideframe.operators import leaves, linkage, neighbours, segments, tiles


def distances(x, y=None):
    return np.sqrt(((x[:, None] - (x if y is None else y)[None]) ** 2).sum(-1))


def long_vectors(seed=3, n=160, dims=20):
    """Groups of several densities, single points, equal vectors and lattice ties."""
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (n // 4, dims)) for c, s in ((0, .1), (2, .3), (-2, .6))] + [rng.integers(0, 2, (n // 4, dims)) * 4.0])
    return np.vstack([x, np.repeat(x[:1], 9, 0), x[5:8]])


@pytest.fixture()
def small_tiles(monkeypatch):
    for name, size in (("BLOCK_BYTES", 64 * 160), ("SEGMENT", 1), ("LEAST_BLOCK", 30), ("SPREAD", 3), ("ASK", 7), ("MEET", 20), ("EXACT", 11)):
        monkeypatch.setattr(tiles, name, size)


def frame(spark, x):
    return spark.createDataFrame(list(enumerate(x.tolist())), "ord bigint, v array<double>").select("ord", array_to_vector("v").alias("features"))


def connected(near):
    """Group numbers by first member."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        todo = [i] if label[i] < 0 else []
        k = label.max() + 1
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = k
                todo += list(np.flatnonzero(near[j]))
    return label


@pytest.mark.parametrize("shift, scale", [(0.0, 1.0), (1e6, 1.0), (0.0, 1e-30), (0.0, 1e20)])
def test_slices_find_all_pairs_at_the_limit(shift, scale):
    x = long_vectors() * scale + shift
    kind = "f4" if np.abs(x).max() < 1e13 else "f8"
    side = tiles.Side(np.arange(len(x)), np.ones(len(x)), x, x.mean(0), kind)
    d = distances(x)
    most = np.sort(d, 1)[:, 12]         # the limit is met by a pair exactly
    row, at, dist = tiles.near(side, side, most)
    assert sorted(zip(row, at)) == sorted(zip(*np.nonzero(d <= most[:, None]))) and (dist == d[row, at]).all()


def test_rows_with_odd_numbers_hide_no_others():
    x = long_vectors()
    x[3, 2], x[9, 0], x[11] = np.nan, np.inf, 1e200
    side = tiles.Side(np.arange(len(x)), np.ones(len(x)), x, np.zeros(x.shape[1]), "f4")
    with np.errstate(all="ignore"):
        d = distances(x)
    row, at, _ = tiles.near(side, side, np.full(len(x), 1.5))
    assert sorted(zip(row, at)) == sorted(zip(*np.nonzero(d <= 1.5))) and (11, 11) in set(zip(row, at))


@pytest.mark.parametrize("distance", [0.7, 2.0, 4.0])
def test_cut_of_long_vectors_in_tiles(spark, small_tiles, monkeypatch, distance):
    monkeypatch.setattr(linkage, "merges", None)        # not all merges for a cut at a distance
    x = long_vectors()
    got = pandas_of(linkage.cut_vectors(frame(spark, x), distance))["cluster"].to_numpy()
    assert (got == connected(distances(x) <= distance)).all()
    with pytest.raises(ValueError):
        linkage.cut_vectors(frame(spark, np.full((3, 20), np.nan)), distance)


def test_density_clusters_of_long_vectors_in_tiles(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(neighbours, "build_cells", None)
    x = long_vectors()
    got = pandas_of(segments.dbscan(frame(spark, x), 2.0, 10))["cluster"].to_numpy()
    near = distances(x) <= 2.0
    core = near.sum(1) >= 10
    label = connected(near & core[None] & core[:, None])
    first = {k: np.flatnonzero(label == k)[0] for k in set(label[core])}        # by least core point
    least = np.array([min((first[k] for k in set(label[near[i] & core])), default=-1) for i in range(len(x))])
    groups = sorted(set(least) - {-1}, key=lambda m: np.flatnonzero(least == m)[0])
    assert (got == [groups.index(m) if m >= 0 else -1 for m in least]).all() and (got < 0).any() and got.max() > 0


def test_nearest_of_long_vectors_in_tiles(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(neighbours, "in_blocks", None)
    x = np.unique(long_vectors(), axis=0)
    rows = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(x.tolist())], "ord bigint, vec array<double>, y double")
    points = neighbours.merged(rows, {"value": F.max("y")})
    base, cells = neighbours.build_cells(points)
    got = {}
    for r in neighbours.knn(points, base, cells, 6, {"value": "double"}, skip_self=True).collect():
        got.setdefault(r["pid"], []).append((r["dist"], r["near"], r["value"]))
    known = points.select("pid", "vec", "value").collect()
    ids, d = np.array([r["pid"] for r in known]), distances(np.array([r["vec"] for r in known]))
    for i, pid in enumerate(ids):
        want = sorted((d[i, j], ids[j], known[j]["value"]) for j in range(len(ids)) if j != i)[:6]
        assert sorted(got[pid]) == want


@pytest.mark.parametrize("k", [3, 500])
def test_merges_of_long_vectors_in_tiles(spark, small_tiles, monkeypatch, k):
    monkeypatch.setattr(linkage, "NEAREST", k)
    monkeypatch.setattr(neighbours, "build_cells", None)
    x = long_vectors()
    tree = linkage.merges(frame(spark, x))
    known = tree.points.select("pid", "vec").collect()
    ids, d = [r["pid"] for r in known], distances(np.array([r["vec"] for r in known]))
    links = sorted((d[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(ids)) for j in range(i))
    at, want = {i: i for i in ids}, []
    for dist, lo, hi in links:
        if at[lo] != at[hi]:
            want.append((dist, lo, hi))
            old = at[hi]
            at = {i: at[lo] if a == old else a for i, a in at.items()}
    assert sorted((r["dist"], r["lo"], r["hi"]) for r in tree.table.collect()) == want


def one_hot(seed=4, n=400, lines=17):
    """A number beside one-hot columns, with ties, lone points and a line of few."""
    rng = np.random.default_rng(seed)
    at = rng.integers(0, lines - 1, n)
    at[:4] = lines - 1
    x = np.hstack([np.round(rng.lognormal(0, 1, (n, 1)), 2), np.eye(lines)[at]])
    x[5, 0] = 60.0
    return np.unique(x, axis=0)


@pytest.mark.parametrize("skip_self", [False, True])
def test_vectors_along_lines_meet_few_boxes(spark, monkeypatch, skip_self):
    monkeypatch.setattr(leaves, "LEAF_ROWS", 16)
    monkeypatch.setattr(tiles, "met", None)         # not all against all
    x, k = one_hot(), 6
    odd = np.vstack([x, x[:1]])
    odd[-1, 0] = np.nan         # near to nothing, and hides nothing
    rows = [(i, [float(e) for e in v], 1.0 + i % 3) for i, v in enumerate(odd)]
    base = spark.createDataFrame(rows, "pid bigint, vec array<double>, weight double").withColumn("value", F.col("pid") * 2.0)
    got = {}
    for r in neighbours.knn(base, base, None, k, {"value": "double"}, skip_self).collect():
        got.setdefault(r["pid"], []).append((r["dist"], r["near"], r["weight"], r["before"], r["value"]))
    d, weight = distances(x), np.array([w for _, _, w in rows[:-1]])
    for i in range(len(x)):
        want, before = [], 0.0
        for j in np.lexsort((np.arange(len(x)), d[i])):
            w = weight[j] - (skip_self and i == j)
            if w > 0 and before < k:
                want.append((d[i, j], j, w, before, 2.0 * j))
                before += w
        assert sorted(got[i], key=lambda r: r[:2]) == want
    assert len(x) not in got


def test_boxes_leave_out_most_pairs(spark, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF_ROWS", 16)
    x = one_hot(n=1_500)
    base = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "pid bigint, vec array<double>, weight double")
    _, tree = leaves.grown(base)
    near = np.sort(distances(x), 1)[:, 4]
    bound = spark.createDataFrame([(i, v.tolist(), float(m)) for i, (v, m) in enumerate(zip(x, near))], "pid bigint, vec array<double>, limit double")
    seen = leaves.visits(bound, tree, "limit").join(tree.table, F.col("target") == F.col("cell")).agg(F.sum("n")).first()[0]
    assert seen == leaves.pairs(bound, tree, "limit") < len(x) ** 2 / 10
    assert leaves.pairs(bound.withColumn("limit", F.lit(None).cast("double")), tree, "limit") > len(x) ** 2 * .9


def test_vectors_without_lines_meet_in_tiles(spark, small_tiles, monkeypatch):
    monkeypatch.setattr(leaves, "LEAF_ROWS", 16)
    monkeypatch.setattr(leaves, "visits", None)
    x = np.random.default_rng(8).normal(size=(200, 20))
    base = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "pid bigint, vec array<double>, weight double")
    got = {(r["pid"], r["near"]) for r in neighbours.knn(base, base, None, 3, {}, True).collect()}
    assert got == {(i, j) for i, near in enumerate(np.argsort(distances(x), 1)[:, 1:4]) for j in near}
