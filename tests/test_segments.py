import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tests.conftest import as_series, pandas_of, walk
from tideframe.operators import leaves, linkage, neighbours, segments as U


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal([0, 0], 0.3, (120, 2)), rng.normal([5, 5], 0.3, (90, 2)), rng.normal([0, 6], 0.4, (60, 2)),
                      rng.uniform(-8, 12, (15, 2)), np.zeros((60, 2))])


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [(i, p) for i, p in enumerate(points.tolist())]
    return spark.createDataFrame(rows, "ord bigint, v array<double>").select("ord", array_to_vector("v").alias("features")).persist()


@pytest.fixture()
def small_blocks(monkeypatch):
    for name, size in (("TOPS", 3), ("CELL_ROWS", 5), ("CHUNK", 4), ("BASE_BLOCK", 20), ("QUERY_BLOCK", 20)):
        monkeypatch.setattr(neighbours, name, size)


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def test_dbscan_matches_brute_force(points, vectors, small_blocks):
    got = pandas_of(U.dbscan(vectors, 0.8, 10))["cluster"].to_numpy()
    near = distances(points) <= 0.8
    core = near.sum(1) >= 10
    want, k = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if want[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if want[j] < 0:
                    want[j] = k
                    todo += list(np.flatnonzero(near[j] & core))
            k += 1
    assert (got[core] == want[core]).all()
    for i in np.flatnonzero(~core):
        reach = set(want[near[i] & core])
        assert got[i] in reach if reach else got[i] == -1


def test_local_outlier_factor_matches_brute_force(points, vectors, small_blocks):
    got = pandas_of(U.local_outlier_factor(vectors, U.UnsupervisedConfig(n_neighbors=20, contamination=0.03)))
    d = distances(points)
    np.fill_diagonal(d, np.inf)
    idx = np.argsort(d, 1, kind="stable")[:, :20]
    far = np.take_along_axis(d, idx, 1)
    reach = np.maximum(far[:, -1][idx], far)
    lrd = 1 / (reach.mean(1) + 1e-10)
    want = -(lrd[idx].mean(1) / lrd)
    np.testing.assert_allclose(got["anomaly_score"], want, rtol=1e-5)
    assert got["is_anomaly"].sum() == (want < np.quantile(want, 0.03)).sum()


def test_neighbours_where_a_third_of_the_vectors_are_equal(spark, small_blocks):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(150, 64))
    x[100:] = x[7]
    rows = spark.createDataFrame([(i, v, float(i % 5)) for i, v in enumerate(x.tolist())], "ord bigint, vec array<double>, y double")
    points = neighbours.merged(rows, {"value": F.avg("y")})
    assert points.count() == 100 and points.select("pid").distinct().count() == 100
    base, cells = neighbours.build_cells(points)
    assert cells.table.agg(F.sum("n")).first()[0] == 100 and len(cells.tops) <= 3 and cells.table.count() > 3
    near = neighbours.knn(points, base, cells, 6, {"value": "double"}, skip_self=True)
    dist = {r["pid"]: r["vec"] for r in points.collect()}
    d = distances(np.array(list(dist.values())))
    weight = np.array([51.0 if list(v) == x[7].tolist() else 1.0 for v in dist.values()])
    ids = list(dist)
    got = {}
    for r in near.collect():
        got.setdefault(r["pid"], []).append((round(r["dist"], 9), r["near"], r["weight"]))
    for i, pid in enumerate(ids):
        want, have = [], 0.0
        for j in sorted(range(100), key=lambda j: (d[i, j], ids[j])):
            w = weight[j] - (i == j)
            if w > 0 and have < 6:
                want.append((round(d[i, j], 9), ids[j], w))
                have += w
        assert sorted(got[pid]) == sorted(want)
    back = neighbours.matched(rows, points, ["pid"])
    assert back.columns == ["ord", "vec", "y", "pid"] and back.count() == 150
    assert back.where("ord >= 100 or ord = 7").select("pid").distinct().count() == 1


def test_isolation_forest_finds_the_far_point(spark, points):
    rows = points.tolist() + [[40.0, -40.0]]
    df = spark.createDataFrame(list(enumerate(rows)), "ord bigint, v array<double>").select(
        "ord", array_to_vector("v").alias("features"))
    cfg = U.UnsupervisedConfig(n_trees=60, contamination=0.01)
    got = pandas_of(U.isolation_forest(df, len(rows), cfg))
    assert got["anomaly_score"].idxmin() == len(rows) - 1 and got["is_anomaly"].iloc[-1]
    again = pandas_of(U.isolation_forest(df.repartition(5), len(rows), cfg))
    np.testing.assert_allclose(got["anomaly_score"], again["anomaly_score"])


def test_cluster_board_and_measures(points, vectors):
    board, labels = U.run_clustering(vectors, U.UnsupervisedConfig(k_range=(3, 3), selected=("KMeans", "BisectingKMeans")))
    assert board.count() == 2
    lab = pandas_of(labels["KMeans_k3"])["cluster"].to_numpy()
    m = U.cluster_metrics(labels["KMeans_k3"])
    groups = [points[lab == c] for c in np.unique(lab)]
    centre = np.array([g.mean(0) for g in groups])
    s = np.array([np.linalg.norm(g - c, axis=1).mean() for g, c in zip(groups, centre)])
    gap = distances(centre) + np.diag([np.inf] * len(groups))
    assert m["davies_bouldin"] == pytest.approx(((s[:, None] + s[None]) / gap).max(1).mean())
    between = sum(len(g) * ((c - points.mean(0)) ** 2).sum() for g, c in zip(groups, centre))
    within = sum(((g - c) ** 2).sum() for g, c in zip(groups, centre))
    assert m["calinski_harabasz"] == pytest.approx(between / within * (len(points) - 3) / 2)


def test_components(points, vectors):
    got = U.run_pca(vectors, ["a", "b"], U.UnsupervisedConfig(n_components=2))
    values, axes = np.linalg.eigh(np.cov(points.T))
    assert got.explained.first()["ratio"] == pytest.approx(values[-1] / values.sum())
    scores = pandas_of(got.scores)["PC1"]
    np.testing.assert_allclose(np.abs(scores), np.abs((points - points.mean(0)) @ axes[:, -1]), atol=1e-9)


def test_profile_and_matrix(spark):
    s = as_series(spark, walk(90, 3))
    vectors, names = U.matrix(s, ["x1", "x2"])
    assert names == ["x1", "x2"] and vectors.count() == 90
    df = s.df.withColumn("cluster", (s.df.ord % 2).cast("int"))
    prof = U.cluster_profile(df, ["x1"])
    wide = U.profile_wide(prof, [0, 1]).first()
    x = walk(90, 3)["x1"]
    assert wide["overall_mean"] == pytest.approx(x.mean()) and wide["cluster_1"] == pytest.approx(x[1::2].mean())


def test_cluster_scores_in_blocks(spark, monkeypatch):
    """The same scores by blocks and salted centres as from all centres at once; noise is left out."""
    rng = np.random.default_rng(8)
    label = np.append(rng.integers(0, 9, 240), [-1] * 10)
    x = rng.normal(size=(250, 3)) + label[:, None] * [[1.0, 0.0, 2.0]]
    df = spark.createDataFrame([(Vectors.dense(v), int(c)) for v, c in zip(x, label)], ["features", "cluster"])
    whole = U.cluster_metrics(df)
    monkeypatch.setattr(U, "CENTRE_BLOCK", 2)
    monkeypatch.setattr(U, "CENTRE_CELLS", 5)
    parts = U.cluster_metrics(df)
    x, label = x[:240], label[:240]
    mid = np.array([x[label == c].mean(0) for c in range(9)])
    s = np.array([np.sqrt(((x[label == c] - mid[c]) ** 2).sum(1)).mean() for c in range(9)])
    ratio = [max((s[i] + s[j]) / np.linalg.norm(mid[i] - mid[j]) for j in range(9) if j != i) for i in range(9)]
    assert whole["noise_ratio"] == pytest.approx(0.04) and whole["n_clusters"] == 9 and parts["silhouette"] is None
    for got in (whole, parts):
        assert got["davies_bouldin"] == pytest.approx(np.mean(ratio))
        assert got["calinski_harabasz"] == pytest.approx(whole["calinski_harabasz"])


@pytest.mark.parametrize("dims", [2, 20])
def test_silhouette_beyond_the_centres_that_are_sent(spark, monkeypatch, dims):
    """The same silhouette by nearest neighbours as by definition and as Spark's: noise, a cluster of
    one row, clusters of one centre, and a vector that lies in two clusters."""
    rng = np.random.default_rng(dims)
    label = np.append(rng.integers(0, 9, 300), [-1] * 10)
    x = rng.normal(size=(310, dims)) + np.maximum(label, 0)[:, None]
    near, far = x[0] + 3, x[0] - 3
    x = np.vstack([x, x[[0, 0]], near[None] + 20, [near, far, near, far], [x[1]] * 3])
    label = np.append(label, [(label[0] + 1) % 9, (label[0] + 2) % 9, 9, 10, 10, 11, 11, 12, 12, 12])
    df = spark.createDataFrame([(Vectors.dense(v), int(c)) for v, c in zip(x, label)], ["features", "cluster"])
    spark_s = U.cluster_metrics(df)["silhouette"]
    monkeypatch.setattr(U, "CENTRE_SENT", 5)
    got = U.cluster_metrics(df)
    x, label = x[label >= 0], label[label >= 0]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i, c in enumerate(label):
        b = min(d[i, label == o].mean() for o in set(label) - {c})
        a = d[i, label == c].sum() / max((label == c).sum() - 1, 1)
        s.append((b - a) / max(a, b) if (label == c).sum() > 1 and a != b else 0.0)
    assert got["n_clusters"] == 13 and got["silhouette"] == pytest.approx(np.mean(s)) and spark_s == pytest.approx(np.mean(s))


def test_boxes_where_tasks_have_no_rows(spark, monkeypatch):
    """A large file is read in more tasks than it has row groups; the others are empty."""
    monkeypatch.setattr(leaves, "LEAF_ROWS", 60)
    monkeypatch.setattr(leaves, "LEAST", 2)
    x = np.random.default_rng(4).normal(size=(400, 20))
    base = spark.createDataFrame([(i, 1.0, v.tolist()) for i, v in enumerate(x)], "pid bigint, weight double, vec array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        placed, tree = leaves.grown(base)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert placed.count() == 400 and tree.table.agg(F.sum("n")).first()[0] == 400


def single_linkage(x, k):
    """Label per row: clusters merge by their nearest members until k are left."""
    d = distances(np.unique(x, axis=0))
    of = np.arange(len(d))
    for i, j in sorted(zip(*np.triu_indices(len(d), 1)), key=lambda p: d[p]):
        if len(set(of)) <= k:
            break
        of[of == of[j]] = of[i]
    return of[np.unique(x, axis=0, return_inverse=True)[1].ravel()]


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("dims", [2, 24])
def test_single_linkage_matches_brute_force(spark, dims, monkeypatch):
    for name, size in (("TOPS", 4), ("CELL_ROWS", 40), ("BASE_BLOCK", 60), ("QUERY_BLOCK", 60)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(dims)
    x = np.vstack([rng.normal(c, 1.0, (110, dims)) for c in (0, 4, 9)] + [np.repeat(rng.normal(0, 1, (1, dims)), 170, 0)])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "ord bigint, v array<double>") \
              .select("ord", array_to_vector("v").alias("features"))
    tree = linkage.merges(df)
    assert tree.table.count() == len(np.unique(x, axis=0)) - 1
    for k, found in linkage.cut(tree, [1, 2, 3, 7, 40]).items():
        got = pandas_of(found)["cluster"].to_numpy()
        assert len(got) == len(x) and same_groups(got, single_linkage(x, k))
        assert got[0] == 0
    lengths = sorted(r["dist"] for r in tree.table.select("dist").collect())
    got = pandas_of(linkage.cut_at(tree, lengths[-30]))["cluster"].to_numpy()
    assert same_groups(got, single_linkage(x, 30)) and [g for i, g in enumerate(got) if g not in got[:i]] == list(range(30))


def test_single_linkage_of_ties_and_few_points(spark):
    def frame(x):
        return spark.createDataFrame(list(enumerate(x)), "ord bigint, v array<double>") \
                    .select("ord", array_to_vector("v").alias("features"))
    grid = [[float(i), float(j)] for i in range(6) for j in range(5)] + [[40.0, 0.0], [40.0, 1.0]]
    two = linkage.cut(linkage.merges(frame(grid)), [2])[2]
    assert pandas_of(two)["cluster"].tolist() == [0] * 30 + [1, 1]
    assert pandas_of(linkage.cut(linkage.merges(frame([[1.0], [1.0], [3.0]])), [5])[5])["cluster"].tolist() == [0, 0, 1]
    assert pandas_of(linkage.cut(linkage.merges(frame([[1.0], [1.0]])), [2])[2])["cluster"].tolist() == [0, 0]
