"""Kernels against plain definitions and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriata.operators import clustering, learning, linear, markov, structures

rng = np.random.default_rng(7)
BLOBS = np.vstack([rng.normal(c, 0.15, (20, 2)) for c in ((0, 0), (3, 0), (0, 3))])
TRUTH = np.repeat([0, 1, 2], 20)


def agrees(labels):
    return len({(a, b) for a, b in zip(labels, TRUTH, strict=True)}) == 3


@pytest.mark.parametrize("make", [
    lambda x: clustering.pam(x, 3), lambda x: clustering.ward(x, 3), lambda x: clustering.minkowski_weighted(x, 3, 2.0), lambda x: clustering.minkowski_weighted(x, 3, 1.5),
    lambda x: clustering.minkowski_weighted(x, 3, 2.0, around_medoids=True), lambda x: clustering.mean_shift(x, 1.0), lambda x: clustering.quality_threshold(x, 1.2), clustering.affinity_propagation,
])
def test_families_find_blobs(make):
    part = make(BLOBS)
    if len(part.centers) == 3:
        assert agrees(part.labels)
    else:  # affinity propagation may cut blobs further, never join them
        assert len(part.centers) > 3 and all(len(set(TRUTH[part.labels == c])) == 1 for c in range(len(part.centers)))


def test_silhouette_of_a_matrix():
    d = clustering.distances(BLOBS)
    want = []
    for i in range(len(BLOBS)):
        a = d[i][(TRUTH == TRUTH[i]) & (np.arange(60) != i)].mean()
        b = min(d[i][TRUTH == c].mean() for c in range(3) if c != TRUTH[i])
        want.append((b - a) / max(a, b))
    assert clustering.matrix_silhouette(d, TRUTH) == pytest.approx(np.mean(want))


def test_local_depths_sum_to_half():
    c = clustering.local_depths(clustering.distances(BLOBS))
    assert c.sum() == pytest.approx(len(BLOBS) / 2)
    labels = np.array(clustering.communities(c)[0])
    assert all(len(set(TRUTH[labels == k])) == 1 for k in set(labels.tolist()))


def test_kmeans_over_rows(spark):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(BLOBS)], "id long, v array<double>")
    part = clustering.kmeans(df, "id", "v", 3)
    got = clustering.assign_nearest(df, "v", part.centers).orderBy("id").collect()
    assert part.converged and agrees([r.cluster for r in got])
    far = clustering.assign_nearest(df, "v", part.centers, max_distance=1e-9)
    assert far.where("cluster is not null").count() == 0


def test_components_against_numpy(spark):
    x = rng.normal(size=(200, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0.5, 0.2]])
    df = spark.createDataFrame([("s", "r", "g", i, *map(float, r)) for i, r in enumerate(x)], "system_id string, replica_id string, segment_id string, ord long, a double, b double, c double")
    made = linear.principal_components(df, ["a", "b", "c"], 3)
    assert np.allclose(made.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1])
    scores = np.array(df.orderBy("ord").select(*made.project(["a", "b", "c"])).collect())
    assert np.allclose(scores.var(0), made.values) and np.allclose(scores.mean(0), 0)
    values, vectors = linear.randomized_components(np.cov(x.T, bias=True), 2)
    assert np.allclose(values, made.values[:2]) and np.allclose(vectors, made.vectors[:2], atol=1e-6)
    slow = linear.time_lagged_components(df, ["a", "b", "c"], 1, 2)
    assert (np.abs(slow.values) <= 1).all()


def test_markov():
    counts = np.array([[90.0, 10, 0], [8, 80, 12], [0, 14, 86]])
    for t, pi in (markov.reversible(counts), markov.maximum_likelihood(counts)):
        assert np.allclose(t.sum(1), 1) and np.allclose(pi @ t, pi) and np.allclose(pi[:, None] * t, (pi[:, None] * t).T)
        assert all(v > 0 for v in markov.implied_timescales(t, pi, 1))
    t = markov.reversible(counts)[0]
    assert markov.chapman_kolmogorov(t, t @ t, 2) == pytest.approx(0)
    assert markov.connected(np.array([[1, 1, 0], [0, 1, 0], [0, 0, 1]])) == [[0, 1], [2]]
    assert 1 <= markov.vamp2(counts, counts) <= 3


def rotation(seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))[0]
    return q * np.linalg.det(q)


def test_best_fit():
    p = rng.normal(size=(12, 3))
    r, t, gap = structures.best_fit(p, p @ rotation(1).T + 5)
    assert gap < 1e-7 and np.allclose(p @ r.T + t, p @ rotation(1).T + 5) and np.linalg.det(r) == pytest.approx(1)
    assert structures.best_fit(p * [1, 1, -1], p)[2] > 0.1


def test_assignment_is_optimal():
    for seed in range(20):
        cost = np.random.default_rng(seed).random((4, 6))
        got = structures.assign_optimally(cost)
        assert len(set(got)) == 4
        assert sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 4)))


def test_shapes_and_areas():
    octahedron = np.array(structures.SHAPES["octahedral"], float) @ rotation(3).T
    told = structures.coordination_shape(np.zeros(3), 2.1 * octahedron)
    assert told["shape"] == "octahedral" and told["angle_rms"] < 1e-5 and told["fit_rmsd"] < 1e-6
    assert structures.surface_areas(np.zeros((1, 3)), np.array([1.6]), 1.4)[0] == pytest.approx(4 * np.pi * 9)
    pair = structures.surface_areas(np.array([[0, 0, 0], [100.0, 0, 0]]), np.array([1.0, 1.0]))
    assert pair[0] == pytest.approx(pair[1])
    ring = np.array([[np.cos(a), np.sin(a), 0] for a in np.arange(6) * np.pi / 3])
    assert structures.ring_geometry(ring)["max_departure"] == pytest.approx(0, abs=1e-9)


def test_unwrap_and_whole(spark):
    box = np.array([10.0, 10, 10])
    path = np.cumsum(rng.normal(0, 1, (50, 2, 3)), axis=0)
    assert np.allclose(structures.unwrap(path % box, box) - (path % box)[:1], path - path[:1])
    split = np.array([[9.5, 5, 5], [0.5, 5, 5]])
    assert np.allclose(structures.make_whole(split, [(0, 1)], box)[1], [10.5, 5, 5])
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(path[:, 0, 0] % 10)], "k long, x double")
    made = df.withColumn("u", structures.unwrapped(F.col("x"), 10.0, W.orderBy("k"))).orderBy("k").collect()
    assert np.allclose([r.u for r in made], structures.unwrap((path % box)[:, :1], box)[:, 0, 0])


def test_permutation_exact():
    a, b = np.array([[3.0], [4], [5]]), np.array([[0.0], [1], [2]])
    told = learning.permutation_test(a, b)
    assert told["method"] == "exact" and told["splits"] == 20 and told["p"][0] == pytest.approx(2 / 20)
    assert learning.permutation_test(a, b, exact_limit=5, draws=200)["method"] == "monte_carlo"


def test_classifiers():
    x, y, g = BLOBS, TRUTH, np.tile(np.arange(4), 15)
    guess = learning.leave_group_out(x, y, g, lambda a, b, c: learning.predict_tree(learning.fit_tree(a, b), c))
    assert learning.macro_metrics(y, guess) == (1.0, 1.0)
    told = learning.nested_classification(x, y, g, strengths=(1.0, 10.0))
    assert told["full"]["accuracy"] == 1.0 and told["top_feature_only"]["accuracy"] < 1.0
    with pytest.raises(ValueError, match="fewer than two groups"):
        learning.nested_classification(x, y, y)
    assert learning.macro_metrics(np.array([0, 0]), np.array([1, 1])) == (0.0, 0.0)


def test_bootstrap_covers_the_mean():
    v = rng.normal(2, 1, 400)
    lo, hi = learning.block_bootstrap(v, np.repeat([0, 1], 200), 10)
    assert lo < v.mean() < hi
