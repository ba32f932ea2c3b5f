"""Registered results that SQL can't state, against plain NumPy over the same tables."""

import itertools

import numpy as np
import pandas as pd
import pytest

from seriata.operators import clustering
from seriata.plans.bindings import DIMS
from seriata.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def table():
    df = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id", ignore_index=True)
    return df.vec_id.to_numpy(), np.stack(df.embedding.to_numpy()).astype(float), df.label.to_numpy()


@pytest.fixture(scope="module")
def sequences():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["user_id", "ts", "event_id"])
    return [list(g.event_type) for _, g in e.groupby(["user_id", e.ts.dt.date], sort=True)]


def rows(spark, name, *keys):
    return QUERIES[name](spark, SF).toPandas().sort_values(list(keys), ignore_index=True)


def kabsch(mobile, target):
    a, b = mobile - mobile.mean(0), target - target.mean(0)
    u, _, v = np.linalg.svd(a.T @ b)
    turn = u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v
    return np.sqrt(((a @ turn - b) ** 2).sum(1).mean())


def test_fits(spark, table):
    ids, x, _ = table
    points = x[:, :48].reshape(len(x), 16, 3)
    got = rows(spark, "fitted_rmsd", "vec_id")
    assert np.allclose(got.rmsd, [kabsch(p, points[0]) for p in points], atol=2e-6)
    assert np.allclose(got.rg, [np.sqrt(((p - p.mean(0)) ** 2).sum(1).mean()) for p in points], atol=2e-6)
    plane = [np.linalg.eigvalsh((p - p.mean(0)).T @ (p - p.mean(0)))[0] for p in points]
    made = rows(spark, "surface_and_plane", "vec_id")
    assert np.allclose(made.plane_rms, np.sqrt(np.maximum(plane, 0) / 16), atol=2e-6)
    # every atom is covered in part: the area lies between the largest sphere's and that of all apart
    one = 4 * np.pi * 2.9**2
    assert ((made.area > one) & (made.area < 16 * one)).all()
    ring = rows(spark, "ring_and_coordination", "vec_id")
    for p, worst in zip(points[:40], ring.max_departure[:40], strict=True):
        turns = []
        for k in range(5):
            a, b, c, d = (p[(k + i) % 5] for i in range(4))
            n1, n2 = np.cross(b - a, c - b), np.cross(c - b, d - c)
            angle = np.degrees(np.arccos(np.clip(n1 @ n2 / np.linalg.norm(n1) / np.linalg.norm(n2), -1, 1)))
            turns.append(min(angle, 180 - angle))
        assert abs(max(turns) - worst) < 1e-4


def test_components(spark, table):
    ids, x, label = table
    d = x[:, : len(DIMS)]
    values, vectors = np.linalg.eigh(np.cov(d.T, bias=True))
    got = rows(spark, "principal_components", "component")
    assert np.allclose(got.eigenvalue, values[::-1][:4], atol=2e-6) and np.allclose(got.share, values[::-1][:4] / values.sum(), atol=2e-6)
    scores = rows(spark, "component_scores", "vec_id")
    for k in (1, 2):
        assert np.allclose(np.abs(scores[f"score_{k}"]), np.abs((d - d.mean(0)) @ vectors[:, -k]), atol=3e-6)
    # lag 1 inside a label's rows of one system and replica
    series = {}
    for i, v, g in zip(ids, d, label, strict=True):
        series.setdefault((g % 2, i % 4, g), []).append(v)
    a = np.concatenate([np.array(s)[:-1] for s in series.values()])
    b = np.concatenate([np.array(s)[1:] for s in series.values()])
    mean = (a.mean(0) + b.mean(0)) / 2
    a, b = a - mean, b - mean
    c0, c1 = (a.T @ a + b.T @ b) / (2 * len(a)), (a.T @ b + b.T @ a) / (2 * len(a))
    c0 += 1e-10 * np.trace(c0) / len(c0) * np.eye(len(c0))
    slow = np.linalg.eigvals(np.linalg.solve(c0, c1)).real
    assert np.allclose(rows(spark, "time_lagged_components", "component").eigenvalue, slow[np.argsort(-np.abs(slow))][:3], atol=2e-6)


def counts_of(sequences, lag, names):
    out = np.zeros((len(names), len(names)))
    for s in sequences:
        for x, y in zip(s, s[lag:], strict=False):
            out[names.index(x), names.index(y)] += 1
    return out


def test_markov(spark, sequences):
    names = sorted({x for s in sequences for x in s})
    scales = {}
    for lag in (1, 2, 3):
        both = counts_of(sequences, lag, names)
        both = both + both.T
        values = np.sort(np.linalg.eigvals(both / both.sum(1, keepdims=True)).real)[::-1][1:]
        scales[lag] = [-lag / np.log(v) if 0 < v < 1 else None for v in values]
    got = QUERIES["markov_model"](spark, SF).toPandas().set_index("state").loc[names]
    both = counts_of(sequences, 1, names)
    both = both + both.T
    assert np.allclose(got.stationary, both.sum(1) / both.sum(), atol=2e-6)
    known = [None, *scales[1]]
    assert all((a is None) == np.isnan(b) and (a is None or abs(a - b) < 2e-6) for a, b in zip(known, got.timescale, strict=True))
    stability = rows(spark, "timescale_stability", "mode") if QUERIES["timescale_stability"](spark, SF).count() else pd.DataFrame({"mode": []})
    want = {m: v for m in range(len(names) - 1) if len(v := [scales[k][m] for k in scales if scales[k][m] is not None]) > 1}
    assert [m - 1 for m in stability["mode"]] == sorted(want)
    for m, spread in zip(stability["mode"], stability.get("relative_range", []), strict=True):
        assert abs(spread - (max(want[m - 1]) - min(want[m - 1])) / np.median(want[m - 1])) < 2e-6


def test_vamp(spark, sequences):
    names = sorted({x for s in sequences for x in s})
    eye, folds = np.eye(len(names)), [[], [], []]
    for s in sequences:
        pairs = list(zip(s, s[1:], strict=False))
        for i, p in enumerate(pairs):
            folds[min(2, i * 3 // len(pairs))].append(p)
    for r in rows(spark, "vamp_cross_validation", "fold").itertuples():
        hot = lambda pairs, k: np.array([eye[names.index(p[k])] for p in pairs])
        train = [p for k, f in enumerate(folds) if k != r.fold for p in f]
        assert (r.training_pairs, r.testing_pairs) == (len(train), len(folds[r.fold]))
        a, b = hot(train, 0), hot(train, 1)
        wa, wb = (np.diag((c.mean(0) + 1e-10) ** -0.5) for c in (a, b))
        u, s, v = np.linalg.svd(wa @ (a.T @ b / len(a)) @ wb)
        f, g = hot(folds[r.fold], 0) @ wa @ u, hot(folds[r.fold], 1) @ wb @ v.T
        n, k = len(f), np.diag(s)
        score = np.trace(2 * k @ (f.T @ g / n) - k @ (f.T @ f / n) @ k @ (g.T @ g / n))
        assert abs(r.training_vamp2 - (s**2).sum()) < 2e-6 and abs(r.heldout_vamp_e - score) < 2e-6


def test_partitions(spark, table):
    ids, x, _ = table
    d = x[:, : len(DIMS)]
    keys, sample = clustering.sample_matrix(short_vectors(spark), "vec_id", "v", 1000)
    centers = clustering.farthest_first(sample, 4)
    for _ in range(12):
        label = ((d[:, None] - centers[None]) ** 2).sum(2).argmin(1)
        moved = np.stack([d[label == k].mean(0) for k in range(4)])
        if np.abs(moved - centers).max() <= 1e-9:
            break
        centers = moved
    centers = centers if np.abs(moved - centers).max() <= 1e-9 else moved
    centers = centers[np.lexsort(centers.T[::-1])]
    apart = np.sqrt(((d[:, None] - centers[None]) ** 2).sum(2))
    got = rows(spark, "kmeans_partition", "cluster")
    assert got.n.tolist() == np.bincount(apart.argmin(1), minlength=4).tolist()
    assert np.allclose(got.mean_distance, [apart.min(1)[apart.argmin(1) == k].mean() for k in range(4)], atol=2e-6)
    assert rows(spark, "minkowski_partition", "cluster").n.sum() == len(ids)
    grid = rows(spark, "kmeans_grid", "rank")
    assert grid.silhouette.is_monotonic_decreasing and set(grid.k) <= {2, 3, 4, 5} and (grid.stability <= 1).all()
    swept = QUERIES["alternative_partitions"](spark, SF).toPandas()
    whole = ~swept.name.isin(["quality_threshold"]) & swept.valid
    assert (swept.full_retained_fraction[whole] == 1).all() and (swept.full_states[whole] == swept.states[whole]).all()


def short_vectors(spark):
    from pyspark.sql import functions as F

    from seriata.plans.bindings import vectors

    return vectors(spark, SF).select("vec_id", F.array(*DIMS).alias("v"))


def test_depth_communities(spark):
    keys, x = clustering.sample_matrix(short_vectors(spark), "vec_id", "v", 500)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    n = len(x)
    cohesion = np.zeros((n, n))
    for i, j in itertools.combinations(range(n), 2):
        local = np.flatnonzero((d[i] <= d[i, j]) | (d[j] <= d[i, j]))
        for k in (i, j):
            other = j if k == i else i
            cohesion[k, local] += np.where(d[k, local] < d[other, local], 1.0, np.where(d[k, local] == d[other, local], 0.5, 0.0)) / len(local)
    cohesion /= n - 1
    tie = np.minimum(cohesion, cohesion.T)
    strong = (tie >= np.diag(cohesion).mean() / 2) & (tie > 0) & ~np.eye(n, dtype=bool)
    root = list(range(n))
    for i, j in zip(*np.nonzero(strong), strict=True):
        a, b = sorted((root[i], root[j]))
        root = [a if r == b else r for r in root]
    got = QUERIES["depth_communities"](spark, SF).toPandas().set_index("vec_id").community.loc[keys].tolist()
    assert len(set(zip(got, root, strict=True))) == len(set(got)) == len(set(root))


def test_pattern_medoids(spark):
    o, li, pt = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem", "part"))
    m = o.merge(li, left_on="o_orderkey", right_on="l_orderkey").merge(pt, left_on="l_partkey", right_on="p_partkey")
    counts = m.groupby(["o_orderstatus", "o_orderpriority", "p_brand"]).size()
    sets = {}
    for (s, p, b), c in counts.items():
        sets.setdefault((s, p), set()).update([b] if c >= 3 else [])
    keys = sorted(k for k, v in sets.items() if v)
    d = np.array([[1 - len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in keys] for a in keys])
    got = {(r.system_id, r.replica_id): (r.cluster, r.medoid) for r in QUERIES["pattern_medoids"](spark, SF).collect()}
    assert sorted(got) == keys
    if d.any():
        chosen = [k for k in keys if got[k][1]]
        assert len(chosen) == 2
        for k in keys:
            own = [d[keys.index(k), keys.index(c)] for c in chosen]
            mine = next(c for c in chosen if got[c][0] == got[k][0])
            assert d[keys.index(k), keys.index(mine)] == min(own)
        for c in chosen:  # no other row of its cluster would cost less
            group = [keys.index(k) for k in keys if got[k][0] == got[c][0]]
            cost = d[np.ix_(group, group)].sum(1)
            assert cost[group.index(keys.index(c))] == cost.min()


def test_grouped_models(spark):
    e = pd.read_parquet(f"{SF}/events.parquet")
    users = e.groupby("user_id")
    x = np.stack([users.value.mean(), users.value.std(ddof=0).fillna(0), users.event_type.apply(lambda t: (t == "error").mean())], 1)
    y = users.ngroup().groupby(e.user_id).first().index.to_numpy() % 2
    tree = QUERIES["grouped_tree"](spark, SF).first()
    assert tree.rows == len(x) and 0 <= tree.macro_f1 <= 1 and abs(tree.accuracy * len(x) - round(tree.accuracy * len(x))) < 0.01
    told = {r.model: r for r in QUERIES["grouped_logistic"](spark, SF).collect()}
    share = max(y.mean(), 1 - y.mean())
    assert set(told) == {"full", "top_feature_only", "without_top_feature"} and all(abs(r.accuracy - share) < 0.25 for r in told.values())
