"""Coverage gates, resumed tables, contexts, budgets, names, and joins with bounds."""

import json

import numpy as np
import pytest

from seriata.operators import clustering, joins, occupancy, reports, sampling
from seriata.sources import cache


def test_gate(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 4.0)], "s string, r int, x double")
    expected = spark.createDataFrame([("a", 1), ("a", 2)], "s string, r int")
    assert reports.covered_partials(rows, expected, ["s", "r"]).count() == 2
    for bad in (rows.limit(1), rows.unionByName(rows.limit(1)), rows.unionByName(spark.createDataFrame([("b", 1, 0.0)], rows.schema))):
        with pytest.raises(Exception, match="missing, repeated"):
            reports.covered_partials(bad, expected, ["s", "r"]).collect()


def test_members_told_twice(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "a", 1.0)], "f int, m string, x double")
    with pytest.raises(Exception, match="two scores"):
        reports.member_correlations(rows, [], "f", "m", ["x"]).collect()


def test_tables_are_built_once(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(5)

    where = f"file://{tmp_path}"
    for contract in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert cache.resumed(spark, where, "t", contract, build).count() == 5
    assert len(made) == 2
    left = next(p for p in tmp_path.iterdir() if p.is_dir())
    for p in (left / "_contract").iterdir():
        p.unlink()  # as if the run had ended before the sidecar
    assert sum(cache.resumed(spark, where, "t", c, build).count() for c in ({"a": 1}, {"a": 2})) == 10 and len(made) == 3


def test_coordinates_are_unwrapped_before_they_are_thinned(spark, tmp_path):
    rows = [("s", "r", "g", k, 7, (k * 0.3) % 1.0, 0.5, 0.5) for k in range(9)]
    points = spark.createDataFrame(rows, "system_id string, replica_id string, segment_id string, ord long, id long, x double, y double, z double")
    got = cache.coordinate_cache(spark, f"file://{tmp_path}", points, (1.0, 1.0, 1.0), stride=4).orderBy("ord").collect()
    assert [(r.ord, round(r.x, 9), r.y) for r in got] == [(0, 0.0, 0.5), (4, 1.2, 0.5), (8, 2.4, 0.5)]


def test_context():
    system = json.dumps({"systems": [{"system_id": "a", "replicas": [1]}]})
    told = cache.compile_context('{"modules": ["rmsf_profile"], "static_ensemble": true}', system)
    assert told["signature"] == cache.compile_context('{"static_ensemble": true, "modules": ["rmsf_profile"]}', system)["signature"]
    for project, other in (('{"modules": []}', system), ('{"modules": ["markov_model"], "static_ensemble": true}', system), ('{"modules": ["x"], "modules": ["y"]}', system), ('{"modules": ["x"]}', '{"systems": [{"system_id": "a"}]}')):
        with pytest.raises(ValueError):
            cache.compile_context(project, other)


def test_budgets(spark):
    assert sampling.stride_fitting(100_000, 1.0, 249.0) == 401 and 100_000 // 401 == 249
    assert sampling.stride_fitting(10, 1.0, 100.0) == 1 and sampling.stride_fitting(1000, 0.1, 1000.0, bytes_a_frame=8, budget_bytes=80) == 91
    with pytest.raises(ValueError):
        sampling.stride_fitting(10, 5.0, 4.0)
    rows = spark.range(30).selectExpr("id as ord", "if(id < 20, 'a', 'b') as g")
    got = sampling.balanced_budget(rows, ["g"], 8).groupBy("g").agg({"ord": "min", "*": "count"}).collect()
    assert {(r.g, r["count(1)"], r["min(ord)"]) for r in got} == {("a", 4, 0), ("b", 4, 20)}


def test_pairings_are_bounded(spark):
    rows = spark.range(30).selectExpr("1 as frame", "1 as hub", "id as endpoint")
    assert joins.bridges(rows, "frame", "endpoint", "hub", most=30).count() == 435
    with pytest.raises(ValueError, match="at most 29"):
        joins.bridges(rows, "frame", "endpoint", "hub", most=29)
    with pytest.raises(ValueError, match="at most 5"):
        occupancy.pairwise_jaccard(rows, "endpoint", "hub", most=5)


def test_names_by_rules(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", None)], "k string, t string")
    rules = lambda *r: spark.createDataFrame(list(r), "k string, t string, name string")
    told = lambda r: sorted(x.name for x in occupancy.canonical_names(rows, r, ["k", "t"], "name").collect())
    assert told(rules(("a", None, "A"), (None, "y", "Y"))) == ["A", "A", "Y", "c"] and told(rules(("a", "x", "AX"))) == ["AX", "AX", "b", "c"]
    assert told(rules((None, None, "all"))) == ["all"] * 4 and told(rules(("z", None, "Z")).limit(0)) == ["a", "a", "b", "c"]
    for bad in (rules(("a", None, "A"), (None, "x", "X")), rules(("a", None, "A"), ("a", None, "B"))):
        with pytest.raises(Exception, match="several mapping rules"):
            told(bad)


def test_nearest_however_far(spark):
    schema = "frame int, id long, x double, y double, z double"
    left = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 500.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)], schema)
    right = spark.createDataFrame([(1, 8, 0.5, 0.0, 0.0), (1, 7, 0.0, 0.5, 0.0), (1, 9, 1e7, 0.0, 0.0)], schema)
    got = joins.nearest_anywhere(left, right, 1.0, ["frame"], doublings=3).collect()
    assert sorted((r.frame, r.left_id, r.right_id, round(r.distance, 3)) for r in got) == [(1, 1, 7, 0.5), (1, 2, 8, 499.5)]


def test_centres_in_batches_and_expressions_agree(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 3)))] + [(99, None)], "id int, v array<double>")
    centers, weights = rng.normal(size=(6, 3)), rng.uniform(0.1, 1, (6, 3))
    for p, w, most in ((2.0, None, None), (1.5, weights, None), (2.0, None, 0.8)):
        told = []
        for limit in (2000, 1):
            monkeypatch.setattr(clustering, "MAX_LITERALS", limit)
            made = clustering.assign_nearest(rows, "v", centers, p, w, most).orderBy("id").collect()
            told.append([(r.id, r.cluster, None if r.cluster_distance is None else round(r.cluster_distance, 9)) for r in made])
        assert told[0] == told[1] and told[0][-1] == (99, None, None)
