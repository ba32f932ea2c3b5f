"""Operators on small inputs with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata.functions import scalars
from seriata.operators import distributions, graphs, information, joins, occupancy, runs, sampling, summaries
from seriata.operators.model import order_issues, require


def series(spark, segments, value="state"):
    kind = "string" if isinstance(next(x for s in segments.values() for x in s if x is not None), str) else "double"
    rows = [("s", "r", seg, k + base, v) for base, (seg, vs) in enumerate(segments.items()) for k, v in enumerate(vs)]
    rows = [(a, b, c, k, v) for k, (a, b, c, _, v) in enumerate(rows)]
    return spark.createDataFrame(rows, f"system_id string, replica_id string, segment_id string, ord long, {value} {kind}")


def test_runs_are_cut_and_censored_at_segments(spark):
    df = series(spark, {"a": ["0", "0", "1"], "b": ["1", "1", "0"]})
    got = [(r.segment_id, r.length, r.left_censored, r.right_censored) for r in runs.residence_runs(df).orderBy("segment_id", "run_id").collect()]
    assert got == [("a", 2, True, False), ("a", 1, False, True), ("b", 2, True, False), ("b", 1, False, True)]
    joined = series(spark, {"a": ["0", "0", "1", "1", "1", "0"]})
    assert [r.length for r in runs.residence_runs(joined).orderBy("run_id").collect()] == [2, 3, 1]


def test_runs_of_null_states(spark):
    assert [r.length for r in runs.residence_runs(series(spark, {"a": [None, None, "x"]})).orderBy("run_id").collect()] == [2, 1]
    assert runs.residence_runs(series(spark, {"a": ["x"]}).limit(0)).count() == 0


def test_transitions(spark):
    got = runs.transition_matrix(series(spark, {"a": ["0", "0", "1", "1"], "b": ["1", "0"]}))
    assert {(r.from_state, r.to_state): r.transitions for r in got.collect()} == {("0", "0"): 1, ("0", "1"): 1, ("1", "1"): 1, ("1", "0"): 1}
    assert {r.p for r in got.groupBy("from_state").agg(F.sum("probability").alias("p")).collect()} == {1.0}


def test_lag_pairs_stay_in_segments(spark):
    assert runs.lag_pairs(series(spark, {"a": [1.0, 2.0, 3.0], "b": [4.0, 5.0, 6.0]}, "v"), ["v"], 1).count() == 4


@pytest.mark.parametrize("values, ess", [([0.0, 1.0] * 3, 6.0), ([2.0, 2.0, 2.0], None)])
def test_effective_sample_size(spark, values, ess):
    rho = runs.autocorrelation(series(spark, {"a": values}, "v"), "v", 2)
    assert runs.effective_sample_size(rho).first().ess == ess


def test_effective_sample_size_past_the_first_lags(spark):
    values = {"a": [float(k) for k in range(60)], "b": [float(k * 7 % 11) for k in range(60)], "c": [float(k // 10) if k % 9 else None for k in range(60)], "d": [1.0] * 20}
    got = {r.replica_id: r for r in runs.whole_effective_sample_size(series(spark, values, "v").withColumn("replica_id", F.col("segment_id")), "v", 4).collect()}
    for name, v in values.items():
        there = [x for x in v if x is not None]
        n, mean = len(there), sum(there) / len(there)
        var = sum((x - mean) ** 2 for x in there) / n
        kept = 0, 0.0
        for lag in range(1, len(v)):
            pairs = [(x - mean) * (y - mean) for x, y in zip(v, v[lag:], strict=False) if x is not None and y is not None]
            if not var or not pairs or sum(pairs) <= 0:
                break
            kept = kept[0] + 1, kept[1] + sum(pairs) / len(pairs) / var
        row = got[name]
        assert (row.n, row.positive_lags) == (n, kept[0])
        assert row.ess is None if not var else abs(row.ess - min(n, n / max(1, 1 + 2 * kept[1]))) < 1e-9
    assert got["a"].positive_lags > 12


def test_one_way_driver(spark):
    import random

    draw = random.Random(3)
    x = [float(draw.random() < 0.5) for _ in range(3000)]
    rows = [("s", "r", "a", k, a, b) for k, (a, b) in enumerate(zip(x, [0.0, *x[:-1]], strict=True))]
    df = spark.createDataFrame(rows, "system_id string, replica_id string, segment_id string, ord long, x double, y double")
    assert information.transfer_entropy(df, "x", "y").first().transfer_entropy > 0.6
    assert information.transfer_entropy(df, "y", "x").first().transfer_entropy < 0.01
    lagged = {(r.source, r.target): r.correlation for r in information.lagged_correlation(df, ["x", "y"], 1).collect()}
    assert lagged["x", "y"] > 0.99 and abs(lagged["y", "x"]) < 0.1


def test_constant_columns_are_undefined(spark):
    df = series(spark, {"a": [1.0, 1.0, 1.0]}, "v").withColumn("w", F.col("ord").cast("double"))
    assert {r.correlation for r in information.covariance(df, ["v", "w"]).where("i = 'v'").collect()} == {None}
    assert information.coskewness(df, ["v", "w"]).where("i = 'v'").first().coskewness is None
    binned = information.quantile_bins(df, ["v", "w"], 2)
    assert {r.nmi for r in information.mutual_information(binned, ["b_v", "b_w"]).where("i = 'b_v'").collect()} == {None}


def test_populations_keep_unassigned_rows(spark):
    rows = [("bound", "r1", "1"), ("bound", "r1", "1"), ("bound", "r1", None), ("unbound", "r1", "1"), ("unbound", "r1", "2"), ("unbound", "r2", "2")]
    got = summaries.state_populations(spark.createDataFrame(rows, "system_id string, replica_id string, state string"), "state")
    system = {(r.system_id, r.state): r for r in got.where("level = 'system'").collect()}
    assert system["bound", "1"].coverage == pytest.approx(2 / 3)
    assert system["unbound", "2"].state_count == 2 and system["bound", "2"].state_count == 0
    assert got.where("level = 'replica'").select("system_id", "replica_id").distinct().count() == 3
    gaps = {r.state: r.difference for r in summaries.population_differences(got, "state").collect()}
    assert gaps["1"] == pytest.approx(1 / 3)


def test_scott_histogram(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    made = distributions.histogram(df, "v", "scott", least=1).orderBy("bin").collect()
    sd = math.sqrt(sum((k - 50.5) ** 2 for k in range(1, 101)) / 100)
    assert len(made) == math.ceil(99 / (3.5 * sd * 100 ** (-1 / 3)))
    assert sum(r.n for r in made) == 100
    assert distributions.histogram(df.withColumn("v", F.lit(3.0)), "v", "rice").agg(F.sum("n")).first()[0] == 100


def test_basins_and_smoothing(spark):
    cells = spark.createDataFrame([(0, 0, 9), (0, 1, 4), (1, 1, 3), (3, 3, 8), (3, 2, 2), (5, 0, 1)], "x_bin long, y_bin long, n long")
    got = {(r.x_bin, r.y_bin): r.basin_id for r in distributions.basins(cells).collect()}
    assert got[0, 0] == got[0, 1] == got[1, 1] == 1 and got[3, 3] == got[3, 2] == 2 and got[5, 0] == 3
    assert distributions.smoothed(cells, 1.0, 6).agg(F.sum("surface")).first()[0] == pytest.approx(27)


def test_strides_drop_the_partial_interval(spark):
    df = series(spark, {"a": [float(k) for k in range(100)]}, "v")
    assert [r.ord for r in sampling.fixed_stride(df, 40).orderBy("ord").collect()] == [0, 40]
    assert [r.ord for r in sampling.uniform_budget(df, 3).orderBy("ord").collect()] == [0, 49, 99]
    assert [r.ord for r in sampling.uniform_budget(df, 1).collect()] == [50]
    told = sampling.stride_for_budget(df, 33).first()
    assert (told.stride, told.selected) == (3, 33)


def test_occupancy_counts_empty_frames_and_replicas(spark):
    frames = spark.createDataFrame([("a", "1", k) for k in range(4)] + [("a", "2", k) for k in range(4, 6)], "system_id string, replica_id string, frame long")
    seen = spark.createDataFrame([("a", "1", 0, "x"), ("a", "1", 0, "x"), ("a", "1", 1, "x")], "system_id string, replica_id string, frame long, item string")
    row = occupancy.occupancy(seen, frames, "item").first()
    assert row.pooled_occupancy == pytest.approx(2 / 6) and row.replica_mean_occupancy == pytest.approx(0.25)


def test_conflicting_rules_fail(spark):
    rows = spark.createDataFrame([("a", "b")], "p string, q string")
    rules = spark.createDataFrame([("a", None, "x"), (None, "b", "y")], "p string, q string, name string")
    with pytest.raises(Exception, match="several mapping rules"):
        occupancy.canonical_names(rows, rules, ["p", "q"], "name").collect()


@pytest.mark.parametrize("box", [None, (3.0, 4.0, 5.0)])
def test_neighbor_pairs_against_all_pairs(spark, box):
    import random

    draw = random.Random(5)
    points = [(k, *(draw.uniform(0, b) for b in (3, 4, 5))) for k in range(150)]
    df = spark.createDataFrame(points, "id long, x double, y double, z double")

    def apart(p, q):
        d = [a - b for a, b in zip(p[1:], q[1:], strict=True)]
        return math.sqrt(sum((v - b * math.floor(v / b + 0.5)) ** 2 if box else v * v for v, b in zip(d, (3, 4, 5), strict=True)))

    want = {(p[0], q[0]) for p in points for q in points if apart(p, q) <= 0.9}
    rows = joins.neighbor_pairs(df, df, 0.9, box=box).collect()
    assert len(rows) == len(want) and {(r.left_id, r.right_id) for r in rows} == want


def test_network(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", -0.8), ("a", "c", 0.7), ("c", "d", 0.1), ("d", "e", None)], "i string, j string, r double")
    edges = graphs.threshold_edges(pairs, "r", 0.5)
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    got = {r.node: r for r in graphs.node_table(nodes, edges).collect()}
    assert got["a"].clustering == 1.0 and got["d"].degree == 0
    assert {r.node: r.component for r in graphs.components(nodes, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}


def test_long_chain_component(spark):
    n = 300
    edges = spark.range(n - 1).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    assert graphs.components(spark.range(n).withColumnRenamed("id", "node"), edges).agg(F.max("component")).first()[0] == 0


def test_scalars(spark):
    one = spark.range(1)
    p = [[F.lit(float(v)) for v in q] for q in ((1, 0, 0), (0, 0, 0), (0, 1, 0), (0, 1, 1))]
    row = one.select(scalars.angle_degrees(*p[:3]).alias("angle"), scalars.dihedral_degrees(*p).alias("turn"), scalars.wrap_half(F.lit(100.0)).alias("w"), scalars.hybrid36(F.lit("A0000"), 5).alias("h"), scalars.jaccard_distance(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b"))).alias("j"), scalars.angle_degrees(p[0], p[0], p[1]).alias("none")).first()
    assert row.angle == pytest.approx(90) and abs(row.turn) == pytest.approx(90) and row.w == -80.0 and row.h == 100000 and row.j == 0.5 and row.none is None


def test_contracts(spark):
    df = series(spark, {"a": [1.0, 3.0, 2.0]}, "t")
    assert [r.code for r in order_issues(df, "t").collect()] == ["axis_not_increasing"]
    with pytest.raises(Exception, match="no value"):
        require(df, F.col("t") < 3, "no value").collect()


def test_full_cells_are_shared_out(spark):
    """One full cell is dealt to blocks, and its pairs are made by several tasks though its bytes are few; no pair is lost or told twice."""
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 1, (400, 3))
    df = spark.createDataFrame([(0, k, *map(float, x)) for k, x in enumerate(p)], "frame long, id long, x double, y double, z double")
    near = joins.neighbor_pairs(df, df, 1.0, "frame", block=20)
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert sorted((r.left_id, r.right_id) for r in near.collect()) == [tuple(map(int, x)) for x in np.argwhere(d <= 1.0)]
    made = [r["count"] for r in near.groupBy(F.spark_partition_id()).count().collect()]
    assert len(made) == 4 and max(made) < 0.6 * sum(made)


def test_native_fractions(spark):
    """Against all pairs: contacts are those of the reference frame; a frame without them and an id that it lacks count."""
    rng = np.random.default_rng(6)
    p = rng.normal(0, 1, (3, 40, 3))
    p[2] *= 50
    rows = [(f, k, *map(float, x)) for f in range(3) for k, x in enumerate(p[f]) if (f, k) != (1, 7)]
    got = joins.native_fractions(spark.createDataFrame(rows, "frame long, id long, x double, y double, z double"), 0.8, 0).collect()
    near = np.triu(np.sqrt(((p[:, :, None] - p[:, None]) ** 2).sum(3)) <= 0.8, 1)
    near[1, 7], near[1, :, 7] = False, False
    assert {r.frame: (r.contacts, round(r.native_fraction, 9)) for r in got} == {f: (near[0].sum(), round((near[f] & near[0]).sum() / near[0].sum(), 9)) for f in range(3)}


def test_a_large_family_is_ranked_by_several_tasks(spark):
    """Against the plain rule, with ties, a family without a name and rows without p; one family is spread over the tasks."""
    rng = np.random.default_rng(8)
    rows = [("a", k, None if k == 5 else float(x)) for k, x in enumerate(np.round(rng.beta(0.5, 1.5, 2000), 2))] + [(None, k, float(x)) for k, x in enumerate(rng.uniform(0, 0.02, 9))]
    got = runs.benjamini_hochberg(spark.createDataFrame(rows, "family string, key long, p double"), "family", "p", "key")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = got.where("family = 'a'").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1
    want = {}
    for name in ("a", None):
        mine = sorted((p, k) for f, k, p in rows if f == name and p is not None)
        least = 1.0
        for rank in range(len(mine), 0, -1):
            least = min(least, mine[rank - 1][0] * len(mine) / rank)
            want[name, mine[rank - 1][1]] = (rank, round(least, 12))
    assert {(r.family, r.key): (r["rank"], round(r.q, 12)) for r in got.collect()} == want


def test_presence_is_dealt_by_the_number_of_orders(spark, monkeypatch):
    """More orders give more tasks, not larger ones, and few bytes aren't drawn into few tasks."""
    from seriata.plans import bindings

    sf = "/root/testdata/sf0.001"
    assert bindings.presence(spark, sf).rdd.getNumPartitions() == 4
    monkeypatch.setattr(bindings, "FRAMES_PER_TASK", 100)
    assert bindings.presence(spark, sf).rdd.getNumPartitions() == -(-spark.read.parquet(f"{sf}/orders.parquet").count() // 100)
