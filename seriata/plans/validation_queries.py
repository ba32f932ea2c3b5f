"""Queries that check: convergence, Markov models, nearest images, bonds and bridges, budgets, files written and read back."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars
from ..operators import bonding, clustering, convergence, distributions, information, joins, linear, markov, reports, sampling, summaries
from ..operators.runs import time_folds
from ..sources import coordinates, dcd, exports
from .bindings import DIMS, SERIES, VECTORS, series, table, vectors
from .registry import query

_SEG = "(PARTITION BY system_id, replica_id, segment_id ORDER BY ord)"

# --- convergence ------------------------------------------------------------------------------------------------


def _ess(value: str) -> str:
    """Effective sample sizes over all lags, as CTEs named after the value."""
    return f"""m_{value} AS (SELECT system_id, replica_id, count(*) AS n, avg({value}) AS m, var_pop({value}) AS v, stddev_samp({value}) AS sd FROM series GROUP BY ALL),
    d_{value} AS (SELECT s.system_id, s.replica_id, s.ord, s.{value} - m.m AS d FROM series s JOIN m_{value} m USING (system_id, replica_id)),
    r_{value} AS (SELECT a.system_id, a.replica_id, b.ord - a.ord AS lag, avg(a.d * b.d) AS c FROM d_{value} a JOIN d_{value} b ON a.system_id = b.system_id AND a.replica_id = b.replica_id AND b.ord > a.ord GROUP BY ALL),
    o_{value} AS (SELECT r.system_id, r.replica_id, lag, c / nullif(v, 0) AS rho, min(CASE WHEN c / nullif(v, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.system_id, r.replica_id ORDER BY lag) AS open FROM r_{value} r JOIN m_{value} m ON m.system_id = r.system_id AND m.replica_id = r.replica_id),
    e_{value} AS (SELECT system_id, replica_id, CASE WHEN count(rho) > 0 THEN greatest(1.0e0, 1 + 2 * sum(CASE WHEN open = 1 THEN rho ELSE 0 END)) END AS tau FROM o_{value} GROUP BY ALL),
    s_{value} AS (SELECT m.system_id, m.replica_id, n, m, v, sd, least(n, n / tau) AS ess FROM m_{value} m JOIN e_{value} e ON e.system_id = m.system_id AND e.replica_id = m.replica_id)"""


@query(
    f"""WITH {SERIES}, {_ess("value")} SELECT system_id, replica_id, n, m AS mean, sd AS sample_sd, ess, CASE WHEN ess > 1 THEN sd / sqrt(ess) END AS standard_error,
    m - 1.96e0 * CASE WHEN ess > 1 THEN sd / sqrt(ess) END AS lower, m + 1.96e0 * CASE WHEN ess > 1 THEN sd / sqrt(ess) END AS upper FROM s_value WHERE n >= 2""",
    "mean sample_sd ess standard_error lower upper",
)
def convergence_intervals(spark, sf_dir):
    return convergence.mean_intervals(series(spark, sf_dir), "value")


def _relation(x: str, reference: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unavailable' WHEN {x} > {reference} THEN 'above' WHEN {x} < {reference} THEN 'below' ELSE 'at' END"


def _diagnosed(value: str) -> str:
    return f"""SELECT '{value}' AS metric, s.system_id, ess, {_relation("ess", "10.0e0")} AS ess_relation, {_relation("abs(gap / nullif(sqrt(v), 0))", "0.5e0")} AS split_relation FROM s_{value} s JOIN (
      SELECT system_id, replica_id, avg({value}) FILTER (k <= c // 2) - avg({value}) FILTER (k > c // 2) AS gap FROM (
        SELECT *, row_number() OVER (PARTITION BY system_id, replica_id ORDER BY ord) AS k, count(*) OVER (PARTITION BY system_id, replica_id) AS c FROM series) GROUP BY ALL) h ON h.system_id = s.system_id AND h.replica_id = s.replica_id"""


@query(
    f"""WITH {SERIES}, {_ess("value")}, {_ess("second")}, t AS ({_diagnosed("value")} UNION ALL {_diagnosed("second")})
    SELECT metric, system_id, count(*) AS series, count(ess) AS ess_available, {", ".join(f"count(*) FILTER (ess_relation = '{k}') AS ess_{k}" for k in ("above", "at", "below", "unavailable"))},
    {", ".join(f"count(*) FILTER (split_relation = '{k}') AS split_{k}" for k in ("above", "at", "below"))}, min(ess) AS ess_least, quantile_cont(ess, 0.5) AS ess_median, max(ess) AS ess_most FROM t GROUP BY GROUPING SETS ((), (metric), (system_id))""",
    "ess_least ess_median ess_most",
)
def convergence_summary(spark, sf_dir):
    return convergence.diagnostic_summary(convergence.diagnostics(series(spark, sf_dir), ["value", "second"], 10.0, 0.5))


# --- Markov models ----------------------------------------------------------------------------------------------


def _counts_sql(lag: int) -> str:
    return f"c{lag} AS (SELECT a, b, count(*) AS n FROM (SELECT state AS a, lead(state, {lag}) OVER {_SEG} AS b FROM series) WHERE b IS NOT NULL GROUP BY ALL)"


def _reversible_sql(lag: int) -> str:
    return f"""{_counts_sql(lag)}, b{lag} AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM c{lag} UNION ALL SELECT b, a, n FROM c{lag}) GROUP BY ALL),
    t{lag} AS (SELECT a, b, n / CAST(sum(n) OVER (PARTITION BY a) AS DOUBLE) AS p FROM b{lag})"""


@query(f"WITH {SERIES}, {_reversible_sql(1)} SELECT a AS state, sum(n) / CAST((SELECT sum(n) FROM b1) AS DOUBLE) AS stationary FROM b1 GROUP BY a", "stationary")
def markov_stationary(spark, sf_dir):
    states, counts = markov.count_matrix(series(spark, sf_dir))
    return spark.createDataFrame([(s, float(p)) for s, p in zip(states, markov.reversible(counts)[1], strict=True)], "state string, stationary double")


@query(
    f"""WITH {SERIES}, {_reversible_sql(1)}, {_reversible_sql(2)}, {_reversible_sql(3)}, x AS (SELECT DISTINCT a FROM b1), g AS (SELECT x.a, y.a AS b FROM x CROSS JOIN x y), p1 AS (SELECT g.a, g.b, coalesce(p, 0) AS p FROM g LEFT JOIN t1 ON t1.a = g.a AND t1.b = g.b),
    p2 AS (SELECT u.a, v.b, sum(u.p * v.p) AS p FROM p1 u JOIN p1 v ON u.b = v.a GROUP BY ALL), p3 AS (SELECT u.a, v.b, sum(u.p * v.p) AS p FROM p2 u JOIN p1 v ON u.b = v.a GROUP BY ALL)
    """
    + " UNION ALL ".join(f"SELECT {k} AS power, sqrt(avg(pow(p{k}.p - coalesce(t{k}.p, 0), 2))) AS matrix_rmse FROM p{k} LEFT JOIN t{k} ON t{k}.a = p{k}.a AND t{k}.b = p{k}.b" for k in (2, 3)),
    "matrix_rmse",
)
def chapman_kolmogorov(spark, sf_dir):
    """The lag-1 model's powers against the models counted at those lags."""
    rows = series(spark, sf_dir)
    states, counts = markov.count_matrix(rows)
    base, out = markov.reversible(counts)[0], []
    for power in (2, 3):
        names, direct = markov.count_matrix(rows, lag=power)
        at = [states.index(n) for n in names]
        whole = np.zeros_like(counts)
        whole[np.ix_(at, at)] = markov.reversible(direct)[0]
        out.append((power, markov.chapman_kolmogorov(base, whole, power)))
    return spark.createDataFrame(out, "power int, matrix_rmse double")


@query(None, "relative_range")
def timescale_stability(spark, sf_dir):
    rows, scales = series(spark, sf_dir), {}
    for lag in (1, 2, 3):
        transition, pi = markov.reversible(markov.count_matrix(rows, lag=lag)[1])
        scales[lag] = markov.implied_timescales(transition, pi, lag)
    told = markov.timescale_stability(scales)["modes"]
    return spark.createDataFrame([(m["mode"], m["lags"], m["relative_range"], m["passes"]) for m in told], "mode int, lags int, relative_range double, passes boolean")


def _fold_counts(spark, sf_dir) -> np.ndarray:
    rows = time_folds(series(spark, sf_dir), ["state"], 1, 3).groupBy("fold", "state", "next_state").agg(F.count("*").alias("n")).limit(markov.MAX_STATES**2).collect()
    names = sorted({x for r in rows for x in (r.state, r.next_state)})
    counts = np.zeros((3, len(names), len(names)))
    for r in rows:
        counts[r.fold, names.index(r.state), names.index(r.next_state)] += r.n
    return counts


@query(None, "training_vamp2 heldout_vamp_e")
def vamp_cross_validation(spark, sf_dir):
    counts = _fold_counts(spark, sf_dir)
    scores = [(k, int((counts.sum(0) - counts[k]).sum()), int(counts[k].sum()), *markov.vamp_fold(counts.sum(0) - counts[k], counts[k])) for k in range(3) if counts[k].sum()]
    return spark.createDataFrame(scores, "fold int, training_pairs long, testing_pairs long, training_vamp2 double, heldout_vamp_e double")


_REPORTS = "r AS (SELECT n_name AS candidate_id, n_regionkey % 2 = 0 AS passed, CASE WHEN n_nationkey % 5 > 0 THEN (n_nationkey % 4) / 4.0e0 END AS vamp_e, (n_nationkey % 3) / 8.0e0 AS ck_rmse, CASE WHEN n_nationkey % 7 > 0 THEN (n_nationkey % 2) / 2.0e0 END AS its_range, NULL::DOUBLE AS geometric, n_nationkey % 6 + 2 AS states FROM nation)"


@query(f"WITH {_REPORTS} SELECT *, row_number() OVER (ORDER BY passed DESC, vamp_e DESC NULLS LAST, ck_rmse NULLS LAST, its_range NULLS LAST, geometric DESC NULLS LAST, states, candidate_id DESC) AS rank FROM r", "vamp_e ck_rmse its_range")
def state_model_ranking(spark, sf_dir):
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        F.col("n_name").alias("candidate_id"), (F.col("n_regionkey") % 2 == 0).alias("passed"), F.when(k % 5 > 0, (k % 4) / 4.0).alias("vamp_e"), ((k % 3) / 8.0).alias("ck_rmse"), F.when(k % 7 > 0, (k % 2) / 2.0).alias("its_range"),
        F.lit(None).cast("double").alias("geometric"), (k % 6 + 2).alias("states"),
    )
    return markov.rank_state_models(rows)


# --- information ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {SERIES}, c AS (SELECT *, CAST(ord % 3 AS DOUBLE) AS coarse FROM series), e AS (SELECT list_distinct([quantile_cont(value, 0.25e0), quantile_cont(value, 0.5e0), quantile_cont(value, 0.75e0)]) AS e FROM c),
    b AS (SELECT *, CAST(len(list_filter(e, lambda x: x <= value)) AS BIGINT) AS y, CASE WHEN coarse >= 0.5 THEN 1 ELSE 0 END + CASE WHEN coarse >= 1.5 THEN 1 ELSE 0 END AS x FROM c CROSS JOIN e),
    p AS (SELECT x, y, lead(y) OVER {_SEG} AS z FROM b), q AS (SELECT CAST(count(*) OVER (PARTITION BY x, y, z) AS DOUBLE) AS nxyz, CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS ny, CAST(count(*) OVER (PARTITION BY x, y) AS DOUBLE) AS nxy, CAST(count(*) OVER (PARTITION BY y, z) AS DOUBLE) AS nyz FROM p WHERE z IS NOT NULL)
    SELECT 'b_coarse' AS source, 'b_value' AS target, count(*) AS pairs, greatest(0.0e0, sum(ln(nxyz * ny / (nxy * nyz))) / count(*)) AS transfer_entropy FROM q""",
    "transfer_entropy",
)
def midpoint_transfer_entropy(spark, sf_dir):
    """A coarse series is cut at midpoints between its few values, a fine one at quantiles."""
    rows = information.midpoint_bins(series(spark, sf_dir).withColumn("coarse", (F.col("ord") % 3).cast("double")), ["coarse", "value"], 4)
    return information.transfer_entropy(rows, "b_coarse", "b_value")


@query(
    f"WITH {VECTORS}, l AS (SELECT unnest(range(1, 25)) AS i), a AS (SELECT vec_id, i, v[i] AS x FROM vectors CROSS JOIN l) SELECT 'c' || lpad(CAST(p.i AS VARCHAR), 2, '0') AS i, 'c' || lpad(CAST(q.i AS VARCHAR), 2, '0') AS j, covar_pop(p.x, q.x) AS covariance, corr(p.x, q.x) AS correlation FROM a p JOIN a q ON p.vec_id = q.vec_id AND p.i <= q.i GROUP BY p.i, q.i",
    "covariance correlation",
)
def blocked_covariance(spark, sf_dir):
    names = [f"c{k:02d}" for k in range(1, 25)]
    return linear.wide_covariance(vectors(spark, sf_dir).select(*[F.col("v")[k].alias(n) for k, n in enumerate(names)]), names)


# --- selection and reports --------------------------------------------------------------------------------------


@query(
    f"""WITH {SERIES}, g AS (SELECT system_id, state, count(*) AS n FROM series GROUP BY ALL), b AS (SELECT least(min(n), 600 // count(*)) AS m FROM g),
    k AS (SELECT s.*, row_number() OVER (PARTITION BY s.system_id, s.state ORDER BY s.ord, s.event_id) - 1 AS k, count(*) OVER (PARTITION BY s.system_id, s.state) AS n FROM (SELECT * REPLACE (ord * 1000003 + event_id AS ord) FROM series) s)
    SELECT system_id, state, event_id FROM k CROSS JOIN b JOIN generate_series(0, 600) g(i) ON i < m AND i * n // m = k"""
)
def balanced_selection(spark, sf_dir):
    rows = series(spark, sf_dir).withColumn("ord", F.col("ord") * 1000003 + F.col("event_id"))
    return sampling.balanced_budget(rows, ["system_id", "state"], 600).select("system_id", "state", "event_id")


@query(
    """SELECT event_id, CASE WHEN json_type(props, '$') = 'OBJECT' THEN json_extract_string(props, '$.' || (json_keys(props))[1]) END AS first_value, json_extract_string('{"a/b": [10, {"m~n": "x"}]}', '$."a/b"[1]."m~n"') AS fixed FROM events"""
)
def json_pointers(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    names = sorted({n for r in rows.select(F.json_object_keys("props").alias("k")).distinct().limit(1000).collect() for n in (r.k or [])})
    first = F.get(F.json_object_keys("props"), F.lit(0))
    value = F.coalesce(*[F.when(first == n, scalars.json_pointer(F.col("props"), "/" + n.replace("~", "~0").replace("/", "~1"))) for n in names], F.lit(None).cast("string"))
    return rows.select("event_id", value.alias("first_value"), scalars.json_pointer(F.lit('{"a/b": [10, {"m~n": "x"}]}'), "/a~1b/1/m~0n").alias("fixed"))


@query(f"WITH {VECTORS} SELECT vec_id, sha256('{{\"frame\":' || vec_id || ',\"label\":' || label || ',\"system\":\"' || system_id || '\"}}') AS identity_hash FROM vectors")
def identity_signatures(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", sampling.identity_hash({"system": "system_id", "frame": "vec_id", "label": "label"}).alias("identity_hash"))


# --- geometry ---------------------------------------------------------------------------------------------------

_CELL = (1.0, 1.2, 0.9, 70.0, 80.0, 60.0)
_ROWS = scalars.cell_vectors(*_CELL)


def _shift(k: int, steps: tuple[str, str, str]) -> str:
    return " + ".join(f"{s} * {_ROWS[i][k]!r}e0" for i, s in enumerate(steps))


@query(
    f"""WITH {VECTORS}, s AS (SELECT a.i, b.j, c.k FROM generate_series(-6, 6) a(i) CROSS JOIN generate_series(-6, 6) b(j) CROSS JOIN generate_series(-6, 6) c(k)),
    d AS (SELECT vec_id, 9 * d0 AS x, 9 * d1 AS y, 9 * d2 AS z FROM vectors)
    SELECT vec_id, min(sqrt(pow(x + {_shift(0, ("i", "j", "k"))}, 2) + pow(y + {_shift(1, ("i", "j", "k"))}, 2) + pow(z + {_shift(2, ("i", "j", "k"))}, 2))) AS distance FROM d CROSS JOIN s GROUP BY vec_id""",
    "distance",
)
def skewed_nearest_image(spark, sf_dir):
    d = [9 * F.col(c) for c in DIMS[:3]]
    return vectors(spark, sf_dir).select("vec_id", scalars.lattice_image(d, _ROWS).alias("v")).select("vec_id", scalars.norm3([F.col("v")[k] for k in range(3)]).alias("distance"))


@query(
    f"""WITH {VECTORS}, c AS (SELECT vec_id, 2 + d0 AS a, 2 + d1 AS b, 2 + d2 AS c, 90 + 20 * d3 AS al, 90 + 20 * d4 AS be, 90 + 20 * d5 AS ga FROM vectors),
    v AS (SELECT *, a * b * c * sqrt(greatest(0, 1 - pow(cos(radians(al)), 2) - pow(cos(radians(be)), 2) - pow(cos(radians(ga)), 2) + 2 * cos(radians(al)) * cos(radians(be)) * cos(radians(ga)))) AS volume FROM c)
    SELECT vec_id, volume, least(volume / (b * c * sin(radians(al))), volume / (a * c * sin(radians(be))), volume / (a * b * sin(radians(ga)))) / 2 AS safe_radius FROM v""",
    "volume safe_radius",
)
def cell_geometry(spark, sf_dir):
    lengths, angles = [2 + F.col(c) for c in DIMS[:3]], [90 + 20 * F.col(c) for c in DIMS[3:]]
    return vectors(spark, sf_dir).select("vec_id", scalars.cell_volume(lengths, angles).alias("volume"), scalars.safe_radius(lengths, angles).alias("safe_radius"))


def _vec(a: str, b: str) -> list[str]:
    return [f"({a}.{c} - {b}.{c})" for c in "xyz"]


def _dots(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(u, v, strict=True)) + ")"


_ANGLE = f"degrees(acos(greatest(-1, least(1, {_dots(_vec('d', 'h'), _vec('a', 'h'))} / nullif(sqrt({_dots(_vec('d', 'h'), _vec('d', 'h'))}) * sqrt({_dots(_vec('a', 'h'), _vec('a', 'h'))}), 0)))))"


@query(
    f"""WITH {VECTORS}, p AS (SELECT label AS frame, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS id, d0 AS x, d1 AS y, d2 AS z FROM vectors)
    SELECT d.frame, d.id AS donor, h.id AS hydrogen, a.id AS acceptor, sqrt({_dots(_vec("d", "a"), _vec("d", "a"))}) AS distance, {_ANGLE} AS angle
    FROM p d JOIN p h ON h.frame = d.frame AND h.id = d.id + 1 JOIN p a ON a.frame = d.frame WHERE d.id % 3 = 1 AND a.id % 3 = 0 AND d.id // 9 <> a.id // 9 AND sqrt({_dots(_vec("d", "a"), _vec("d", "a"))}) <= 0.2 AND {_ANGLE} >= 60""",
    "distance angle",
)
def donor_acceptor_bonds(spark, sf_dir):
    """Atoms are numbered inside a frame: of three, the first donates through the second, the third accepts; nine make a residue."""
    by = W.partitionBy("label").orderBy("vec_id")
    points = vectors(spark, sf_dir).select(F.col("label").alias("frame"), F.row_number().over(by).cast("bigint").alias("id"), *[F.col(c).alias(n) for c, n in zip(DIMS[:3], "xyz", strict=True)])
    atoms = points.select("id").distinct().select("id", F.floor(F.col("id") / 9).alias("residue"), F.lit("protein").alias("entity"))
    donors = atoms.where("id % 3 = 1").select(F.col("id").alias("donor"), (F.col("id") + 1).alias("hydrogen"), "residue", "entity")
    acceptors = atoms.where("id % 3 = 0").select(F.col("id").alias("acceptor"), "residue", "entity")
    return bonding.bonds_in_frames(donors, acceptors, points, 0.2, 60.0)


@query(
    """WITH e AS (SELECT l_orderkey AS frame, l_suppkey AS water, p_partkey AS endpoint, p_brand AS residue, CASE WHEN l_returnflag = 'N' THEN 'donor' ELSE 'acceptor' END AS role, l_quantity AS distance, l_tax AS angle, l_linenumber AS hydrogen FROM lineitem JOIN part ON p_partkey = l_partkey),
    b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY frame, water, endpoint, role ORDER BY distance, angle DESC, hydrogen) = 1)
    SELECT x.frame, x.endpoint AS a, y.endpoint AS b, least(x.role, y.role) || '-' || greatest(x.role, y.role) AS relation, count(DISTINCT x.water) AS waters FROM b x JOIN b y ON x.frame = y.frame AND x.water = y.water AND x.endpoint < y.endpoint AND x.residue <> y.residue GROUP BY ALL"""
)
def water_bridges(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    role = F.when(F.col("l_returnflag") == "N", "donor").otherwise("acceptor")
    return bonding.water_bridges(e.select(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("water"), F.col("p_partkey").alias("endpoint"), F.col("p_brand").alias("residue"), role.alias("role"), F.col("l_quantity").alias("distance"), F.col("l_tax").alias("angle"), F.col("l_linenumber").alias("hydrogen")))


@query(
    f"""WITH {SERIES}, f AS (SELECT system_id, replica_id, segment_id, ord AS frame, 1 AS id, value / 10 AS x, second / 10000 AS y, CAST(ord % 7 AS DOUBLE) AS z FROM series),
    m AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM f WINDOW w AS (PARTITION BY system_id, replica_id, segment_id ORDER BY frame))
    SELECT system_id, replica_id, segment_id, 'error' AS severity, 'displacement' AS code, frame, '1' AS location FROM m WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) > 4"""
)
def displacement_gates(spark, sf_dir):
    keys = ("system_id", "replica_id", "segment_id")
    points = series(spark, sf_dir).select(*keys, F.col("ord").alias("frame"), F.lit(1).alias("id"), (F.col("value") / 10).alias("x"), (F.col("second") / 10000).alias("y"), (F.col("ord") % 7).cast("double").alias("z"))
    return bonding.structural_issues(points, 1e9, 4.0, 1e-6, keys)


@query(
    f"""WITH RECURSIVE {VECTORS}, s AS (SELECT min(d0) AS x0, max(d0) AS x1, min(d1) AS y0, max(d1) AS y1, CAST(least(60, greatest(4, ceil(2 * pow(count(*), 1.0e0 / 3)))) AS BIGINT) AS b FROM vectors),
    placed AS (SELECT vec_id, d0, d1, least(b - 1, greatest(0, CAST(floor((d0 - x0) / ((x1 - x0) / b)) AS BIGINT))) AS x_bin, least(b - 1, greatest(0, CAST(floor((d1 - y0) / ((y1 - y0) / b)) AS BIGINT))) AS y_bin FROM vectors CROSS JOIN s),
    cells AS (SELECT x_bin, y_bin, count(*) AS n FROM placed GROUP BY ALL),
    nxt AS (SELECT a.x_bin, a.y_bin, a.n, first(b.x_bin ORDER BY b.n DESC, b.x_bin, b.y_bin) AS sx, first(b.y_bin ORDER BY b.n DESC, b.x_bin, b.y_bin) AS sy FROM cells a JOIN cells b ON abs(a.x_bin - b.x_bin) <= 1 AND abs(a.y_bin - b.y_bin) <= 1 GROUP BY a.x_bin, a.y_bin, a.n),
    walk AS (SELECT x_bin, y_bin, n, sx, sy FROM nxt UNION SELECT w.x_bin, w.y_bin, w.n, t.sx, t.sy FROM walk w JOIN nxt t ON w.sx = t.x_bin AND w.sy = t.y_bin),
    rooted AS (SELECT w.x_bin, w.y_bin, w.n, w.sx AS root_x, w.sy AS root_y FROM walk w JOIN nxt t ON w.sx = t.x_bin AND w.sy = t.y_bin WHERE t.sx = t.x_bin AND t.sy = t.y_bin),
    pop AS (SELECT root_x, root_y, row_number() OVER (ORDER BY sum(n) DESC, root_x, root_y) AS basin_id FROM rooted GROUP BY root_x, root_y),
    q AS (SELECT vec_id, d0, d1, basin_id FROM placed JOIN rooted USING (x_bin, y_bin) JOIN pop USING (root_x, root_y)), f AS (SELECT * FROM q ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id LIMIT 200),
    d AS (SELECT f.vec_id, f.basin_id, o.basin_id AS other, sum(sqrt((f.d0 - o.d0) * (f.d0 - o.d0) + (f.d1 - o.d1) * (f.d1 - o.d1))) AS s, count(*) AS n FROM f CROSS JOIN q o GROUP BY ALL),
    t AS (SELECT vec_id, basin_id, max(n) FILTER (other = basin_id) AS own, max(s / nullif(n - 1, 0)) FILTER (other = basin_id AND n > 1) AS a, min(s / n) FILTER (other <> basin_id) AS b FROM d GROUP BY ALL)
    SELECT count(*) AS focal, avg(CASE WHEN own = 1 THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END) AS silhouette FROM t""",
    "silhouette",
)
def basin_silhouette(spark, sf_dir):
    """Separation of the basins' rows: a second opinion that defines no basin."""
    cells, rows = distributions.landscape(vectors(spark, sf_dir), "d0", "d1")
    placed = rows.join(F.broadcast(distributions.basins(cells).select("x_bin", "y_bin", "basin_id")), ["x_bin", "y_bin"]).withColumn("point", F.array("d0", "d1"))
    return clustering.silhouette(placed, "vec_id", "point", "basin_id", 200).agg(F.count("*").alias("focal"), F.avg("silhouette").alias("silhouette"))


def _placed(spark, sf_dir):
    return vectors(spark, sf_dir).select(F.col("label").alias("frame"), F.concat(F.lit("g"), F.col("vec_id") % 3).alias("grp"), F.col("vec_id").alias("id"), *[F.col(c).alias(n) for c, n in zip(DIMS[:3], "xyz", strict=True)])


_ALL_PAIRS = f"{VECTORS}, p AS (SELECT label AS frame, 'g' || (vec_id % 3) AS grp, vec_id AS id, d0 AS x, d1 AS y, d2 AS z FROM vectors), d AS (SELECT a.frame, a.grp AS left_group, b.grp AS right_group, a.id AS left_id, b.id AS right_id, sqrt({_dots(_vec('a', 'b'), _vec('a', 'b'))}) AS d FROM p a JOIN p b ON a.frame = b.frame AND a.id <> b.id)"


@query(
    f"""WITH {_ALL_PAIRS} SELECT CAST(frame AS BIGINT) AS frame, left_group, right_group, count(*) AS pairs, min(d) AS min_distance, first(left_id ORDER BY d, left_id, right_id) AS left_id, first(right_id ORDER BY d, left_id, right_id) AS right_id, avg(d) AS mean_distance, max(d) AS max_distance
    FROM d WHERE left_group < right_group GROUP BY ALL""",
    "min_distance mean_distance max_distance",
)
def group_pair_distances(spark, sf_dir):
    return joins.group_pair_distances(_placed(spark, sf_dir))


@query(f"WITH {_ALL_PAIRS} SELECT frame, left_id, right_id, d AS distance FROM d WHERE left_group = 'g0' AND right_group = 'g1' QUALIFY row_number() OVER (PARTITION BY frame, left_id ORDER BY d, right_id) = 1", "distance")
def nearest_however_far(spark, sf_dir):
    p = _placed(spark, sf_dir)
    return joins.nearest_anywhere(p.where("grp = 'g0'").drop("grp"), p.where("grp = 'g1'").drop("grp"), 0.05, ["frame"])


_NORM = "sqrt(d0 * d0 + d1 * d1 + d2 * d2)"


@query(
    f"""WITH {VECTORS}, s AS (SELECT unnest([0.1e0, 0.2e0, 0.3e0]) AS shell), g AS (SELECT f.frame, k.species, shell FROM (SELECT DISTINCT label AS frame FROM vectors) f CROSS JOIN (SELECT DISTINCT vec_id % 2 AS species FROM vectors) k CROSS JOIN s),
    c AS (SELECT g.frame, g.species, g.shell, count(v.vec_id) AS n FROM g LEFT JOIN vectors v ON v.label = g.frame AND v.vec_id % 2 = g.species AND {_NORM} <= g.shell GROUP BY ALL)
    SELECT species, shell, count(*) AS frames, avg(n) AS mean, stddev_samp(n) AS sd, min(n) AS least, max(n) AS most FROM c GROUP BY species, shell""",
    "mean sd",
)
def species_shells(spark, sf_dir):
    v = vectors(spark, sf_dir)
    rows = v.select(F.col("label").alias("frame"), (F.col("vec_id") % 2).alias("species"), F.col("vec_id").alias("particle"), scalars.norm3([F.col(c) for c in DIMS[:3]]).alias("distance"))
    return joins.species_shells(rows, rows.select("frame").distinct(), [0.1, 0.2, 0.3])


# --- files written and read back --------------------------------------------------------------------------------


def _folder(spark, name: str) -> str:
    """A fresh folder under the shared one (or, in tests without one, a local one)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/seriata-files"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_POINTS = f"{VECTORS}, n AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, label, [list_slice(v, 3 * i + 1, 3 * i + 3) for i in range(21)] AS p FROM vectors)"


@query(
    f"WITH {_POINTS} SELECT frame, len(p) AS atoms, " + ", ".join(f"list_sum([x[{k}] for x in p]) AS sum_{c}" for k, c in enumerate("xyz", 1)) + " FROM n WHERE frame BETWEEN 3 AND 400",
    "sum_x sum_y sum_z",
)
def trajectory_frames(spark, sf_dir):
    """Every embedding as a frame of 21 points, written as one DCD file, of which a range of frames is read back. A mounted shared folder is needed."""
    where = _folder(spark, "frames").removeprefix("file:").replace("//", "/")
    made = vectors(spark, sf_dir).select("vec_id", F.slice("v", 1, 63).alias("p")).repartition(1).sortWithinPartitions("vec_id").select("p").mapInArrow(_dcd_writer(where), "frames long")
    made.collect()  # one number
    rows = dcd.read_dcd(spark, where, start=3, end=401, range_bytes=1 << 14)
    sums = [_axis(k).alias(f"sum_{c}") for k, c in enumerate("xyz")]
    return rows.select("frame", F.size("points").cast("bigint").alias("atoms"), *sums)


def _axis(k: int):
    return F.aggregate("points", F.lit(0.0), lambda s, p: s + p[k])


def _dcd_writer(where: str):
    def write(batches):
        import os

        import pyarrow as pa

        os.makedirs(where, exist_ok=True)
        frames = (b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 21, 3) for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([coordinates.append_dcd(f"{where}/a.dcd", frames, 21)], pa.int64())], ["frames"])

    return write


@query(
    f"""WITH {VECTORS} SELECT CAST(label AS INT) AS state, count(*) AS frames, CAST(sum(floor(d0 * 1000)) AS BIGINT) AS x, CAST(sum(floor(d1 * 1000)) AS BIGINT) AS y, CAST(sum(floor(d2 * 1000)) AS BIGINT) AS z FROM vectors GROUP BY label"""
)
def state_frames_written(spark, sf_dir):
    """Frames of one point exported by state as XYZ text and read back."""
    where = _folder(spark, "states")
    whole = [F.floor(F.col(c) * 1000).cast("double") for c in DIMS[:3]]
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("frame"), "label", F.array(F.lit("C")).alias("elements"), F.array(F.array(*whole)).alias("points"))
    exports.write_state_frames(rows.select("frame", "elements", "points"), rows.select("frame", F.col("label").alias("state")), where)
    read = coordinates.read_frames(spark, f"{where}/*/*.txt", "xyz").withColumn("state", F.regexp_extract("path", r"state=(\d+)", 1).cast("int"))
    return read.groupBy("state").agg(F.count("*").alias("frames"), *[F.sum(F.col("points")[0][k]).cast("bigint").alias(c) for k, c in enumerate("xyz")])


@query(
    f"""WITH {VECTORS}, r AS (SELECT vec_id AS serial, vec_id % 7 AS k, floor(d0 * 1000) / 10 AS x, floor(d1 * 1000) / 10 AS factor FROM vectors) SELECT serial, CASE WHEN k = 0 THEN 'W' ELSE 'C' END || 'A' AS atom_name, x FROM r""",
    "x",
)
def factor_pdb_written(spark, sf_dir):
    """Atoms with a profile in the B-factor column, written as PDB text and read back by columns."""
    where = _folder(spark, "factors")
    v = vectors(spark, sf_dir)
    name = F.concat(F.when(F.col("vec_id") % 7 == 0, "W").otherwise("C"), F.lit("A"))
    one = [F.floor(F.col(c) * 1000) / 10 for c in DIMS[:3]]
    atoms = v.select(F.col("vec_id").cast("int").alias("serial"), name.alias("atom_name"), F.lit("ALA").alias("residue_name"), F.lit("A").alias("chain_id"), (F.col("vec_id") % 9999).cast("int").alias("residue_number"), *[o.alias(c) for o, c in zip(one, "xyz", strict=True)], F.lit("C").alias("element"))
    exports.write_factor_pdb(atoms, v.select(F.col("vec_id").cast("int").alias("serial"), (F.floor(F.col("d1") * 1000) / 10).alias("factor")), "serial", "factor", where)
    return coordinates.read_pdb_atoms(spark, where).select("serial", "atom_name", "x")


@query(None, "silhouette stability")
def kmeans_grid(spark, sf_dir):
    """Numbers of clusters by silhouette and by agreement of seeds; the first row is the choice."""
    rows = vectors(spark, sf_dir).select("vec_id", F.array(*DIMS).alias("v"))
    made = clustering.kmeans_grid(rows, "vec_id", "v", (2, 3, 4, 5), (1, 2, 3))
    return spark.createDataFrame([(r["k"], r["seed"], r["silhouette"], r["stability"], r["rank"]) for r in made], "k int, seed int, silhouette double, stability double, rank int")


# --- partial results and findings -------------------------------------------------------------------------------


@query(f"WITH {SERIES} SELECT system_id, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS least, max(value) AS most FROM series GROUP BY system_id", "mean sd")
def merged_partials(spark, sf_dir):
    """Replicas' summaries behind a coverage gate, put together to those of all rows."""
    rows = series(spark, sf_dir)
    partials = rows.groupBy("system_id", "replica_id").agg(*summaries.summary_columns(F.col("value"))[:3], F.min("value").alias("least"), F.max("value").alias("most"))
    expected = rows.select("system_id", "replica_id").distinct()
    return reports.merged_moments(reports.covered_partials(partials, expected, ["system_id", "replica_id"]), ["system_id"])


@query("SELECT item, row_number() OVER (ORDER BY item) - 1 AS index FROM (SELECT DISTINCT p_brand || '/' || p_type || '/' || p_size AS item FROM part)")
def numbered_dictionary(spark, sf_dir):
    return reports.numbered_union(table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_size").cast("string")).alias("item")), "item")


_FINDINGS = "f AS (SELECT l_returnflag || l_linestatus AS module, l_quantity AS score, 'part ' || (l_partkey % 97) AS statement, 'supplier ' || (l_suppkey % 23) AS report, l_orderkey * 8 + l_linenumber AS id FROM lineitem)"


def _findings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("module"), F.col("l_quantity").alias("score"), F.concat(F.lit("part "), F.col("l_partkey") % 97).alias("statement"), F.concat(F.lit("supplier "), F.col("l_suppkey") % 23).alias("report"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
    )


def _unique(spark, sf_dir):
    return reports.unique_findings(_findings(spark, sf_dir), ["module", "statement"], "report", F.struct((-F.col("score")).alias("s"), "id"), most=3)


_UNIQUE = f"{_FINDINGS}, u AS (SELECT module, statement, first(score ORDER BY score DESC, id) AS score, first(id ORDER BY score DESC, id) AS id, count(*) AS reports, array_to_string(list_slice(list_sort(list_distinct(list(report))), 1, 3), ',') AS sources FROM f GROUP BY module, statement)"


@query(f"WITH {_UNIQUE} SELECT * FROM u")
def unique_findings(spark, sf_dir):
    return _unique(spark, sf_dir).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH {_UNIQUE}, r AS (SELECT *, row_number() OVER (ORDER BY reports DESC, score DESC, module, statement) AS rank FROM u) SELECT module, statement, score, reports, rank, rank <= 12 AS headline FROM r WHERE rank <= 50")
def headline_findings(spark, sf_dir):
    order = [F.col("reports").desc(), F.col("score").desc(), F.col("module"), F.col("statement")]
    return reports.headlines(_unique(spark, sf_dir), order).select("module", "statement", "score", "reports", "rank", "headline")


@query("SELECT 'error' AS severity, 'part' AS code, CAST(l_partkey % 50 AS VARCHAR) AS location, 'm' || (l_suppkey % 3) AS message, count(*) AS reported FROM lineitem GROUP BY ALL")
def repeated_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("error").alias("severity"), F.lit("part").alias("code"), (F.col("l_partkey") % 50).cast("string").alias("location"), F.concat(F.lit("m"), F.col("l_suppkey") % 3).alias("message"))
    return reports.unique_issues(rows)


@query(
    f"""WITH {VECTORS}, m AS (SELECT label % 2 AS system_id, vec_id // 4 AS frame, vec_id % 4 AS member, [d0, d1] AS s FROM vectors), l AS (SELECT system_id, frame, member, unnest([1, 2]) AS component, unnest(s) AS x FROM m)
    SELECT a.system_id, a.member AS left_member, b.member AS right_member, a.component AS left_component, b.component AS right_component, count(*) AS pairs, CASE WHEN count(*) >= 20 THEN corr(a.x, b.x) END AS correlation
    FROM l a JOIN l b ON a.system_id = b.system_id AND a.frame = b.frame AND a.member < b.member GROUP BY ALL""",
    "correlation",
)
def member_coupling(spark, sf_dir):
    """Four members to a frame; a pair counts where both are of one system."""
    rows = vectors(spark, sf_dir).select((F.col("label") % 2).alias("system_id"), F.floor(F.col("vec_id") / 4).alias("frame"), (F.col("vec_id") % 4).alias("member"), "d0", "d1")
    return reports.member_correlations(rows, ["system_id"], "frame", "member", ["d0", "d1"])


@query(
    f"""WITH {VECTORS}, r AS (SELECT vec_id, label, 1 + vec_id % 3 AS w, list_slice(v, 1, 6) AS v FROM vectors), j AS (SELECT unnest(range(1, 7)) AS j), l AS (SELECT vec_id, label, w, j, v[j] AS x FROM r CROSS JOIN j),
    c AS (SELECT label, j, sum(x * w) / sum(w) AS c FROM l GROUP BY ALL), n AS (SELECT l.vec_id, l.label, any_value(w) AS w, sqrt(sum(pow(x - c, 2)) / 2) AS rmsd FROM l JOIN c ON c.label = l.label AND c.j = l.j GROUP BY ALL),
    t AS (SELECT label, sum(rmsd * w) / sum(w) AS m, sqrt(greatest(0, sum(rmsd * rmsd * w) / sum(w) - pow(sum(rmsd * w) / sum(w), 2))) AS s, first(vec_id ORDER BY rmsd, vec_id) AS closest FROM n GROUP BY label),
    p AS (SELECT a.label, a.vec_id AS k, b.vec_id AS o, any_value(b.w) AS w, sqrt(sum(pow(a.x - b.x, 2)) / 2) AS d FROM l a JOIN l b ON a.label = b.label AND a.j = b.j GROUP BY ALL), q AS (SELECT label, k, sum(d * w) / sum(w) AS cost FROM p GROUP BY ALL),
    e AS (SELECT label, first(k ORDER BY cost, k) AS medoid FROM q GROUP BY label)
    SELECT n.label, n.vec_id, rmsd, n.vec_id = closest AS closest, rmsd <= m + s AS central, n.vec_id = medoid AS medoid FROM n JOIN t ON t.label = n.label JOIN e ON e.label = n.label""",
    "rmsd",
)
def central_frames(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("label", "vec_id", F.slice("v", 1, 6).alias("p"), (1 + F.col("vec_id") % 3).alias("w"))
    return reports.representative_frames(rows, "label", "vec_id", "p", "w")
