"""Queries over ordered series: runs, transitions, summaries, selection, convergence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributions, information, integrated, runs, sampling, summaries
from ..operators.model import order_issues
from ..streaming import series as streams
from .bindings import SERIES, VECTORS, series, table, vectors
from .registry import query

_ID = "system_id, replica_id, segment_id"
_SEG = f"(PARTITION BY {_ID} ORDER BY ord)"
_REP = "(PARTITION BY system_id, replica_id ORDER BY ord)"


def _summary(x: str) -> str:
    return f"count({x}) AS n, avg({x}) AS mean, stddev_samp({x}) AS sd, stddev_samp({x}) / sqrt(count({x})) AS sem"


_RUNS = f"""{SERIES}, marked AS (
  SELECT *, CASE WHEN row_number() OVER {_SEG} > 1 AND state IS NOT DISTINCT FROM lag(state) OVER {_SEG} THEN 0 ELSE 1 END AS c FROM series
), numbered AS (SELECT *, CAST(sum(c) OVER {_SEG} AS BIGINT) AS run_id FROM marked
), grouped AS (SELECT {_ID}, run_id, state, count(*) AS length, min(ord) AS first_ord FROM numbered GROUP BY ALL
), runs AS (SELECT *, run_id = 1 AS left_censored, run_id = max(run_id) OVER (PARTITION BY {_ID}) AS right_censored FROM grouped)"""


@query(f"WITH {_RUNS} SELECT *, NOT left_censored AND NOT right_censored AS complete FROM runs")
def residence_runs(spark, sf_dir):
    return runs.residence_runs(series(spark, sf_dir))


@query(
    f"""WITH {_RUNS}, scoped AS (SELECT *, 'all' AS scope FROM runs UNION ALL SELECT *, 'complete' AS scope FROM runs WHERE NOT left_censored AND NOT right_censored)
    SELECT system_id, state, scope, {_summary("length")}, max(length) AS longest FROM scoped GROUP BY system_id, state, scope""",
    "mean sd sem",
)
def residence_summaries(spark, sf_dir):
    return runs.run_summaries(runs.residence_runs(series(spark, sf_dir)))


@query(
    f"""WITH {SERIES}, pairs AS (SELECT state AS from_state, lead(state) OVER {_SEG} AS to_state FROM series)
    SELECT from_state, to_state, count(*) AS transitions, count(*) / CAST(sum(count(*)) OVER (PARTITION BY from_state) AS DOUBLE) AS probability
    FROM pairs WHERE to_state IS NOT NULL GROUP BY from_state, to_state""",
    "probability",
)
def transition_matrix(spark, sf_dir):
    return runs.transition_matrix(series(spark, sf_dir))


@query(
    f"""WITH {SERIES}, low AS (SELECT {_ID}, ord, CASE WHEN value <= 20 THEN 'low' WHEN value IS NOT NULL THEN 'high' END AS state FROM series),
    marked AS (SELECT *, CASE WHEN row_number() OVER {_SEG} > 1 AND state IS NOT DISTINCT FROM lag(state) OVER {_SEG} THEN 0 ELSE 1 END AS c FROM low),
    numbered AS (SELECT *, sum(c) OVER {_SEG} AS run_id FROM marked), r AS (SELECT {_ID}, run_id, state, count(*) AS length FROM numbered GROUP BY ALL),
    e AS (SELECT *, run_id = 1 OR run_id = max(run_id) OVER (PARTITION BY {_ID}) AS cut FROM r),
    scoped AS (SELECT *, 'all' AS scope FROM e UNION ALL SELECT *, 'complete' AS scope FROM e WHERE NOT cut)
    SELECT system_id, state, scope, {_summary("length")}, max(length) AS longest FROM scoped GROUP BY system_id, state, scope""",
    "mean sd sem",
)
def threshold_state_runs(spark, sf_dir):
    return runs.run_summaries(runs.residence_runs(distributions.threshold_states(series(spark, sf_dir), "value", 20.0)))


@query(f"WITH {SERIES} SELECT system_id, state, {_summary('value')} FROM series GROUP BY system_id, state", "mean sd sem")
def sample_summaries(spark, sf_dir):
    return summaries.sample_summary(series(spark, sf_dir), ["system_id", "state"], "value")


_RMSF = f"""{VECTORS}, b AS (SELECT *, vec_id % 3 AS block FROM vectors), p AS (
  SELECT label, replica_id, block, CAST(GROUPING(label, replica_id, block) AS BIGINT) AS level, count(*) AS n, sqrt(var_pop(d0) + var_pop(d1) + var_pop(d2)) AS rmsf
  FROM b GROUP BY GROUPING SETS ((label), (label, replica_id), (label, replica_id, block)))"""


def _rmsf(spark, sf_dir):
    return summaries.rmsf(vectors(spark, sf_dir).withColumn("block", F.col("vec_id") % 3), "label", "replica_id", "block", ("d0", "d1", "d2"))


@query(f"WITH {_RMSF} SELECT * FROM p", "rmsf")
def rmsf_profile(spark, sf_dir):
    return _rmsf(spark, sf_dir)


@query(f"WITH {_RMSF} SELECT a.label, a.rmsf AS pooled_rmsf, s.n, s.mean, s.sd, s.sem FROM p a JOIN (SELECT label, {_summary('rmsf')} FROM p WHERE level = 1 GROUP BY label) s ON a.label = s.label WHERE a.level = 3", "pooled_rmsf mean sd sem")
def rmsf_rollup(spark, sf_dir):
    return summaries.rmsf_rollup(_rmsf(spark, sf_dir), "label")


@query(
    f"""WITH {SERIES}, a AS (SELECT state, radians(second / 240 - 180) AS a FROM series), m AS (SELECT state, count(a) AS n, avg(sin(a)) AS s, avg(cos(a)) AS c FROM a GROUP BY state)
    SELECT state, n, degrees(atan2(s, c)) AS circular_mean, sqrt(s * s + c * c) AS resultant, 1 - sqrt(s * s + c * c) AS circular_variance FROM m""",
    "circular_mean resultant circular_variance",
)
def circular_statistics(spark, sf_dir):
    return summaries.circular_summary(series(spark, sf_dir).withColumn("degrees", F.col("second") / 240 - 180), ["state"], "degrees")


_POP = f"""{SERIES}, s AS (SELECT system_id, replica_id, CASE WHEN value > 5 THEN state END AS st FROM series),
t AS (SELECT system_id, NULL AS replica_id, 'system' AS level, count(*) AS total, count(st) AS assigned FROM s GROUP BY system_id
      UNION ALL SELECT system_id, replica_id, 'replica', count(*), count(st) FROM s GROUP BY system_id, replica_id),
g AS (SELECT * FROM t CROSS JOIN (SELECT DISTINCT st FROM s WHERE st IS NOT NULL)),
c AS (SELECT system_id, replica_id, st, count(*) AS k FROM s WHERE st IS NOT NULL GROUP BY GROUPING SETS ((system_id, st), (system_id, replica_id, st))),
pop AS (SELECT g.system_id, g.replica_id, level, g.st AS state, total, assigned, coalesce(k, 0) AS state_count, coalesce(k, 0) / CAST(total AS DOUBLE) AS fraction_of_all,
  coalesce(k, 0) / nullif(CAST(assigned AS DOUBLE), 0) AS fraction_of_assigned, assigned / CAST(total AS DOUBLE) AS coverage
  FROM g LEFT JOIN c ON g.system_id = c.system_id AND g.replica_id IS NOT DISTINCT FROM c.replica_id AND g.st = c.st)"""


def _populations(spark, sf_dir):
    return summaries.state_populations(series(spark, sf_dir).withColumn("state", F.when(F.col("value") > 5, F.col("state"))), "state")


@query(f"WITH {_POP} SELECT * FROM pop", "fraction_of_all fraction_of_assigned coverage")
def state_populations(spark, sf_dir):
    return _populations(spark, sf_dir)


@query(
    f"""WITH {_POP} SELECT a.state, a.system_id AS left_system, a.fraction_of_all AS left_fraction, b.system_id AS right_system, b.fraction_of_all AS right_fraction, a.fraction_of_all - b.fraction_of_all AS difference
    FROM pop a JOIN pop b ON a.state = b.state AND a.system_id < b.system_id WHERE a.level = 'system' AND b.level = 'system'""",
    "left_fraction right_fraction difference",
)
def population_differences(spark, sf_dir):
    return summaries.population_differences(_populations(spark, sf_dir), "state")


@query(
    f"""WITH {SERIES}, j AS (SELECT state AS a, CASE WHEN value <= 20 THEN 'low' ELSE 'high' END AS b, count(*) AS n FROM series WHERE value IS NOT NULL GROUP BY ALL),
    e AS (SELECT x.a, y.b, x.na * y.nb / CAST(z.t AS DOUBLE) AS expected, coalesce(j.n, 0) AS n FROM (SELECT a, sum(n) AS na FROM j GROUP BY a) x CROSS JOIN (SELECT b, sum(n) AS nb FROM j GROUP BY b) y
      CROSS JOIN (SELECT sum(n) AS t FROM j) z LEFT JOIN j ON j.a = x.a AND j.b = y.b)
    SELECT CAST(sum(n) AS BIGINT) AS n, count(DISTINCT a) AS rows, count(DISTINCT b) AS cols, sum((n - expected) * (n - expected) / expected) AS chi2,
           sqrt(sum((n - expected) * (n - expected) / expected) / nullif(sum(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1), 0)) AS cramers_v FROM e""",
    "chi2 cramers_v",
)
def contingency(spark, sf_dir):
    return summaries.cramers_v(distributions.threshold_states(series(spark, sf_dir).withColumnRenamed("state", "kind"), "value", 20.0), "kind", "state")


# --- selection --------------------------------------------------------------------------------------------------


@query(f"WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY system_id, replica_id) AS n FROM series) SELECT replica_id, ord, event_id FROM n WHERE ord % 7 = 0 AND ord // 7 < n // 7")
def stride_selection(spark, sf_dir):
    return sampling.fixed_stride(series(spark, sf_dir), 7).select("replica_id", "ord", "event_id")


@query(
    f"""WITH {SERIES}, n AS (SELECT replica_id, count(*) AS n FROM series GROUP BY replica_id),
    s AS (SELECT min(k) AS stride FROM generate_series(1, (SELECT max(n) + 1 FROM n)) g(k) WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.n // k > 20))
    SELECT count(*) AS replicas, max(n) AS longest, CAST(max(stride) AS BIGINT) AS stride, CAST(sum(n // stride) AS BIGINT) AS selected FROM n CROSS JOIN s"""
)
def stride_for_budget(spark, sf_dir):
    return sampling.stride_for_budget(series(spark, sf_dir), 20)


@query(
    f"""WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY system_id, replica_id) AS n FROM series),
    w AS (SELECT DISTINCT replica_id, (i * (n - 1)) // (least(10, n) - 1) AS ord FROM n, generate_series(0, 9) g(i) WHERE i < n AND n > 1 UNION SELECT replica_id, 0 FROM n WHERE n = 1)
    SELECT s.replica_id, s.ord, s.event_id FROM series s JOIN w ON s.replica_id = w.replica_id AND s.ord = w.ord"""
)
def uniform_selection(spark, sf_dir):
    return sampling.uniform_budget(series(spark, sf_dir), 10).select("replica_id", "ord", "event_id")


@query("SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS identity_hash FROM events ORDER BY identity_hash, event_id LIMIT 50")
def identity_hash_sample(spark, sf_dir):
    return sampling.identity_hash_sample(table(spark, sf_dir, "events").select("event_id"), "event_id", 50)


@query(
    f"""WITH {SERIES}, p AS (SELECT state, replica_id, ord, row_number() OVER (PARTITION BY state ORDER BY replica_id, ord) - 1 AS position, count(*) OVER (PARTITION BY state) AS n FROM series)
    SELECT state, replica_id, ord, position FROM p WHERE position % 25 = 0 AND position // 25 < n // 25"""
)
def state_export_selection(spark, sf_dir):
    return sampling.stride_by_position(series(spark, sf_dir), ["state"], ["replica_id", "ord"], 25).select("state", "replica_id", "ord", "position")


# --- convergence ------------------------------------------------------------------------------------------------


@query(
    f"""WITH {SERIES}, b AS (SELECT *, (row_number() OVER {_REP} - 1) // 10 AS block FROM series)
    SELECT system_id, replica_id, block, avg(value) AS block_mean FROM b GROUP BY ALL HAVING count(*) = 10""",
    "block_mean",
)
def block_means(spark, sf_dir):
    return runs.block_means(series(spark, sf_dir), "value", 10)


@query(f"WITH {SERIES}, b AS (SELECT *, ntile(4) OVER {_REP} AS block FROM series) SELECT system_id, replica_id, block, count(*) AS n, avg(value) AS block_mean FROM b GROUP BY ALL", "block_mean")
def equal_blocks(spark, sf_dir):
    return runs.equal_blocks(series(spark, sf_dir), "value", 4)


@query(
    f"""WITH {SERIES}, p AS (SELECT *, lead(state) OVER {_SEG} AS next_state FROM series), q AS (SELECT *, row_number() OVER {_SEG} - 1 AS i, count(*) OVER (PARTITION BY {_ID}) AS c FROM p WHERE next_state IS NOT NULL)
    SELECT least(2, (i * 3) // c) AS fold, state, next_state, count(*) AS n FROM q GROUP BY ALL"""
)
def time_folds(spark, sf_dir):
    return runs.time_folds(series(spark, sf_dir), ["state"], 1, 3).groupBy("fold", "state", "next_state").agg(F.count("*").alias("n"))


@query(
    f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER {_REP} AS k, count(*) OVER (PARTITION BY system_id, replica_id) AS c FROM series),
    h AS (SELECT system_id, replica_id, count(*) AS n, avg(value) AS mean, avg(value) FILTER (k <= c // 2) AS first_half, avg(value) FILTER (k > c // 2) AS second_half, coalesce(stddev_pop(value), 0) AS sd FROM k GROUP BY ALL)
    SELECT system_id, replica_id, n, mean, first_half, second_half, first_half - second_half AS difference, (first_half - second_half) / greatest(sd, abs(mean), 1e-12) AS scaled_difference FROM h""",
    "mean first_half second_half difference scaled_difference",
)
def split_half(spark, sf_dir):
    return runs.split_half(series(spark, sf_dir), "value")


_RHO = f"""{SERIES}, m AS (SELECT system_id, replica_id, avg(value) AS m, var_pop(value) AS v FROM series GROUP BY ALL),
d AS (SELECT s.system_id, s.replica_id, s.ord, s.value - m.m AS d, m.v FROM series s JOIN m USING (system_id, replica_id)),
rho AS (SELECT a.system_id, a.replica_id, k AS lag, count(*) AS pairs, CASE WHEN k = 0 THEN 1.0e0 ELSE avg(a.d * b.d) / nullif(max(a.v), 0) END AS rho
  FROM d a CROSS JOIN generate_series(0, 12) g(k) JOIN d b ON a.system_id = b.system_id AND a.replica_id = b.replica_id AND b.ord = a.ord + k GROUP BY a.system_id, a.replica_id, k)"""


@query(f"WITH {_RHO} SELECT * FROM rho", "rho")
def autocorrelation(spark, sf_dir):
    return runs.autocorrelation(series(spark, sf_dir), "value", 12)


@query(
    f"""WITH {_RHO}, w AS (SELECT *, min(CASE WHEN rho > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY system_id, replica_id ORDER BY lag) AS open FROM rho WHERE lag > 0),
    s AS (SELECT system_id, replica_id, sum(CASE WHEN open = 1 THEN rho ELSE 0 END) AS s, CAST(sum(open) AS BIGINT) AS positive_lags, count(rho) AS defined FROM w GROUP BY ALL)
    SELECT s.system_id, s.replica_id, r.pairs AS n, positive_lags, CASE WHEN defined > 0 THEN greatest(1.0e0, 1 + 2 * s) END AS tau, CASE WHEN defined > 0 THEN least(r.pairs, r.pairs / greatest(1.0e0, 1 + 2 * s)) END AS ess
    FROM s JOIN rho r ON r.system_id = s.system_id AND r.replica_id = s.replica_id AND r.lag = 0""",
    "tau ess",
)
def effective_sample_size(spark, sf_dir):
    return runs.whole_effective_sample_size(series(spark, sf_dir), "value", 12)


# --- distributions ----------------------------------------------------------------------------------------------


def _histogram_sql(rule: str) -> str:
    bins = {"explicit": "25", "rice": "ceil(2 * pow(n, 1.0e0 / 3))", "scott": "ceil((hi - lo) / (3.5e0 * sd * pow(n, -1.0e0 / 3)))", "freedman_diaconis": "ceil((hi - lo) / (2 * iqr * pow(n, -1.0e0 / 3)))"}[rule]
    clamp = bins if rule == "explicit" else f"least(200, greatest(5, {bins}))"
    return f"""SELECT '{rule}' AS rule, b + 1 AS bin, lo + b * width AS lower_edge, count(value) AS n, count(value) / CAST(any_value(t.n) AS DOUBLE) AS fraction
    FROM (SELECT *, (hi - lo) / bins AS width FROM (SELECT *, CAST({clamp} AS BIGINT) AS bins FROM s)) t CROSS JOIN generate_series(0, 199) g(b)
    LEFT JOIN events ON least(bins - 1, greatest(0, CAST(floor((value - lo) / width) AS BIGINT))) = b WHERE b < bins GROUP BY b, lo, width"""


_RULES = ("explicit", "rice", "scott", "freedman_diaconis")


@query(
    "WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_pop(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events) " + " UNION ALL ".join(map(_histogram_sql, _RULES)),
    "lower_edge fraction",
)
def scalar_histograms(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("value")
    made = [distributions.histogram(rows, "value", rule, explicit=25) for rule in _RULES]
    return made[0].unionByName(made[1]).unionByName(made[2]).unionByName(made[3])


_CELLS = f"""{VECTORS}, s AS (SELECT min(d0) AS x0, max(d0) AS x1, min(d1) AS y0, max(d1) AS y1, CAST(least(60, greatest(4, ceil(2 * pow(count(*), 1.0e0 / 3)))) AS BIGINT) AS b FROM vectors),
cells AS (SELECT least(b - 1, greatest(0, CAST(floor((d0 - x0) / ((x1 - x0) / b)) AS BIGINT))) AS x_bin, least(b - 1, greatest(0, CAST(floor((d1 - y0) / ((y1 - y0) / b)) AS BIGINT))) AS y_bin, count(*) AS n
  FROM vectors CROSS JOIN s GROUP BY ALL)"""


@query(f"WITH {_CELLS} SELECT x_bin, y_bin, n, n / CAST(sum(n) OVER () AS DOUBLE) AS probability, -0.00198720425864083e0 * 300 * ln(n / CAST(max(n) OVER () AS DOUBLE)) AS free_energy FROM cells", "probability free_energy")
def density_landscape(spark, sf_dir):
    return distributions.landscape(vectors(spark, sf_dir), "d0", "d1")[0]


@query(
    f"""WITH RECURSIVE {_CELLS}, nxt AS (SELECT a.x_bin, a.y_bin, a.n, first(b.x_bin ORDER BY b.n DESC, b.x_bin, b.y_bin) AS sx, first(b.y_bin ORDER BY b.n DESC, b.x_bin, b.y_bin) AS sy
      FROM cells a JOIN cells b ON abs(a.x_bin - b.x_bin) <= 1 AND abs(a.y_bin - b.y_bin) <= 1 GROUP BY a.x_bin, a.y_bin, a.n),
    walk AS (SELECT x_bin, y_bin, n, sx, sy FROM nxt UNION SELECT w.x_bin, w.y_bin, w.n, t.sx, t.sy FROM walk w JOIN nxt t ON w.sx = t.x_bin AND w.sy = t.y_bin),
    rooted AS (SELECT w.x_bin, w.y_bin, w.n, w.sx AS root_x, w.sy AS root_y FROM walk w JOIN nxt t ON w.sx = t.x_bin AND w.sy = t.y_bin WHERE t.sx = t.x_bin AND t.sy = t.y_bin),
    pop AS (SELECT root_x, root_y, CAST(sum(n) AS BIGINT) AS population, row_number() OVER (ORDER BY sum(n) DESC, root_x, root_y) AS basin_id FROM rooted GROUP BY root_x, root_y)
    SELECT x_bin, y_bin, n, root_x, root_y, basin_id, population FROM rooted JOIN pop USING (root_x, root_y)"""
)
def density_basins(spark, sf_dir):
    return distributions.basins(distributions.landscape(vectors(spark, sf_dir), "d0", "d1")[0])


# --- information and lagged dependence --------------------------------------------------------------------------


def _bins_sql(src: str, columns: list[str], bins: int) -> str:
    edges = ", ".join(f"list_distinct([{', '.join(f'quantile_cont({c}, {k}.0e0 / {bins})' for k in range(1, bins))}]) AS e_{c}" for c in columns)
    made = ", ".join(f"CAST(len(list_filter(e_{c}, lambda e: e <= {c})) AS BIGINT) AS b_{c}" for c in columns)
    return f"edges AS (SELECT {edges} FROM {src}), binned AS (SELECT *, {made} FROM {src} CROSS JOIN edges)"


_MI_COLUMNS = ["d0", "d1", "d2", "d3"]
_MI_PAIRS = " UNION ALL ".join(f"SELECT 'b_{a}' AS i, 'b_{b}' AS j, b_{a} AS x, b_{b} AS y FROM binned" for k, a in enumerate(_MI_COLUMNS) for b in _MI_COLUMNS[k:])


@query(
    f"""WITH {VECTORS}, {_bins_sql("vectors", _MI_COLUMNS, 5)}, l AS ({_MI_PAIRS}), c AS (SELECT i, j, x, y, count(*) AS n FROM l GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY i, j, x) AS nx, sum(n) OVER (PARTITION BY i, j, y) AS ny, CAST(sum(n) OVER (PARTITION BY i, j) AS DOUBLE) AS t FROM c),
    r AS (SELECT i, j, greatest(0.0e0, sum(n / t * ln(n * t / (nx * ny)))) AS mi, -sum(n / t * ln(nx / t)) AS hx, -sum(n / t * ln(ny / t)) AS hy FROM m GROUP BY i, j)
    SELECT i, j, mi, CASE WHEN sqrt(greatest(0, hx * hy)) > 1e-12 THEN mi / sqrt(hx * hy) END AS nmi, sqrt(1 - exp(-2 * mi)) AS generalized_correlation FROM r""",
    "mi nmi generalized_correlation",
)
def mutual_information(spark, sf_dir):
    rows = information.quantile_bins(vectors(spark, sf_dir), _MI_COLUMNS, 5)
    return information.mutual_information(rows, [f"b_{c}" for c in _MI_COLUMNS])


def _te_sql(source: str, target: str) -> str:
    return f"""SELECT '{source}' AS source, '{target}' AS target, count(*) AS pairs, greatest(0.0e0, sum(ln(nxyz * ny / (nxy * nyz))) / count(*)) AS transfer_entropy FROM (
      SELECT CAST(count(*) OVER (PARTITION BY x, y, z) AS DOUBLE) AS nxyz, CAST(count(*) OVER (PARTITION BY y) AS DOUBLE) AS ny, CAST(count(*) OVER (PARTITION BY x, y) AS DOUBLE) AS nxy, CAST(count(*) OVER (PARTITION BY y, z) AS DOUBLE) AS nyz
      FROM (SELECT {source} AS x, {target} AS y, lead({target}) OVER {_SEG} AS z FROM binned) WHERE z IS NOT NULL)"""


@query(f"WITH {SERIES}, {_bins_sql('series', ['value', 'second'], 4)} {_te_sql('b_value', 'b_second')} UNION ALL {_te_sql('b_second', 'b_value')}", "transfer_entropy")
def transfer_entropy(spark, sf_dir):
    rows = information.quantile_bins(series(spark, sf_dir), ["value", "second"], 4)
    return information.transfer_entropy(rows, "b_value", "b_second").unionByName(information.transfer_entropy(rows, "b_second", "b_value"))


@query(
    f"WITH {SERIES}, p AS (SELECT value, second, lead(value, 2) OVER {_SEG} AS next_value, lead(second, 2) OVER {_SEG} AS next_second, lead(1, 2) OVER {_SEG} AS has FROM series) "
    + " UNION ALL ".join(f"SELECT '{a}' AS source, '{b}' AS target, count(*) AS pairs, covar_pop({a}, next_{b}) / nullif(stddev_pop({a}) * stddev_pop(next_{b}), 0) AS correlation FROM p WHERE has = 1" for a in ("value", "second") for b in ("value", "second")),
    "correlation",
)
def lagged_correlation(spark, sf_dir):
    return information.lagged_correlation(series(spark, sf_dir), ["value", "second"], 2)


_TRIPLES = [(a, b, c) for i, a in enumerate(_MI_COLUMNS) for j, b in enumerate(_MI_COLUMNS) for k, c in enumerate(_MI_COLUMNS) if i <= j <= k]


@query(
    f"WITH {VECTORS}, m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in _MI_COLUMNS)} FROM vectors), z AS (SELECT {', '.join(f'({c} - m_{c}) / s_{c} AS z_{c}' for c in _MI_COLUMNS)} FROM vectors CROSS JOIN m) "
    + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, '{c}' AS k, avg(z_{a} * z_{b} * z_{c}) AS coskewness FROM z" for a, b, c in _TRIPLES),
    "coskewness",
)
def coskewness(spark, sf_dir):
    return information.coskewness(vectors(spark, sf_dir), _MI_COLUMNS)


_ATOMS = {"p": ("d0", "d1", "d2"), "q": ("d3", "d4", "d5")}
_STEP = {a: [f"({c} - n_{c})" for c in xyz] for a, xyz in _ATOMS.items()}


def _dot(a: str, b: str) -> str:
    return "avg(" + " + ".join(f"{x} * {y}" for x, y in zip(_STEP[a], _STEP[b], strict=True)) + ")"


@query(
    f"WITH {VECTORS}, p AS (SELECT d0, d1, d2, d3, d4, d5, {', '.join(f'lead({c}) OVER {_SEG} AS n_{c}' for xyz in _ATOMS.values() for c in xyz)} FROM vectors) "
    + " UNION ALL ".join(f"SELECT '{a}' AS atom_i, '{b}' AS atom_j, count(*) AS pairs, {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)}) AS propagator FROM p WHERE n_d0 IS NOT NULL" for a in _ATOMS for b in _ATOMS),
    "propagator",
)
def displacement_propagator(spark, sf_dir):
    return information.displacement_propagator(vectors(spark, sf_dir), _ATOMS, 1)


def _cov_pairs(columns: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for k, a in enumerate(columns) for b in columns[k:]]


@query(
    f"WITH {VECTORS} " + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, covar_pop({a}, {b}) AS covariance, covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})) AS correlation FROM vectors" for a, b in _cov_pairs(_MI_COLUMNS)),
    "covariance correlation",
)
def covariance(spark, sf_dir):
    return information.covariance(vectors(spark, sf_dir), _MI_COLUMNS)


def _axis_sum(a: str, b: str) -> str:
    return "(" + " + ".join(f"covar_pop({x}, {y})" for x, y in zip(_ATOMS[a], _ATOMS[b], strict=True)) + ")"


_DCCM = "dccm AS (" + " UNION ALL ".join(f"SELECT system_id, '{a}' AS atom_i, '{b}' AS atom_j, greatest(-1, least(1, {_axis_sum(a, b)} / sqrt({_axis_sum(a, a)} * {_axis_sum(b, b)}))) AS correlation FROM vectors GROUP BY system_id" for a, b in (("p", "p"), ("p", "q"), ("q", "q"))) + ")"


@query(f"WITH {VECTORS}, {_DCCM} SELECT * FROM dccm", "correlation")
def cross_correlation_map(spark, sf_dir):
    return information.cross_correlation_map(vectors(spark, sf_dir), _ATOMS, ["system_id"])


@query(f"WITH {VECTORS}, {_DCCM} SELECT a.atom_i, a.atom_j, a.correlation - b.correlation AS difference FROM dccm a JOIN dccm b USING (atom_i, atom_j) WHERE a.system_id = 's0' AND b.system_id = 's1'", "difference")
def cross_correlation_difference(spark, sf_dir):
    c = information.cross_correlation_map(vectors(spark, sf_dir), _ATOMS, ["system_id"])
    one = [F.max(F.when(F.col("system_id") == s, F.col("correlation"))) for s in ("s0", "s1")]
    return c.groupBy("atom_i", "atom_j").agg((one[0] - one[1]).alias("difference"))


@query(
    f"WITH {VECTORS}, g AS (SELECT label, {', '.join(f'avg({c}) AS m_{c}' for c in _MI_COLUMNS)}, {', '.join(f'covar_pop({a}, {b}) AS c_{a}_{b}' for a, b in _cov_pairs(_MI_COLUMNS))} FROM vectors GROUP BY label) "
    + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, avg(c_{a}_{b}) + covar_pop(m_{a}, m_{b}) AS covariance FROM g" for a, b in _cov_pairs(_MI_COLUMNS)),
    "covariance",
)
def mixture_covariance(spark, sf_dir):
    return information.mixture_covariance(vectors(spark, sf_dir), _MI_COLUMNS, "label")


# --- ranking and comparison -------------------------------------------------------------------------------------

_P = "((l_orderkey * 7919 + l_linenumber * 104729) % 100003) / 100003.0e0"


@query(
    f"""WITH p AS (SELECT l_returnflag AS family, l_orderkey * 10 + l_linenumber AS key, {_P} AS p FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS rank, count(*) OVER (PARTITION BY family) AS n FROM p)
    SELECT family, key, p, rank, least(1.0e0, min(p * n / rank) OVER (PARTITION BY family ORDER BY rank DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r""",
    "p q",
)
def benjamini_hochberg(spark, sf_dir):
    p = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 100003) / F.lit(100003.0)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), p.alias("p"))
    return runs.benjamini_hochberg(rows, "family", "p", "key")


@query("SELECT p_partkey, p_type AS family, p_retailprice - 1000.0e0 AS effect, cume_dist() OVER (PARTITION BY p_type ORDER BY abs(p_retailprice - 1000.0e0)) AS percentile FROM part", "effect percentile")
def effect_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("family"), (F.col("p_retailprice") - 1000.0).alias("effect"))
    return runs.effect_percentile(rows, "family", "effect")


@query(
    f"""WITH {SERIES} SELECT state, count(value) FILTER (system_id = 's0') AS n0, count(value) FILTER (system_id = 's1') AS n1,
    (avg(value) FILTER (system_id = 's0') - avg(value) FILTER (system_id = 's1')) / nullif(sqrt((var_samp(value) FILTER (system_id = 's0') + var_samp(value) FILTER (system_id = 's1')) / 2), 0) AS standardized_difference FROM series GROUP BY state""",
    "standardized_difference",
)
def standardized_differences(spark, sf_dir):
    return runs.standardized_difference(series(spark, sf_dir).withColumn("side", (F.col("system_id") == "s1").cast("int")), ["state"], "side", "value")


@query(f"WITH {SERIES}, r AS (SELECT state, event_id, value, row_number() OVER (PARTITION BY state ORDER BY value DESC, event_id) AS rank FROM series) SELECT * FROM r WHERE rank <= 5")
def top_per_state(spark, sf_dir):
    return runs.top_k(series(spark, sf_dir).select("state", "event_id", "value"), ["state"], [F.col("value").desc(), F.col("event_id")], 5)


_MEASURES = "m AS (SELECT 'value' AS measure, system_id, avg(value) AS value FROM series GROUP BY system_id UNION ALL SELECT 'second', system_id, avg(second) FROM series GROUP BY system_id)"


@query(
    f"""WITH {SERIES}, {_MEASURES}, e AS (SELECT unnest(['value', 'second', 'absent']) AS measure), d AS (SELECT a.measure, a.value - b.value AS difference FROM m a JOIN m b USING (measure) WHERE a.system_id = 's0' AND b.system_id = 's1')
    SELECT measure, 's0' AS left_system, 's1' AS right_system, difference, difference IS NOT NULL AS covered FROM e LEFT JOIN d USING (measure)""",
    "difference",
)
def integrated_comparison(spark, sf_dir):
    told = series(spark, sf_dir).groupBy("system_id").agg(F.avg("value").alias("value"), F.avg("second").alias("second"))
    long = told.select("system_id", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("value", "second")])))
    expected = spark.createDataFrame([(m, "s0", "s1") for m in ("value", "second", "absent")], "measure string, left_system string, right_system string")
    return integrated.integrate(expected, integrated.pairwise_differences(long))


@query(f"WITH {SERIES} SELECT replica_id, count(*) AS frames, " + ", ".join(f"count(*) FILTER (state = '{c}') / CAST(count(*) AS DOUBLE) AS fraction_{c}" for c in ("click", "error", "view")) + " FROM series GROUP BY replica_id", "fraction_click fraction_error fraction_view")
def code_populations(spark, sf_dir):
    return summaries.code_populations(series(spark, sf_dir), ["replica_id"], "state", ["click", "error", "view"])


@query(
    """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS c FROM events),
    s AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o) SELECT user_id, count(*) AS n, avg(value) AS mean FROM s GROUP BY user_id, sid""",
    "mean",
)
def gap_segments(spark, sf_dir):
    return streams.gap_segments(table(spark, sf_dir, "events"), "ts", ["user_id"], "value", "6 hours").select("user_id", "n", "mean")


@query(f"WITH {SERIES}, b AS (SELECT *, ts <= lag(ts) OVER {_SEG} AS back FROM series) SELECT 'error' AS severity, 'axis_not_increasing' AS code, concat_ws('/', system_id, replica_id, segment_id, ord) AS location, 'ts does not increase' AS message FROM b WHERE back")
def order_contract(spark, sf_dir):
    return order_issues(series(spark, sf_dir), "ts")
