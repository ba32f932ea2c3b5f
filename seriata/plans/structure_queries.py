"""Queries over presence, identities, points, partitions, networks and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars
from ..operators import bonding, clustering, graphs, information, joins, learning, linear, markov, occupancy, structures, summaries
from ..operators.runs import presence_islands as islands
from ..operators.runs import time_folds
from .bindings import DIMS, PRESENCE, SERIES, VECTORS, frames, presence, series, table, vectors
from .registry import query

# --- occupancy --------------------------------------------------------------------------------------------------

_OCC = f"""{PRESENCE}, sizes AS (SELECT system_id, replica_id, count(*) AS f FROM frames GROUP BY ALL), sys AS (SELECT system_id, CAST(sum(f) AS BIGINT) AS all_frames, count(*) AS replicas FROM sizes GROUP BY system_id),
hits AS (SELECT system_id, replica_id, item, count(*) AS h FROM presence GROUP BY ALL),
occ AS (SELECT h.system_id, item, CAST(sum(h) AS BIGINT) AS present_frames, all_frames, sum(h) / CAST(all_frames AS DOUBLE) AS pooled_occupancy, sum(h / CAST(f AS DOUBLE)) / replicas AS replica_mean_occupancy
  FROM hits h JOIN sizes USING (system_id, replica_id) JOIN sys ON sys.system_id = h.system_id GROUP BY h.system_id, item, all_frames, replicas)"""


@query(f"WITH {_OCC} SELECT * FROM occ", "pooled_occupancy replica_mean_occupancy")
def occupancy_table(spark, sf_dir):
    return occupancy.occupancy(presence(spark, sf_dir), frames(spark, sf_dir), "item")


_CMP = f"""{_OCC}, elig AS (SELECT DISTINCT s.system_id, p_brand AS item FROM part CROSS JOIN (SELECT DISTINCT system_id FROM frames) s WHERE s.system_id <> 'F' OR length(p_brand) = 8),
cmp AS (SELECT item, CASE WHEN ea IS NULL THEN 'absent' WHEN coalesce(va, 0) > 0 THEN 'observed' ELSE 'never_observed' END AS status_a, CASE WHEN eb IS NULL THEN 'absent' WHEN coalesce(vb, 0) > 0 THEN 'observed' ELSE 'never_observed' END AS status_b,
  CASE WHEN ea IS NOT NULL THEN coalesce(va, 0) END AS occupancy_a, CASE WHEN eb IS NOT NULL THEN coalesce(vb, 0) END AS occupancy_b
  FROM (SELECT DISTINCT item FROM elig) u LEFT JOIN (SELECT item, 1 AS ea FROM elig WHERE system_id = 'F') USING (item) LEFT JOIN (SELECT item, 1 AS eb FROM elig WHERE system_id = 'O') USING (item)
  LEFT JOIN (SELECT item, pooled_occupancy AS va FROM occ WHERE system_id = 'F') USING (item) LEFT JOIN (SELECT item, pooled_occupancy AS vb FROM occ WHERE system_id = 'O') USING (item))"""


def _compared(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("item")).distinct()
    eligible = items.crossJoin(F.broadcast(frames(spark, sf_dir).select("system_id").distinct())).where("system_id <> 'F' or length(item) = 8")
    return occupancy.compare_occupancy(occupancy.occupancy(presence(spark, sf_dir), frames(spark, sf_dir), "item"), eligible, "item", "F", "O")


@query(f"WITH {_CMP} SELECT *, occupancy_a - occupancy_b AS difference FROM cmp", "occupancy_a occupancy_b difference")
def occupancy_comparison(spark, sf_dir):
    return _compared(spark, sf_dir)


@query(f"WITH {_CMP} SELECT item, occupancy_a - occupancy_b AS difference FROM cmp ORDER BY occupancy_a - occupancy_b IS NULL, abs(occupancy_a - occupancy_b) DESC, item LIMIT 10", "difference")
def top_occupancy_differences(spark, sf_dir):
    return occupancy.top_differences(_compared(spark, sf_dir), "item", 10).select("item", "difference")


@query(
    """WITH r AS (SELECT DISTINCT c_nationkey AS k, o_orderpriority || '/' || o_orderstatus || '/' || CAST(o_custkey % 40 AS VARCHAR) AS item FROM orders JOIN customer ON c_custkey = o_custkey), s AS (SELECT k, count(*) AS n FROM r GROUP BY k)
    SELECT a.k AS left, b.k AS right, count(*) AS shared, 1 - count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS distance
    FROM r a JOIN r b ON a.item = b.item AND a.k < b.k JOIN s x ON x.k = a.k JOIN s y ON y.k = b.k GROUP BY a.k, b.k""",
    "distance",
)
def pattern_distances(spark, sf_dir):
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = o.select("c_nationkey", F.concat_ws("/", "o_orderpriority", "o_orderstatus", (F.col("o_custkey") % 40).cast("string")).alias("item"))
    return occupancy.pairwise_jaccard(rows, "c_nationkey", "item")


@query(
    f"""WITH {SERIES}, g AS (SELECT *, row_number() OVER (PARTITION BY system_id, replica_id, segment_id ORDER BY ord) - 1 AS pos, count(*) OVER (PARTITION BY system_id, replica_id, segment_id) - 1 AS last FROM series),
    i AS (SELECT *, pos - row_number() OVER (PARTITION BY system_id, replica_id, segment_id, state ORDER BY pos) AS isl FROM g WHERE value > 10)
    SELECT system_id, replica_id, segment_id, state AS item, min(pos) AS start, count(*) AS length, min(pos) = 0 AS left_censored, max(pos) = last AS right_censored FROM i GROUP BY system_id, replica_id, segment_id, state, isl, last"""
)
def presence_islands(spark, sf_dir):
    s = series(spark, sf_dir)
    return islands(s.where("value > 10").withColumnRenamed("state", "item"), s, "item")


_RULES = [("Brand#1", None, "group one"), (None, "ECONOMY", "economy")]


@query(
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' AND p_type <> 'ECONOMY' THEN 'group one' WHEN p_type = 'ECONOMY' AND p_brand <> 'Brand#1' THEN 'economy' ELSE p_brand END AS name
    FROM part WHERE NOT (p_brand = 'Brand#1' AND p_type = 'ECONOMY')"""
)
def homolog_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("not (p_brand = 'Brand#1' and p_type = 'ECONOMY')").select("p_brand", "p_type", "p_partkey")
    rules = spark.createDataFrame(_RULES, "p_brand string, p_type string, name string")
    return occupancy.canonical_names(rows, rules, ["p_brand", "p_type"], "name").select("p_partkey", "name")


# --- identities -------------------------------------------------------------------------------------------------

_MAP = """a AS (SELECT p_partkey AS k, count(*) AS in_reference FROM part GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS in_target FROM lineitem GROUP BY 1),
both_ AS (SELECT coalesce(a.k, b.k) AS k, coalesce(in_reference, 0) AS in_reference, coalesce(in_target, 0) AS in_target FROM a FULL JOIN b ON a.k = b.k)"""


@query(f"WITH {_MAP} SELECT *, CASE WHEN in_target = 0 THEN 'missing_in_target' WHEN in_reference = 0 THEN 'missing_in_reference' ELSE 'not_unique' END AS reason FROM both_ WHERE NOT (in_reference = 1 AND in_target = 1)")
def excluded_identities(spark, sf_dir):
    return joins.map_identities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k")[1]


@query(f"WITH {_MAP} SELECT k FROM both_ WHERE in_reference = 1 AND in_target = 1")
def mapped_identities(spark, sf_dir):
    return joins.map_identities(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), "k")[0]


@query("SELECT l_partkey AS key, count(DISTINCT l_returnflag) AS targets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def common_basis(spark, sf_dir):
    return joins.common_keys(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_returnflag"), "key", "l_returnflag")


@query(
    """SELECT source, count(*) AS files, CAST(sum(strlen(t)) AS BIGINT) AS bytes, min(h) AS least_sha256, CAST(sum(CAST('0x' || substr(h, 1, 12) AS HUGEINT)) AS VARCHAR) AS checksum
    FROM (SELECT source, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY source"""
)
def content_inventory(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("source", F.octet_length(t).alias("n"), F.sha2(t, 256).alias("h"))
    check = F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy("source").agg(F.count("*").alias("files"), F.sum("n").alias("bytes"), F.min("h").alias("least_sha256"), check.cast("string").alias("checksum"))


@query(
    """SELECT 'lineitem' AS child, 'orders' AS parent, count(*) AS rows, count(*) FILTER (o_orderkey IS NULL) AS orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'orders', 'customer', count(*), count(*) FILTER (c_custkey IS NULL) FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""
)
def preflight_agreement(spark, sf_dir):
    def one(child: str, key: str, parent: str, other: str) -> DataFrame:
        a = table(spark, sf_dir, child).select(key)
        told = a.join(table(spark, sf_dir, parent).select(other), F.col(key) == F.col(other), "left").agg(F.count("*").alias("rows"), F.count_if(F.col(other).isNull()).alias("orphans"))
        return told.select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "rows", "orphans")

    return one("lineitem", "l_orderkey", "orders", "o_orderkey").unionByName(one("orders", "o_custkey", "customer", "c_custkey"))


# --- points -----------------------------------------------------------------------------------------------------


def _points(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select(F.col("label").alias("frame"), F.col("vec_id").alias("id"), F.col("d0").alias("x"), F.col("d1").alias("y"), F.col("d2").alias("z"))


_PAIRS = f"{VECTORS}, pairs AS (SELECT a.label AS frame, a.vec_id AS left_id, b.vec_id AS right_id, sqrt((a.d0 - b.d0) * (a.d0 - b.d0) + (a.d1 - b.d1) * (a.d1 - b.d1) + (a.d2 - b.d2) * (a.d2 - b.d2)) AS distance FROM vectors a JOIN vectors b ON a.label = b.label)"


@query(f"WITH {_PAIRS} SELECT * FROM pairs WHERE distance <= 0.08 AND left_id < right_id", "distance")
def neighbor_pairs(spark, sf_dir):
    p = _points(spark, sf_dir)
    return joins.neighbor_pairs(p, p, 0.08, "frame").where("left_id < right_id")


@query(f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY frame, left_id ORDER BY distance, right_id) AS k FROM pairs WHERE distance <= 0.1 AND left_id <> right_id) SELECT frame, left_id, right_id, distance FROM r WHERE k = 1", "distance")
def nearest_neighbors(spark, sf_dir):
    p = _points(spark, sf_dir)
    return joins.nearest(joins.neighbor_pairs(p, p, 0.1, "frame").where("left_id <> right_id"), ["frame"])


@query(
    f"""WITH {_PAIRS}, g AS (SELECT left_id % 3 AS left_group, right_id % 3 AS right_group, * FROM pairs WHERE distance <= 0.1 AND left_id <> right_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY left_group, right_group ORDER BY distance, left_id, right_id) AS k FROM g)
    SELECT left_group, right_group, count(*) AS pairs, min(distance) AS min_distance, max(left_id) FILTER (k = 1) AS left_id, max(right_id) FILTER (k = 1) AS right_id, avg(distance) AS mean_distance, max(distance) AS max_distance FROM r GROUP BY left_group, right_group""",
    "min_distance mean_distance max_distance",
)
def group_distances(spark, sf_dir):
    p = _points(spark, sf_dir)
    pairs = joins.neighbor_pairs(p, p, 0.1, "frame").where("left_id <> right_id")
    return joins.group_distances(pairs.withColumn("left_group", F.col("left_id") % 3).withColumn("right_group", F.col("right_id") % 3), "left_group", "right_group")


def _image(c: str) -> str:
    return f"((a.{c} - b.{c}) - floor((a.{c} - b.{c}) / 1.0e0 + 0.5) * 1.0e0)"


@query(
    f"""WITH {VECTORS}, w AS (SELECT vec_id, d0 - floor(d0) AS x, d1 - floor(d1) AS y, d2 - floor(d2) AS z FROM vectors),
    p AS (SELECT sqrt({" + ".join(f"{_image(c)} * {_image(c)}" for c in "xyz")}) AS d FROM w a JOIN w b ON a.vec_id < b.vec_id), c AS (SELECT least(9, CAST(floor(d / 0.02e0) AS BIGINT)) AS shell, count(*) AS n FROM p WHERE d <= 0.2 GROUP BY 1)
    SELECT shell, coalesce(n, 0) AS n, coalesce(n, 0) / ((SELECT count(*) * (count(*) - 1) / 2 FROM w) * 4.0e0 / 3 * 3.141592653589793e0 * (pow((shell + 1) * 0.02e0, 3) - pow(shell * 0.02e0, 3))) AS g FROM generate_series(0, 9) t(shell) LEFT JOIN c USING (shell)""",
    "g",
)
def radial_distribution(spark, sf_dir):
    p = _points(spark, sf_dir).select("id", *[(F.col(c) - F.floor(c)).alias(c) for c in "xyz"])
    return joins.shell_histogram(joins.neighbor_pairs(p, p, 0.2, box=(1.0, 1.0, 1.0)), p.count(), 1.0, 0.02, 0.2)


@query(
    f"""WITH {VECTORS}, i AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM vectors),
    p AS (SELECT a.label AS frame, a.k AS l, b.k AS r FROM i a JOIN i b ON a.label = b.label AND a.k < b.k WHERE sqrt((a.d0 - b.d0) * (a.d0 - b.d0) + (a.d1 - b.d1) * (a.d1 - b.d1) + (a.d2 - b.d2) * (a.d2 - b.d2)) <= 0.15),
    n AS (SELECT l, r FROM p WHERE frame = 0) SELECT f.frame, (SELECT count(*) FROM n) AS contacts, count(n.l) / nullif(CAST((SELECT count(*) FROM n) AS DOUBLE), 0) AS native_fraction
    FROM (SELECT DISTINCT label AS frame FROM vectors) f LEFT JOIN p ON p.frame = f.frame LEFT JOIN n ON n.l = p.l AND n.r = p.r GROUP BY f.frame""",
    "native_fraction",
)
def native_contacts(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("id", F.row_number().over(W.partitionBy("frame").orderBy("id")).cast("bigint"))
    return joins.native_fractions(p, 0.15, 0)


@query(
    """WITH e AS (SELECT DISTINCT l_orderkey AS frame, l_suppkey AS hub, p_brand AS endpoint FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT a.endpoint AS a, b.endpoint AS b, count(DISTINCT a.frame) AS frames, count(DISTINCT a.hub) AS hubs FROM e a JOIN e b ON a.frame = b.frame AND a.hub = b.hub AND a.endpoint < b.endpoint GROUP BY ALL"""
)
def bridged_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joins.bridges(e.select(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("hub"), F.col("p_brand").alias("endpoint")), "frame", "endpoint", "hub")


_SHELLS = [0.05, 0.1, 0.2]


@query(
    f"""WITH {VECTORS}, m AS (SELECT label, vec_id % 5 AS particle, min(sqrt(d0 * d0 + d1 * d1 + d2 * d2)) AS d FROM vectors GROUP BY ALL), t AS (SELECT count(DISTINCT label) AS f FROM vectors),
    s AS (SELECT particle, {", ".join(f"count(*) FILTER (d <= {s}) / CAST(any_value(f) AS DOUBLE) AS shell_{k}" for k, s in enumerate(_SHELLS, 1))} FROM m CROSS JOIN t GROUP BY particle)
    SELECT *, CASE WHEN shell_1 >= 0.5 THEN 'persistent' WHEN shell_1 >= 0.05 THEN 'intermittent' ELSE 'transient' END AS persistence FROM s""",
    "shell_1 shell_2 shell_3",
)
def shell_persistence(spark, sf_dir):
    v = vectors(spark, sf_dir)
    d = F.sqrt(scalars.total(F.col(c) * F.col(c) for c in DIMS[:3]))
    near = v.groupBy("label", (F.col("vec_id") % 5).alias("particle")).agg(F.min(d).alias("distance"))
    return joins.shell_persistence(near, v.select("label").distinct().count(), _SHELLS, "particle")


@query(
    f"""WITH {VECTORS} SELECT vec_id, degrees(acos(greatest(-1, least(1, ((d0 - d3) * (d1 - d3) + (d1 - d4) * (d3 - d4) + (d2 - d5) * (d5 - d5)) / nullif(sqrt((d0 - d3) * (d0 - d3) + (d1 - d4) * (d1 - d4) + (d2 - d5) * (d2 - d5)) * sqrt((d1 - d3) * (d1 - d3) + (d3 - d4) * (d3 - d4)), 0))))) AS angle,
    sqrt((d0 - d3) * (d0 - d3) + (d1 - d4) * (d1 - d4) + (d2 - d5) * (d2 - d5)) AS distance,
    sqrt((d0 - d3) * (d0 - d3) + (d1 - d4) * (d1 - d4) + (d2 - d5) * (d2 - d5)) <= 0.3 AND degrees(acos(greatest(-1, least(1, ((d0 - d3) * (d1 - d3) + (d1 - d4) * (d3 - d4) + (d2 - d5) * (d5 - d5)) / nullif(sqrt((d0 - d3) * (d0 - d3) + (d1 - d4) * (d1 - d4) + (d2 - d5) * (d2 - d5)) * sqrt((d1 - d3) * (d1 - d3) + (d3 - d4) * (d3 - d4)), 0))))) >= 90 AS bonded FROM vectors""",
    "angle distance",
)
def bond_geometry(spark, sf_dir):
    a, b, c = ([F.col(x) for x in xs] for xs in (("d0", "d1", "d2"), ("d3", "d4", "d5"), ("d1", "d3", "d5")))
    angle, d = scalars.angle_degrees(a, b, c), scalars.norm3(scalars.minus(a, b))
    return vectors(spark, sf_dir).select("vec_id", angle.alias("angle"), d.alias("distance"), ((d <= 0.3) & (angle >= 90)).alias("bonded"))


@query(
    f"""WITH {VECTORS}, c AS (SELECT label, avg(d0) AS cx, avg(d1) AS cy, avg(d2) AS cz FROM vectors GROUP BY label)
    SELECT label, count(*) AS atoms, sqrt(avg((d0 - cx) * (d0 - cx) + (d1 - cy) * (d1 - cy) + (d2 - cz) * (d2 - cz))) AS rg FROM vectors JOIN c USING (label) GROUP BY label""",
    "rg",
)
def radius_of_gyration(spark, sf_dir):
    r = F.sqrt(scalars.total(F.var_pop(c) for c in DIMS[:3]))
    return vectors(spark, sf_dir).groupBy("label").agg(F.count("*").alias("atoms"), r.alias("rg"))


def _tracks(spark, sf_dir) -> DataFrame:
    """Each embedding as a frame of sixteen points."""
    points = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", i * 3 + 1, F.lit(3)))
    return vectors(spark, sf_dir).select("vec_id", "label", points.alias("points"))


@query(None, "rmsd rg")
def fitted_rmsd(spark, sf_dir):
    first = _tracks(spark, sf_dir).orderBy("vec_id").select("points").first()
    reference = np.array([list(p) for p in first.points])
    return structures.rmsd_rg(_tracks(spark, sf_dir), "points", reference).select("vec_id", "rmsd", "rg")


@query(None, "area plane_rms")
def surface_and_plane(spark, sf_dir):
    def kernel(p: np.ndarray) -> dict:
        return {"area": float(structures.surface_areas(10 * p, np.full(len(p), 1.5), count=200).sum()), "plane_rms": structures.fit_plane(p)[2]}

    return structures.per_frame(_tracks(spark, sf_dir), "points", kernel, "area: double, plane_rms: double", "s").select("vec_id", "s.area", "s.plane_rms")


@query(None, "max_departure angle_rms fit_rmsd")
def ring_and_coordination(spark, sf_dir):
    def kernel(p: np.ndarray) -> dict:
        shape = structures.coordination_shape(p[0], p[1:5])
        return {"max_departure": structures.ring_geometry(p[:5])["max_departure"], **shape}

    made = structures.per_frame(_tracks(spark, sf_dir), "points", kernel, "max_departure: double, shape: string, angle_rms: double, fit_rmsd: double", "s")
    return made.select("vec_id", "s.max_departure", "s.shape", "s.angle_rms", "s.fit_rmsd")


@query(
    f"""WITH {_PAIRS} SELECT 'error' AS severity, 'near_coincident' AS code, frame, CAST(left_id AS VARCHAR) || '-' || CAST(right_id AS VARCHAR) AS location FROM pairs WHERE distance <= 0.02 AND left_id < right_id"""
)
def structural_gates(spark, sf_dir):
    return bonding.structural_issues(_points(spark, sf_dir), 10.0, 0.2, 0.02)


def _site_members(centers: str, out: str) -> str:
    near = " AND ".join(f"abs(floor(p.{c} / 0.1e0) - floor(c.{c} / 0.1e0)) <= 1" for c in "xyz")
    gap = " + ".join(f"(p.{c} - c.{c}) * (p.{c} - c.{c})" for c in "xyz")
    return f"""{out} AS (SELECT * FROM (SELECT p.vec_id, p.state, p.frame, p.x, p.y, p.z, c.site, sqrt({gap}) AS d FROM p JOIN {centers} c ON p.state = c.state AND {near}) WHERE d <= 0.1e0
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, site) = 1)"""


@query(
    f"""WITH {VECTORS}, p AS (SELECT vec_id, label % 2 AS state, label AS frame, d0 AS x, d1 AS y, d2 AS z FROM vectors),
    k AS (SELECT state, CAST(floor(x / 0.1e0) AS BIGINT) AS cx, CAST(floor(y / 0.1e0) AS BIGINT) AS cy, CAST(floor(z / 0.1e0) AS BIGINT) AS cz, count(DISTINCT frame) AS n FROM p GROUP BY ALL),
    c0 AS (SELECT state, cx || '/' || cy || '/' || cz AS site, (cx + 0.5e0) * 0.1e0 AS x, (cy + 0.5e0) * 0.1e0 AS y, (cz + 0.5e0) * 0.1e0 AS z FROM k a WHERE NOT EXISTS (
      SELECT 1 FROM k b WHERE b.state = a.state AND abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1 AND (b.n > a.n OR (b.n = a.n AND (b.cx, b.cy, b.cz) < (a.cx, a.cy, a.cz))))),
    {_site_members("c0", "m0")}, c1 AS (SELECT state, site, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM m0 GROUP BY ALL), {_site_members("c1", "m1")}, f AS (SELECT state, count(DISTINCT frame) AS frames FROM p GROUP BY state),
    t AS (SELECT m1.state, site, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS points, count(DISTINCT frame) AS frames, count(DISTINCT frame) / CAST(any_value(f.frames) AS DOUBLE) AS occupancy, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rmsd, any_value(f.frames) AS all_frames FROM m1 JOIN f ON f.state = m1.state GROUP BY m1.state, site)
    SELECT * EXCLUDE (all_frames), CASE WHEN all_frames < 3 THEN 'not_estimable' WHEN occupancy >= 0.5 AND rmsd <= 0.09 THEN 'stable' ELSE 'transient' END AS verdict FROM t""",
    "x y z occupancy rmsd",
)
def stable_sites(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("state", F.col("frame") % 2)
    return bonding.stable_sites(p.select("state", "frame", "x", "y", "z"), 0.1, 0.5, least_frames=3, most_rmsd=0.09, keys=("state",))


# --- partitions -------------------------------------------------------------------------------------------------

_MEANS = "centers AS (SELECT label AS cluster, [" + ", ".join(f"avg({c})" for c in DIMS) + "] AS c FROM vectors GROUP BY label)"


def _label_means(spark, sf_dir) -> np.ndarray:
    """One row per label: a handful of centres."""
    rows = vectors(spark, sf_dir).groupBy("label").agg(*[F.avg(c).alias(c) for c in DIMS]).orderBy("label").collect()
    return np.array([[r[c] for c in DIMS] for r in rows])


def _short(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.array(*DIMS).alias("v"))


_NEAR = f"{VECTORS}, {_MEANS}, near AS (SELECT vec_id, label, cluster, list_distance([{', '.join(DIMS)}], c) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance([{', '.join(DIMS)}], c), cluster) AS k FROM vectors CROSS JOIN centers)"


@query(f"WITH {_NEAR} SELECT vec_id, CAST(cluster AS INT) AS cluster, d AS cluster_distance FROM near WHERE k = 1", "cluster_distance")
def nearest_centers(spark, sf_dir):
    return clustering.assign_nearest(_short(spark, sf_dir), "v", _label_means(spark, sf_dir)).select("vec_id", "cluster", "cluster_distance")


@query(
    f"""WITH {_NEAR}, p AS (SELECT label AS t, CAST(cluster AS INT) AS g FROM near WHERE k = 1), c AS (SELECT DISTINCT t AS c FROM p UNION SELECT DISTINCT g FROM p),
    s AS (SELECT c AS class, count(*) FILTER (t = c) AS support, count(*) FILTER (g = c) AS guessed, count(*) FILTER (t = c AND g = c) AS hits FROM c CROSS JOIN p GROUP BY c),
    f AS (SELECT *, coalesce(hits / nullif(CAST(guessed AS DOUBLE), 0), 0) AS precision, coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, coalesce(2 * hits / nullif(CAST(support + guessed AS DOUBLE), 0), 0) AS f1 FROM s)
    SELECT *, avg(f1) OVER () AS macro_f1, sum(hits) OVER () / CAST(sum(support) OVER () AS DOUBLE) AS accuracy FROM f""",
    "precision recall f1 macro_f1 accuracy",
)
def classification_metrics(spark, sf_dir):
    rows = clustering.assign_nearest(_short(spark, sf_dir), "v", _label_means(spark, sf_dir))
    return summaries.classification_metrics(rows.select(F.col("label").cast("int").alias("label"), "cluster"), "label", "cluster")


@query(
    f"""WITH {_NEAR}, j AS (SELECT label, cluster, count(*) AS n FROM near WHERE k = 1 GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0e0) AS cells, CAST(sum(n) AS BIGINT) AS n FROM j),
    a AS (SELECT sum(k * (k - 1) / 2.0e0) AS r FROM (SELECT sum(n) AS k FROM j GROUP BY label)), b AS (SELECT sum(k * (k - 1) / 2.0e0) AS c FROM (SELECT sum(n) AS k FROM j GROUP BY cluster))
    SELECT n, coalesce((cells - r * c / (n * (n - 1) / 2.0e0)) / nullif((r + c) / 2 - r * c / (n * (n - 1) / 2.0e0), 0), 1) AS adjusted_rand_index FROM x CROSS JOIN a CROSS JOIN b""",
    "adjusted_rand_index",
)
def adjusted_rand(spark, sf_dir):
    return summaries.adjusted_rand(clustering.assign_nearest(_short(spark, sf_dir), "v", _label_means(spark, sf_dir)), "label", "cluster")


@query(
    f"""WITH {VECTORS}, f AS (SELECT vec_id, v, label FROM vectors ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100),
    s AS (SELECT f.vec_id, f.label, x.label AS other, sum(list_distance(f.v, x.v)) AS s, count(*) AS n FROM f CROSS JOIN vectors x GROUP BY ALL),
    t AS (SELECT vec_id, label, max(n) FILTER (other = label) AS own, max(s / nullif(n - 1, 0)) FILTER (other = label AND n > 1) AS a, min(s / n) FILTER (other <> label) AS b FROM s GROUP BY ALL)
    SELECT vec_id, label, CASE WHEN own = 1 THEN 0 ELSE (b - a) / nullif(greatest(a, b), 0) END AS silhouette FROM t""",
    "silhouette",
)
def silhouette(spark, sf_dir):
    return clustering.silhouette(vectors(spark, sf_dir), "vec_id", "v", "label", 100)


_SCORED = ", ".join(DIMS)


@query(
    f"""WITH {VECTORS}, c AS (SELECT label, [{", ".join(f"avg({x})" for x in DIMS)}] AS c FROM vectors GROUP BY label), o AS (SELECT [{", ".join(f"avg({x})" for x in DIMS)}] AS o FROM vectors),
    p AS (SELECT label, any_value(c) AS c, count(*) AS n, sum(pow(list_distance([{_SCORED}], c), 2)) AS within, avg(list_distance([{_SCORED}], c)) AS scatter FROM vectors JOIN c USING (label) GROUP BY label),
    w AS (SELECT a.label, max((a.scatter + b.scatter) / list_distance(a.c, b.c)) AS r FROM p a JOIN p b ON a.label <> b.label GROUP BY a.label)
    SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, (sum(n * pow(list_distance(c, o), 2)) / (count(*) - 1)) / (sum(within) / (sum(n) - count(*))) AS calinski_harabasz, (SELECT avg(r) FROM w) AS davies_bouldin FROM p CROSS JOIN o""",
    "calinski_harabasz davies_bouldin",
)
def partition_scores(spark, sf_dir):
    return clustering.partition_scores(_short(spark, sf_dir), "v", "label")


@query(
    f"""WITH {VECTORS}, m AS (SELECT label, avg(d0) AS a, avg(d1) AS b, avg(d2) AS c FROM vectors GROUP BY label), d AS (SELECT label, vec_id, sqrt((d0 - a) * (d0 - a) + (d1 - b) * (d1 - b) + (d2 - c) * (d2 - c)) AS distance FROM vectors JOIN m USING (label)),
    r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank, distance FROM d) SELECT * FROM r WHERE rank <= 3""",
    "distance",
)
def representative_frames(spark, sf_dir):
    return joins.representatives(vectors(spark, sf_dir), "label", ["d0", "d1", "d2"], "vec_id", 3)


@query()
def kmeans_partition(spark, sf_dir):
    rows = _short(spark, sf_dir)
    part = clustering.kmeans(rows, "vec_id", "v", 4, rounds=12)
    return clustering.assign_nearest(rows, "v", part.centers).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("cluster_distance"), 6).alias("mean_distance"))


@query()
def alternative_partitions(spark, sf_dir):
    rows = clustering.sweep(_short(spark, sf_dir), "vec_id", "v", 500)
    names = ("name", "states", "valid", "retained_fraction", "silhouette", "full_retained_fraction", "full_states")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "name string, states int, valid boolean, retained_fraction double, silhouette double, full_retained_fraction double, full_states long")


@query()
def minkowski_partition(spark, sf_dir):
    rows = _short(spark, sf_dir)
    _, x = clustering.sample_matrix(rows, "vec_id", "v", 500)
    part = clustering.minkowski_weighted(x, 3, 1.5)
    return clustering.assign_nearest(rows, "v", part.centers, 1.5, part.weights).groupBy("cluster").agg(F.count("*").alias("n"))


#: Rows of a local-depth sample; the work grows with its cube.
_DEPTH_ROWS = 500
_PALD = f"""{VECTORS}, f AS (SELECT vec_id, d0, d1, d2 FROM vectors ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id LIMIT {_DEPTH_ROWS}), d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.d0 - b.d0) * (a.d0 - b.d0) + (a.d1 - b.d1) * (a.d1 - b.d1) + (a.d2 - b.d2) * (a.d2 - b.d2)) AS d FROM f a CROSS JOIN f b),
t AS (SELECT p.i, p.j, count(*) AS size, sum(CASE WHEN x.d < y.d THEN 1.0e0 WHEN x.d = y.d THEN 0.5e0 ELSE 0 END) AS nearer FROM d p JOIN d x ON x.j = p.i JOIN d y ON y.i = x.i AND y.j = p.j WHERE p.i <> p.j AND (x.d <= p.d OR y.d <= p.d) GROUP BY p.i, p.j)"""


@query(f"WITH {_PALD} SELECT i AS vec_id, sum(nearer / size) / (SELECT count(*) - 1 FROM f) AS local_depth, sum(1.0e0 / size) / (SELECT count(*) - 1 FROM f) AS self_cohesion FROM t GROUP BY i", "local_depth self_cohesion")
def local_depths(spark, sf_dir):
    keys, x = clustering.sample_matrix(vectors(spark, sf_dir).select("vec_id", F.array(*DIMS[:3]).alias("v")), "vec_id", "v", _DEPTH_ROWS)
    c = clustering.local_depths(clustering.distances(x))
    return spark.createDataFrame([(k, float(a), float(b)) for k, a, b in zip(keys, c.sum(1), np.diag(c), strict=True)], "vec_id long, local_depth double, self_cohesion double")


@query()
def depth_communities(spark, sf_dir):
    keys, x = clustering.sample_matrix(_short(spark, sf_dir), "vec_id", "v", _DEPTH_ROWS)
    labels, _ = clustering.communities(clustering.local_depths(clustering.distances(x)))
    return spark.createDataFrame(list(zip(keys, labels, strict=True)), "vec_id long, community long")


@query()
def pattern_medoids(spark, sf_dir):
    items = presence(spark, sf_dir).groupBy("replica_id", "system_id", "item").agg(F.count("*").alias("n"))
    rows = items.where("n >= 3").groupBy("system_id", "replica_id").agg(F.sort_array(F.collect_set("item")).alias("s")).orderBy("system_id", "replica_id").collect()
    sets = [set(r.s) for r in rows]
    d = np.array([[1 - len(a & b) / len(a | b) if a | b else 0.0 for b in sets] for a in sets])
    chosen, labels, _ = clustering.medoids(d, 2) if len(sets) > 2 and d.any() else ([0], np.zeros(len(sets), int), True)
    return spark.createDataFrame([(r.system_id, r.replica_id, int(k), i in chosen) for i, (r, k) in enumerate(zip(rows, labels, strict=True))], "system_id string, replica_id string, cluster int, medoid boolean")


# --- components, models, networks -------------------------------------------------------------------------------


@query(None, "eigenvalue share")
def principal_components(spark, sf_dir):
    made = linear.principal_components(vectors(spark, sf_dir), DIMS, 4)
    total = float(vectors(spark, sf_dir).agg(scalars.total(F.var_pop(c) for c in DIMS)).first()[0])
    return spark.createDataFrame([(k, float(v), float(v) / total) for k, v in enumerate(made.values, 1)], "component int, eigenvalue double, share double")


@query(None, "score_1 score_2")
def component_scores(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("vec_id", *linear.principal_components(v, DIMS, 2).project(DIMS))


@query(None, "eigenvalue")
def time_lagged_components(spark, sf_dir):
    made = linear.time_lagged_components(vectors(spark, sf_dir), DIMS, 1, 3)
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(made.values, 1)], "component int, eigenvalue double")


@query(None, "stationary timescale")
def markov_model(spark, sf_dir):
    states, counts = markov.count_matrix(series(spark, sf_dir))
    transition, pi = markov.reversible(counts)
    scales = [None, *markov.implied_timescales(transition, pi, 1)]
    return spark.createDataFrame([(s, float(p), t) for s, p, t in zip(states, pi, scales, strict=True)], "state string, stationary double, timescale double")


@query(None, "score")
def vamp_scores(spark, sf_dir):
    rows = time_folds(series(spark, sf_dir), ["state"], 1, 3).groupBy("fold", "state", "next_state").agg(F.count("*").alias("n")).collect()
    names = sorted({x for r in rows for x in (r.state, r.next_state)})
    counts = np.zeros((3, len(names), len(names)))
    for r in rows:
        counts[r.fold, names.index(r.state), names.index(r.next_state)] += r.n
    scores = [(k, markov.vamp2(counts.sum(0) - counts[k], counts[k])) for k in range(3) if counts[k].sum()]
    return spark.createDataFrame(scores, "fold int, score double")


_NET = f"{VECTORS}, pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS i, '{b}' AS j, corr({a}, {b}) AS r FROM vectors" for k, a in enumerate(DIMS) for b in DIMS[k + 1 :]) + "), e AS (SELECT i, j, r FROM pairs WHERE abs(r) >= 0.03), b AS (SELECT i, j, r FROM e UNION ALL SELECT j, i, r FROM e)"


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pairs = information.covariance(vectors(spark, sf_dir), DIMS)
    return spark.createDataFrame([(c,) for c in DIMS], "node string"), graphs.threshold_edges(pairs, "correlation", 0.03)


@query(
    f"""WITH {_NET}, n AS (SELECT unnest([{", ".join(f"'{c}'" for c in DIMS)}]) AS node), g AS (SELECT node, count(j) AS degree, coalesce(sum(abs(r)), 0) AS strength FROM n LEFT JOIN b ON i = node GROUP BY node),
    t AS (SELECT x.i AS node, count(*) AS links FROM b x JOIN b y ON x.i = y.i AND x.j < y.j JOIN b z ON z.i = x.j AND z.j = y.j GROUP BY x.i)
    SELECT g.node, degree, strength, CASE WHEN degree < 2 THEN 0 ELSE 2.0e0 * coalesce(links, 0) / (degree * (degree - 1)) END AS clustering FROM g LEFT JOIN t ON t.node = g.node""",
    "strength clustering",
)
def correlation_network(spark, sf_dir):
    return graphs.node_table(*_network(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_NET}, reach AS (SELECT unnest([{", ".join(f"'{c}'" for c in DIMS)}]) AS node, node AS seen UNION SELECT reach.node, b.j FROM reach JOIN b ON b.i = reach.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY node"""
)
def network_components(spark, sf_dir):
    return graphs.components(*_network(spark, sf_dir))


_PROFILE = "p AS (SELECT o_orderstatus AS s, o_orderpriority AS u, avg(l_quantity) AS f1, avg(l_discount) AS f2, avg(l_tax) AS f3 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL)"


def _profiles(spark, sf_dir) -> list:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus", "o_orderpriority")
    rows = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus", "o_orderpriority")
    return rows.agg(F.avg("l_quantity").alias("f1"), F.avg("l_discount").alias("f2"), F.avg("l_tax").alias("f3")).orderBy("o_orderstatus", "o_orderpriority").collect()


@query(
    f"""WITH {_PROFILE}, n AS (SELECT *, row_number() OVER (ORDER BY s, u) - 1 AS k FROM p), l AS (SELECT k, s, unnest(['f1', 'f2', 'f3']) AS feature, unnest([f1, f2, f3]) AS v FROM n),
    m AS (SELECT mask FROM generate_series(0, 1023) g(mask) WHERE bit_count(mask) = (SELECT count(*) FROM n WHERE s = 'F')),
    d AS (SELECT mask, feature, abs(avg(v) FILTER ((mask >> k) & 1 = 1) - avg(v) FILTER ((mask >> k) & 1 = 0)) AS d FROM m CROSS JOIN l GROUP BY mask, feature),
    x AS (SELECT mask, max(d) AS top FROM d GROUP BY mask), o AS (SELECT feature, avg(v) FILTER (s = 'F') - avg(v) FILTER (s = 'O') AS difference FROM l GROUP BY feature)
    SELECT feature, any_value(difference) AS difference, avg(CASE WHEN d >= abs(difference) - 1e-12 THEN 1.0e0 ELSE 0 END) AS p, avg(CASE WHEN top >= abs(difference) - 1e-12 THEN 1.0e0 ELSE 0 END) AS familywise_p FROM d JOIN o USING (feature) JOIN x USING (mask) GROUP BY feature""",
    "difference p familywise_p",
)
def permutation_inference(spark, sf_dir):
    rows = _profiles(spark, sf_dir)
    a, b = (np.array([[r.f1, r.f2, r.f3] for r in rows if r.o_orderstatus == s]) for s in "FO")
    told = learning.permutation_test(a, b)
    return spark.createDataFrame([(f"f{k}", float(d), float(p), float(q)) for k, (d, p, q) in enumerate(zip(told["difference"], told["p"], told["familywise_p"], strict=True), 1)], "feature string, difference double, p double, familywise_p double")


def _grouped(spark, sf_dir) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row per user: mean and spread of values, share of errors; the class is the parity, the group the user modulo five."""
    s = series(spark, sf_dir)
    rows = s.groupBy("replica_id").agg(F.avg("value").alias("a"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("b"), F.avg((F.col("state") == "error").cast("double")).alias("c"))
    told = clustering.identity_hash_sample(rows, "replica_id", clustering.MAX_SAMPLE).orderBy("replica_id").collect()
    return np.array([[r.a, r.b, r.c] for r in told], float), np.array([r.replica_id % 2 for r in told], int), np.array([r.replica_id % 5 for r in told], int)


@query(None, "macro_f1 accuracy")
def grouped_tree(spark, sf_dir):
    x, y, g = _grouped(spark, sf_dir)
    guess = learning.leave_group_out(x, y, g, lambda a, b, c: learning.predict_tree(learning.fit_tree(a, b), c))
    return spark.createDataFrame([(len(y), *learning.macro_metrics(y, guess))], "rows int, macro_f1 double, accuracy double")


@query(None, "macro_f1 accuracy")
def grouped_logistic(spark, sf_dir):
    told = learning.nested_classification(*_grouped(spark, sf_dir), strengths=(0.1, 1.0))
    return spark.createDataFrame([(k, told[k]["macro_f1"], told[k]["accuracy"]) for k in ("full", "top_feature_only", "without_top_feature")], "model string, macro_f1 double, accuracy double")

