"""Set operations over partial results and findings: coverage gates, dictionaries with one numbering, repeated issues, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .model import held, issues, require


def covered_partials(partials: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """``partials`` if they hold each row of ``expected(*keys)`` just once and nothing else; otherwise the query fails.

    What is counted is one row per shard, so the gate is small next to the partials."""
    found = partials.groupBy(*keys).agg(F.count("*").alias("_n"))
    gaps = expected.select(*keys, F.lit(1).alias("_e")).join(found, keys, "full").where("_e is null or _n is null or _n > 1").agg(F.count("*").alias("_gaps"))
    return require(partials.crossJoin(F.broadcast(gaps)), F.col("_gaps") == 0, "partial results are missing, repeated or unknown").drop("_gaps")


def merged_moments(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of ``partials(*keys, n, mean, sd, least, most)`` put together, as if all rows had been summed at once; a partial of one row has no SD."""
    n, m = F.col("n"), F.col("mean")
    squares = F.when(n > 1, (n - 1) * F.col("sd") * F.col("sd")).otherwise(0.0)
    told = partials.where("n > 0").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(n * m).alias("_s"), F.sum(squares + n * m * m).alias("_q"), F.min("least").alias("least"), F.max("most").alias("most"))
    mean = F.col("_s") / F.col("n")
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("n") * mean * mean)
    return told.select(*keys, "n", mean.alias("mean"), F.when(F.col("n") > 1, F.sqrt(spread / (F.col("n") - 1))).alias("sd"), "least", "most")


def numbered_union(parts: DataFrame, item: str) -> DataFrame:
    """``(item, index)``: the distinct items of all parts in order, numbered from 0.

    Items are range-partitioned and numbered inside a partition; only one count per partition meets in one task."""
    shuffle = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = parts.select(item).where(F.col(item).isNotNull()).distinct().repartitionByRange(shuffle, item)
    ranged, _ = held(ranged.withColumn("_p", F.spark_partition_id()))  # ranges are sampled, so they are fixed before they are read twice
    inside = ranged.withColumn("_k", F.row_number().over(W.partitionBy("_p").orderBy(item)) - 1)
    before = inside.groupBy("_p").agg(F.min(item).alias("_first"), F.count("*").alias("_c"))
    before = before.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(F.broadcast(before.select("_p", "_before")), "_p").select(item, (F.col("_before") + F.col("_k")).cast("bigint").alias("index"))


def same_value(rows: DataFrame, key: str, value: str, code: str) -> DataFrame:
    """Issues for keys that parts describe differently, as one atom's element in two of them."""
    told = rows.groupBy(key).agg(F.count_distinct(value).alias("n"))
    return issues(told, code, F.col("n") > 1, F.col(key), f"{value} differs between parts")


def unique_issues(rows: DataFrame) -> DataFrame:
    """Each issue once, whatever workers repeat it, with how many did."""
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("reported"))


def unique_findings(rows: DataFrame, identity: list[str], source: str, order: Column, most: int = 100) -> DataFrame:
    """The first row by ``order`` of each ``identity``, with ``reports``, how many name it, and ``sources``, the ``most`` smallest distinct names of their reports.

    One row per identity and source meets, so a finding that all reports repeat is cut down where it lies."""
    kept = [c for c in rows.columns if c not in (*identity, source)]
    best = rows.groupBy(*identity).agg(F.min_by(F.struct(*kept), order).alias("_b"), F.count("*").alias("reports"))
    named = rows.select(*identity, source).distinct().withColumn("_k", F.row_number().over(W.partitionBy(*identity).orderBy(source))).where(F.col("_k") <= most)
    names = named.groupBy(*identity).agg(F.array_sort(F.collect_list(source)).alias("sources"))
    return best.join(names, identity).select(*identity, "_b.*", "reports", "sources")


def headlines(rows: DataFrame, order: list[Column], headline: int = 12, total: int = 50) -> DataFrame:
    """The first ``total`` rows with their ``rank`` and whether they are among the first ``headline``: a top-k, ``total`` rows at most from each task."""
    top = rows.orderBy(*order).limit(total)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order)).cast("bigint")).withColumn("headline", F.col("rank") <= headline)


def member_correlations(scores: DataFrame, keys: list[str], frame: str, member: str, columns: list[str], least: int = 20) -> DataFrame:
    """``(*keys, left_member, right_member, left_component, right_component, pairs, correlation)`` of members' scores in the same frames of one segment.

    Members of one frame are few; they are joined on the frame. NULL below ``least`` frames or without spread. A member told twice for a frame fails the query."""
    twice = F.count("*").over(W.partitionBy(*keys, frame, member))
    rows = require(scores.withColumn("_n", twice), F.col("_n") == 1, "a member has two scores for one frame").select(*keys, frame, F.col(member).alias("m"), F.array(*columns).alias("s"))
    left, right = (rows.select(*keys, frame, F.col("m").alias(f"{side}_member"), F.posexplode("s").alias(f"{side}_component", side)) for side in ("left", "right"))
    pairs = left.join(right, [*keys, frame]).where("left_member < right_member")
    told = pairs.groupBy(*keys, "left_member", "right_member", "left_component", "right_component").agg(F.count("*").alias("pairs"), F.corr("left", "right").alias("r"))
    return told.select(*keys, "left_member", "right_member", (F.col("left_component") + 1).alias("left_component"), (F.col("right_component") + 1).alias("right_component"), "pairs", F.when((F.col("pairs") >= least) & ~F.isnan("r"), F.col("r")).alias("correlation"))


def representative_frames(df: DataFrame, state: str, key: str, vector: str, weight: str | None = None, deviations: float = 1.0, medoid_rows: int = 1000) -> DataFrame:
    """``(state, key, rmsd, closest, central, medoid)`` of vectors of 3 n coordinates on one basis.

    ``rmsd`` is to the state's weighted mean; ``closest`` the least of it, ``central`` within ``deviations`` weighted SDs of its weighted mean. ``medoid`` has the least weighted
    mean RMSD to a state's rows, among the ``medoid_rows`` nearest to the mean; every other row is compared with these, in blocks by state. Ties go to the lower key."""
    rows = df.select(state, key, F.col(vector).alias("v"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    long = rows.select(state, "w", F.posexplode("v").alias("j", "x"))
    mean = long.groupBy(state, "j").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m")).groupBy(state).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))), lambda s: s["m"]).alias("mean"))
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / (F.size(a) / 3))
    near = rows.join(F.broadcast(mean), state).withColumn("rmsd", apart(F.col("v"), F.col("mean"))).drop("mean")
    total = F.sum("w")
    told = near.groupBy(state).agg((F.sum(F.col("rmsd") * F.col("w")) / total).alias("_m"), (F.sum(F.col("rmsd") * F.col("rmsd") * F.col("w")) / total).alias("_q"), F.min_by(key, F.struct("rmsd", key)).alias("_closest"))
    limit = told.select(state, "_closest", (F.col("_m") + deviations * F.sqrt(F.greatest(F.lit(0.0), F.col("_q") - F.col("_m") * F.col("_m")))).alias("_limit"))
    candidates = near.withColumn("_r", F.row_number().over(W.partitionBy(state).orderBy("rmsd", key))).where(F.col("_r") <= medoid_rows).select(state, F.col(key).alias("_k"), F.col("v").alias("_v"))
    costs = near.join(candidates, state).groupBy(state, "_k").agg((F.sum(apart(F.col("v"), F.col("_v")) * F.col("w")) / total).alias("_cost"))
    medoid = costs.groupBy(state).agg(F.min_by("_k", F.struct("_cost", "_k")).alias("_medoid"))
    out = near.join(F.broadcast(limit), state).join(F.broadcast(medoid), state)
    return out.select(state, key, "rmsd", (F.col(key) == F.col("_closest")).alias("closest"), (F.col("rmsd") <= F.col("_limit")).alias("central"), (F.col(key) == F.col("_medoid")).alias("medoid"))
