"""Networks of thresholded pair values: degrees, strengths, triangles, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import held


def threshold_edges(pairs: DataFrame, value: str, limit: float, negative: bool = True) -> DataFrame:
    """``(i, j, weight)`` of pairs whose absolute value reaches the limit; undefined pairs are no edges."""
    keep = (F.col("i") != F.col("j")) & F.col(value).isNotNull() & (F.abs(value) >= limit)
    return pairs.where(keep if negative else keep & (F.col(value) >= 0)).select("i", "j", F.col(value).alias("weight"))


def node_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, degree, strength, clustering)``; a node with fewer than two neighbours has clustering 0.

    Triangles come from joins along edges that point to the end of larger degree, so no node has more than sqrt(2 edges) outgoing ones: a hub forms
    no pairs of its neighbours.
    """
    both = edges.select("i", "j", "weight").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))
    degree = both.groupBy(F.col("i").alias("node")).agg(F.count("*").alias("degree"), F.sum(F.abs("weight")).alias("strength"))
    ranks = degree.select("node", F.struct("degree", "node").alias("r"))
    ranked = edges.select("i", "j").join(ranks.select(F.col("node").alias("i"), F.col("r").alias("ri")), "i").join(ranks.select(F.col("node").alias("j"), F.col("r").alias("rj")), "j")
    e = ranked.select(F.least("ri", "rj")["node"].alias("a"), F.greatest("ri", "rj").alias("rb")).select("a", F.col("rb.node").alias("b"), "rb")
    wedge = e.join(e.select("a", F.col("b").alias("c"), F.col("rb").alias("rc")), "a").where("rb < rc").select("a", "b", "c")
    closed = wedge.join(e.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    out = nodes.join(degree, "node", "left").join(closed, "node", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("degree", "triangles")})
    clustering = F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(2.0 * F.col("triangles") / F.nullif(F.col("degree") * (F.col("degree") - 1), F.lit(0)))
    return out.select("node", "degree", F.coalesce("strength", F.lit(0.0)).alias("strength"), clustering.alias("clustering"))


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)``, the smallest node reachable: labels fall along edges, then along their own pointers, until nothing changes.

    Each round is checkpointed to the shared folder where one is set, so that a lost executor repeats one round at most, and the round before is let go.
    """
    both = edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j")))
    now, last = nodes.select("node", F.col("node").alias("component")), None
    for _ in range(max_rounds):
        near = both.join(now, F.col("j") == F.col("node")).groupBy("i").agg(F.min("component").alias("least"))
        step = now.join(near, F.col("node") == F.col("i"), "left").select("node", F.least("component", "least").alias("component"), F.col("component").alias("was"))
        hop = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = step.join(hop, "component").select("node", F.col("further").alias("component"), "was")
        step, saved = held(step)
        changed = step.where("component <> was").limit(1).count()
        if last is not None:
            last.unpersist()
        if not changed:
            return step.select("node", "component")
        now, last = step.select("node", "component"), None if saved else step
    raise RuntimeError("labels still change")
