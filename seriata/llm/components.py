"""Connected components of a link table, by alternating large-star and small-star rounds.

Every round is joins and partially aggregated minima, so a node with many links is split over map tasks
before it meets in one place, and no component is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` of bigint nodes to ``(node, root)``, root the smallest node of the component.

    Self-links and nulls are ignored; nodes without a link don't appear. Raises if ``max_rounds`` don't suffice,
    rather than returning components that are not closed. The link tables go to the shared folder after each
    round, so a lost executor repeats one round at most.
    """
    now, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    for _ in range(max_rounds):
        starred, new_path = stored(_small_star(_large_star(now)), "links")
        told = starred.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(now.sparkSession, path)
        now, path, last, same = starred, new_path, told, told == last
        if same:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"links are not closed after {max_rounds} rounds")
