"""Identity mapping and spatial joins. Distances are joined through a grid of cells, never as a Cartesian product."""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import minimum_image, ratio, total
from .model import bounded, held

XYZ = ("x", "y", "z")


def map_identities(reference: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(mapped, excluded)``: keys that are unique on both sides, and all others with the reason. Nothing is matched by position."""
    a = reference.groupBy(key).agg(F.count("*").alias("in_reference"))
    b = target.groupBy(key).agg(F.count("*").alias("in_target"))
    both = a.join(b, key, "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("in_reference", "in_target")})
    reason = F.when(F.col("in_target") == 0, "missing_in_target").when(F.col("in_reference") == 0, "missing_in_reference").otherwise("not_unique")
    clean = (F.col("in_reference") == 1) & (F.col("in_target") == 1)
    return both.where(clean).select(key), both.where(~clean).withColumn("reason", reason)


def common_keys(df: DataFrame, key: str, target: str) -> DataFrame:
    """Keys that every target has."""
    n = df.agg(F.count_distinct(target).alias("_all"))
    return df.groupBy(key).agg(F.count_distinct(target).alias("targets")).crossJoin(F.broadcast(n)).where("targets = _all").drop("_all")


def _cell(c: str, cutoff: float) -> Column:
    return F.floor(F.col(c) / cutoff).cast("bigint")


#: Left points of one cell that meet the points around them in one task.
BLOCK = 2048


def neighbor_pairs(left: DataFrame, right: DataFrame, cutoff: float, frame: str | None = None, box: tuple[float, float, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``(frame, left_id, right_id, distance)`` for all points within ``cutoff``; both sides have ``id, x, y, z``.

    Each left point goes to its own cell and each right point to the 27 around it, so equal cells meet once. With ``box`` cells
    wrap and distances use the nearest image; a box must be three cutoffs wide at least, or cells would meet twice.
    """
    return near_rows(left, right, cutoff, frame, box, block).select(*([frame] if frame else []), "left_id", "right_id", "distance")


def near_rows(left: DataFrame, right: DataFrame, cutoff: float, frame: str | None = None, box: tuple[float, float, float] | None = None, block: int = BLOCK, carry: tuple[str, ...] = (), carry_right: tuple[str, ...] = ()) -> DataFrame:
    """``neighbor_pairs`` with the columns ``carry`` of the left side and ``carry_right`` of the right one (names of their own), so that pairs needn't be joined again.

    The left points of a full cell are dealt by hash to blocks of about ``block``, and a right point is copied to each block of its 27 cells: a task
    holds one block and streams what is near it, and one full cell is shared out to as many tasks as it has blocks. The partitions are set,
    as bytes don't tell the work of pairs.
    """
    keys = [frame] if frame else []
    if box and min(box) < 3 * cutoff:
        raise ValueError("the box is less than three cutoffs wide")
    counts = [int(b // cutoff) for b in box] if box else None
    widths = [b / n for b, n in zip(box, counts, strict=True)] if box else [cutoff] * 3
    # a periodic cell is at least one cutoff wide
    own = [F.pmod(F.floor(F.col(c) / w), F.lit(n)).cast("bigint") if box else _cell(c, w) for c, w, n in zip(XYZ, widths, counts or [0] * 3, strict=True)]
    cells = [f"c{c}" for c in XYZ]
    placed = left.select(*keys, *[k.alias(c) for k, c in zip(own, cells, strict=True)])
    blocks = placed.groupBy(*keys, *cells).agg(F.ceil(F.count("*") / block).cast("bigint").alias("_blocks"))
    a = left.select(*keys, F.col("id").alias("left_id"), *[F.col(c).alias(f"l{c}") for c in XYZ], *carry, *[k.alias(c) for k, c in zip(own, cells, strict=True)])
    a = a.join(blocks, [*keys, *cells]).withColumn("_block", F.pmod(F.xxhash64("left_id"), F.col("_blocks"))).drop("_blocks")
    around = F.explode(F.array(*[F.struct(*[F.lit(d).cast("bigint").alias(c) for d, c in zip(step, XYZ, strict=True)]) for step in product((-1, 0, 1), repeat=3)])).alias("_s")
    b = right.select(*keys, F.col("id").alias("right_id"), *[F.col(c).alias(f"r{c}") for c in XYZ], *carry_right, *[k.alias(f"_c{c}") for k, c in zip(own, XYZ, strict=True)], around)
    shifted = [F.pmod(F.col(f"_c{c}") + F.col(f"_s.{c}"), F.lit(n)) if box else F.col(f"_c{c}") + F.col(f"_s.{c}") for c, n in zip(XYZ, counts or [0] * 3, strict=True)]
    b = b.select(*keys, "right_id", *[f"r{c}" for c in XYZ], *carry_right, *[s.alias(c) for s, c in zip(shifted, cells, strict=True)])
    b = b.join(blocks, [*keys, *cells]).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).drop("_blocks")
    d = [F.col(f"l{c}") - F.col(f"r{c}") for c in XYZ]
    if box:
        d = [minimum_image(x, length) for x, length in zip(d, box, strict=True)]
    apart = F.sqrt(total(x * x for x in d))
    at, parts = [*keys, *cells, "_block"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the side that a merge join holds is the last one: one block
    met = b.repartition(parts, *at).join(a.repartition(parts, *at), at).withColumn("distance", apart).where(F.col("distance") <= cutoff)
    return met.select(*keys, "left_id", "right_id", "distance", *[f"l{c}" for c in XYZ], *[f"r{c}" for c in XYZ], *carry, *carry_right)


def nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest partner of each left point among ``neighbor_pairs``, ties by id."""
    best = pairs.groupBy(*keys, "left_id").agg(F.min(F.struct("distance", "right_id")).alias("b"))
    return best.select(*keys, "left_id", F.col("b.right_id").alias("right_id"), F.col("b.distance").alias("distance"))


def group_distances(pairs: DataFrame, left_group: str, right_group: str) -> DataFrame:
    """Least, mean and largest distance of each two groups, with the closest pair (ties by ids)."""
    told = pairs.groupBy(left_group, right_group).agg(F.count("*").alias("pairs"), F.min(F.struct("distance", "left_id", "right_id")).alias("b"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))
    return told.select(left_group, right_group, "pairs", F.col("b.distance").alias("min_distance"), F.col("b.left_id").alias("left_id"), F.col("b.right_id").alias("right_id"), "mean_distance", "max_distance")


def group_pair_distances(points: DataFrame, block: int = 1024) -> DataFrame:
    """``(frame, left_group, right_group, pairs, min_distance, left_id, right_id, mean_distance, max_distance)`` over all pairs of ``points(frame, grp, id, x, y, z)``
    of two groups of a frame, near or far; the closest pair's ties go by ids.

    A frame goes to one task, where blocks of distances are added up; no pair becomes a row.
    """
    schema = "frame long, left_group string, right_group string, pairs long, min_distance double, left_id long, right_id long, mean_distance double, max_distance double"

    def told(rows):
        import pandas as pd

        rows, out = rows.sort_values("id"), []
        parts = {g: (r["id"].to_numpy(), r[list(XYZ)].to_numpy(float)) for g, r in rows.groupby("grp", sort=True)}
        for a, b in combinations(parts, 2):
            (ia, pa), (ib, pb) = parts[a], parts[b]
            total_, most, best = 0.0, 0.0, (np.inf, 0, 0)
            for lo in range(0, len(pa), block):
                d = np.sqrt(((pa[lo : lo + block, None] - pb[None]) ** 2).sum(2))
                total_, most = total_ + d.sum(), max(most, d.max())
                i, j = np.unravel_index(d.argmin(), d.shape)
                best = min(best, (d[i, j], int(ia[lo + i]), int(ib[j])))
            out.append((rows["frame"].iloc[0], str(a), str(b), len(pa) * len(pb), *best, total_ / (len(pa) * len(pb)), most))
        return pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return points.select(F.col("frame").cast("bigint").alias("frame"), "grp", F.col("id").cast("bigint").alias("id"), *XYZ).groupBy("frame").applyInPandas(told, schema)


def species_shells(nearest_rows: DataFrame, frames: DataFrame, shells: list[float]) -> DataFrame:
    """``(species, shell, frames, mean, sd, least, most)`` of how many particles of each species lie within each shell, over every row of ``frames(frame)``: a frame without
    one counts as zero. ``nearest_rows(frame, species, particle, distance)``; sums and squares are added up, so partial results could be too."""
    inside = [F.count_if(F.col("distance") <= s).alias(f"s{k}") for k, s in enumerate(shells)]
    counts = nearest_rows.groupBy("frame", "species").agg(*inside)
    long = counts.select("species", F.inline(F.array(*[F.struct(F.lit(s).alias("shell"), F.col(f"s{k}").alias("n")) for k, s in enumerate(shells)])))
    total_ = frames.agg(F.count("*").alias("_f"))
    told = long.groupBy("species", "shell").agg(F.count("*").alias("_seen"), F.sum("n").alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_q"), F.min("n").alias("_lo"), F.max("n").alias("most")).crossJoin(F.broadcast(total_))
    mean = F.col("_s") / F.col("_f")
    spread = F.greatest(F.lit(0.0), F.col("_q") - F.col("_f") * mean * mean)
    least = F.when(F.col("_seen") < F.col("_f"), F.lit(0).cast("bigint")).otherwise(F.col("_lo"))
    return told.select("species", "shell", F.col("_f").alias("frames"), mean.alias("mean"), F.when(F.col("_f") > 1, F.sqrt(spread / (F.col("_f") - 1))).alias("sd"), least.alias("least"), "most")


def nearest_anywhere(left: DataFrame, right: DataFrame, cutoff: float, keys: list[str], doublings: int = 12) -> DataFrame:
    """The nearest right point of each left point, however far (ties by id; none only where the frame has no right point).

    Points that have none within the cutoff are tried again with a cutoff twice as large; at the last round cells are so wide that what is left is compared with
    its whole frame."""
    frame = keys[0] if keys else None
    found, rest, reach = None, left, cutoff
    for k in range(doublings + 1):
        last = k == doublings
        if last:
            pairs = rest.select(*keys, F.col("id").alias("left_id"), *[F.col(c).alias(f"l{c}") for c in XYZ])
            other = right.select(*keys, F.col("id").alias("right_id"), *XYZ)
            apart = F.sqrt(total((F.col(f"l{c}") - F.col(c)) * (F.col(f"l{c}") - F.col(c)) for c in XYZ))
            near = nearest((pairs.join(other, keys) if keys else pairs.crossJoin(other)).select(*keys, "left_id", "right_id", apart.alias("distance")), keys)
        else:
            near = nearest(neighbor_pairs(rest, right, reach, frame), keys)
        near, _ = held(near)
        found = near if found is None else found.unionByName(near)
        rest, _ = held(rest.join(near.select(*keys, F.col("left_id").alias("id")), [*keys, "id"], "left_anti"))
        reach *= 2
        if last or not rest.limit(1).count():
            return found
    return found


def shell_histogram(pairs: DataFrame, points: int, volume: float, width: float, cutoff: float) -> DataFrame:
    """Radial distribution: pairs per shell over those expected at the box's mean density. Empty shells are listed with zero."""
    shells = int(round(cutoff / width))
    counts = pairs.where(F.col("left_id") < F.col("right_id")).groupBy(F.least(F.lit(shells - 1), F.floor(F.col("distance") / width)).cast("bigint").alias("shell")).agg(F.count("*").alias("n"))
    grid = pairs.sparkSession.range(shells).select(F.col("id").alias("shell"))
    r0, r1 = F.col("shell") * width, (F.col("shell") + 1) * width
    expected = points * (points - 1) / 2 * (4.0 / 3.0) * 3.141592653589793 * (F.pow(r1, F.lit(3.0)) - F.pow(r0, F.lit(3.0))) / volume
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return grid.join(F.broadcast(counts), "shell", "left").select("shell", n.alias("n"), (n / expected).alias("g"))


def native_fractions(points: DataFrame, cutoff: float, reference: int) -> DataFrame:
    """Share of the contacts of the reference frame that hold in each frame of ``points(frame, id, x, y, z)``; an id stands once in a frame.

    Each point brings where it is in the reference frame, and pairs are sought there: a pair is counted where it meets, and none becomes a row. The reference
    frame's own count is the number of its contacts.
    """
    there = points.where(F.col("frame") == reference).select("id", *XYZ)
    both = points.select("frame", "id", *[F.col(c).alias(f"_{c}") for c in XYZ]).join(there, "id")
    mine, other = ([F.col(f"_{c}").alias(f"_{side}{c}") for c in XYZ] for side in "lr")
    a, b = (both.select("frame", "id", *XYZ, *own) for own in (mine, other))
    near = near_rows(a, b, cutoff, "frame", carry=tuple(f"_l{c}" for c in XYZ), carry_right=tuple(f"_r{c}" for c in XYZ)).where("left_id < right_id")
    now = F.sqrt(total((F.col(f"_l{c}") - F.col(f"_r{c}")) * (F.col(f"_l{c}") - F.col(f"_r{c}")) for c in XYZ))
    kept = near.where(now <= cutoff).groupBy("frame").agg(F.count("*").alias("kept"))
    told = points.select("frame").distinct().join(kept, "frame", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("bigint"))
    contacts = F.coalesce(F.max(F.when(F.col("frame") == reference, F.col("kept"))).over(W.partitionBy()), F.lit(0)).cast("bigint")  # one row per frame
    return told.withColumn("contacts", contacts).select("frame", "contacts", ratio(F.col("kept"), F.col("contacts")).alias("native_fraction"))


def bridges(edges: DataFrame, frame: str, endpoint: str, hub: str, most: int = 5000) -> DataFrame:
    """``(a, b, frames, hubs)``: endpoints that one hub ties together in a frame, each unordered pair counted once a frame.

    Pairs meet inside one frame and hub only; a hub with more than ``most`` endpoints in a frame is refused.
    """
    e = bounded(edges.select(frame, hub, endpoint).distinct(), [frame, hub], most)
    left, right = e.select(frame, hub, F.col(endpoint).alias("a")), e.select(frame, hub, F.col(endpoint).alias("b"))
    return left.join(right, [frame, hub]).where("a < b").groupBy("a", "b").agg(F.count_distinct(frame).alias("frames"), F.count_distinct(hub).alias("hubs"))


def shell_persistence(nearest_rows: DataFrame, frames: int, shells: list[float], particle: str) -> DataFrame:
    """Per particle the share of frames inside each shell, and its class by the innermost one: from 0.50 persistent, from 0.05 intermittent, else transient."""
    share = [(F.count_if(F.col("distance") <= s) / frames).alias(f"shell_{k}") for k, s in enumerate(shells, 1)]
    out = nearest_rows.groupBy(particle).agg(*share)
    kind = F.when(F.col("shell_1") >= 0.50, "persistent").when(F.col("shell_1") >= 0.05, "intermittent").otherwise("transient")
    return out.withColumn("persistence", kind)


def representatives(df: DataFrame, state: str, columns: list[str], key: str, k: int) -> DataFrame:
    """The ``k`` rows of each state nearest to the state's mean, by distance, then key."""
    means = df.groupBy(state).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    d = F.sqrt(total((F.col(c) - F.col(f"_m_{c}")) * (F.col(c) - F.col(f"_m_{c}")) for c in columns))
    rows = df.join(means, state).withColumn("distance", d)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(state).orderBy("distance", key)).cast("bigint"))
    return ranked.where(F.col("rank") <= k).select(state, key, "rank", "distance")
