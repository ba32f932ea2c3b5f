"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of equal size. Block j of a source with weight w may start from slot floor((j - 1) / w)
and must run before slot ceil(j / w); of the blocks released, the earliest deadline goes first. Releases and deadlines come from
the exact weights, for every block of the run, so at any length each source that hasn't run out is less than one block away
from its target share. The driver schedules the blocks one after another and hands them out in bounded chunks; every
document finds its slot from its number within its source. A source that ran out leaves its slots to released blocks
of others or empty; as no block starts before its release, the others keep their proportions. No document is
dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from seriata.llm.storage import new_path

#: Production parameters: documents in a block; a source's weight goes with the power ALPHA of its number of documents.
BLOCK = 16
ALPHA = 0.7
#: Blocks that the driver hands out at once; up to so many in all are sent to every task, more are joined by a shuffle.
CHUNK = 1 << 20
#: Documents of a source that are numbered in one task.
PART = 4096


def quantised(weights: dict, slots: int) -> dict:
    """Slots of each source in a frame: the weight's share, one at least, by largest remainder; they add up to ``slots``."""
    total = sum(weights.values())
    exact = {s: w / total * slots for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    names = sorted(weights, key=lambda s: (-(exact[s] - math.floor(exact[s])), s is None, s or ""))
    at = 0
    while sum(out.values()) < slots:
        out[names[at % len(names)]] += 1
        at += 1
    over = sum(out.values()) - slots
    while over:
        largest = max(out, key=lambda s: (out[s], s is None, s or ""))
        out[largest] -= 1
        over -= 1
    return out


def whole_weights(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    exact = {w: Fraction(w) for w in set(weights)}
    scale = math.lcm(*(x.denominator for x in exact.values())) if exact else 1
    whole = {w: int(x * scale) for w, x in exact.items()}
    return [whole[w] for w in weights]


def block_schedule(weights: list[int], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, number of its block, release, deadline, slot) by slot: earliest deadline first among released blocks.

    ``blocks`` has the number of blocks of each source, one at least. Slots in which no block is released stay empty.
    """
    total = sum(weights)
    first = {w: -(-total // w) for w in set(weights)}
    fresh = sorted(range(len(weights)), key=lambda i: first[weights[i]])  # their first blocks, all released at 0
    waiting: list[tuple[int, int, int]] = []  # release, source, block
    ready: list[tuple[int, int, int, int]] = []  # deadline, source, block, release
    at = slot = 0
    while at < len(fresh) or ready or waiting:
        while waiting and waiting[0][0] <= slot:
            release, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // weights[i]), i, j, release))
        if at < len(fresh) and (not ready or (first[weights[fresh[at]]], fresh[at]) < ready[0]):
            deadline, i, j, release = first[weights[fresh[at]]], fresh[at], 0, 0
            at += 1
        elif ready:
            deadline, i, j, release = heapq.heappop(ready)
        else:
            slot = waiting[0][0]
            continue
        assert deadline > slot, "the weights overload the schedule"
        yield i, j, release, deadline, slot
        if j + 1 < blocks[i]:
            heapq.heappush(waiting, ((j + 1) * total // weights[i], i, j + 1))
        slot += 1


def frame_schedule(counts: dict) -> list[tuple]:
    """(source, number of its block) for each slot of a frame that holds ``counts`` blocks of each source."""
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    each = [counts[s] for s in names]
    return [(names[i], j) for i, j, *_ in block_schedule(each, each)]


def numbered(docs: DataFrame, part: int = PART) -> DataFrame:
    """``docs(k1, k2, doc_id, ..)`` with ``nth``: 0, 1, .. within the source ``(k1, k2)``, in an order mixed by a hash of the id.

    A source is split by that hash into parts of about ``part`` documents, numbered each in its task; only the parts' counts
    are added up over the source. Rows are shuffled once, by source and part, and the join reads that partitioning.
    """
    sizes = docs.groupBy("k1", "k2").agg(F.count("*").alias("_n"))
    split = docs.join(F.broadcast(sizes), ["k1", "k2"]).withColumn("_h", F.xxhash64(F.lit("mixing"), "doc_id"))
    split = split.withColumn("_part", F.pmod(F.xxhash64("_h"), F.ceil(F.col("_n") / part).cast("bigint"))).drop("_n")
    inside = W.partitionBy("k1", "k2", "_part").orderBy("_h", "doc_id")
    counts = split.groupBy("k1", "k2", "_part").agg(F.count("*").alias("_c"))
    earlier = W.partitionBy("k1", "k2").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("k1", "k2", "_part", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    joined = split.withColumn("_k", F.row_number().over(inside).cast("bigint") - 1).join(before, ["k1", "k2", "_part"])
    return joined.withColumn("nth", F.col("_before") + F.col("_k")).drop("_h", "_part", "_k", "_before")


def schedule(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, alpha: float = ALPHA, carry: tuple[str, ...] = (), part: int = PART) -> DataFrame:
    """``doc_id, source, target_weight, nth, block, release, deadline, slot, position`` for each row of ``docs(doc_id, source)``.

    ``slot`` is the block's place in the schedule (slots of sources that ran out are skipped), ``position`` orders the documents.
    Null is a source of its own. ``weights`` maps every source to a positive number; without it a source weighs its number
    of documents to the power ``alpha``. Columns of ``carry`` come along as the struct ``carried``. An empty table gives no rows; repeated
    rows each have a place.
    """
    spark = docs.sparkSession
    keyed = [F.coalesce("source", F.lit("")).alias("k1"), F.col("source").isNull().alias("k2")]
    docs = docs.select("doc_id", *keyed, *([F.struct(*carry).alias("carried")] if carry else []))
    sizes = docs.groupBy("k1", "k2").agg(F.count("*").alias("n")).toArrow().sort_by([("k2", "ascending"), ("k1", "ascending")])
    counts = sizes["n"].to_pylist()
    if weights is None:
        own = [n**alpha for n in counts]
    else:
        names = [None if null else s for s, null in zip(sizes["k1"].to_pylist(), sizes["k2"].to_pylist(), strict=True)]
        if missing := [s for s in names if not weights.get(s, 0) > 0]:
            raise ValueError(f"no positive weight for {missing[:5]}")
        own = [weights[s] for s in names]
    blocks = [-(-n // block) for n in counts]
    table = spark.read.schema(_PLACE).parquet(_placed(spark, sizes, whole_weights(own), blocks))
    if sum(blocks) <= CHUNK:
        table = F.broadcast(table)
    rows = numbered(docs, part).withColumn("block", F.floor(F.col("nth") / block)).join(table, ["k1", "k2", "block"])
    return rows.select(
        "doc_id", F.when(~F.col("k2"), F.col("k1")).alias("source"), "target_weight", "nth", "block", "release", "deadline",
        "slot", (F.col("slot") * block + F.pmod(F.col("nth"), F.lit(block))).alias("position"), *(["carried"] if carry else []),
    )


def mixed(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, alpha: float = ALPHA) -> DataFrame:
    """``docs`` sorted by their position in the schedule: every row once, whole. The rows are shuffled twice, to number and to sort them."""
    placed = schedule(docs, weights, block, alpha, carry=tuple(docs.columns))
    return placed.select("position", "carried").orderBy("position").select("carried.*")


_PLACE = "k1 string, k2 boolean, target_weight double, block long, release long, deadline long, slot long"


def _placed(spark, sizes: pa.Table, weights: list[int], blocks: list[int]) -> str:
    """Where the places of all blocks are, written CHUNK blocks at a time."""
    path = new_path(spark, "mixing")
    total = sum(weights)
    share = {w: w / total for w in set(weights)}

    def write(cols: list[array]) -> None:
        of = sizes.select(["k1", "k2"]).take(pa.array(cols[0], pa.int64()))
        made = of.append_column("target_weight", pa.array([share[weights[i]] for i in cols[0]], pa.float64()))
        for name, c in zip(("block", "release", "deadline", "slot"), cols[1:], strict=True):
            made = made.append_column(name, pa.array(c, pa.int64()))
        spark.createDataFrame(made, _PLACE).write.mode("append").parquet(path)

    held = [array("q") for _ in range(5)]
    for row in block_schedule(weights, blocks):
        for c, v in zip(held, row, strict=True):
            c.append(v)
        if len(held[0]) >= CHUNK:
            write(held)
            held = [array("q") for _ in range(5)]
    if held[0] or not blocks:
        write(held)
    return path
