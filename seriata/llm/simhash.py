"""SimHash fingerprints, a Hamming search over permuted block tables, and near-duplicate classes by ball hashing.

Votes are counted in the JVM: a term's 64-bit hash gives 32 longs with two 32-bit counters each, which plain
sums add up inside generated code. No text is shuffled for a fingerprint, only one row of counters a text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .components import components
from .storage import stored
from .text import ascii_lower, hex16, whole, words

_LANES = (1 << 32) | 1
_LOW = (1 << 32) - 1


def shingle_rows(df: DataFrame, text: Column, size: int) -> DataFrame:
    """One row per run of ``size`` words with columns ``s0``.. of its words; a shorter text gives one row, its words in ``s0``.

    A text without words gives one row of nulls. Repeated runs give repeated rows. All other columns stay.
    """
    keep = df.columns
    w = F.col("_w")
    n = F.size(w)
    m = F.greatest(n - (size - 1), F.lit(0))
    parts = [
        F.when(n >= size, F.slice(w, i + 1, m))
        .when((n > 0) & F.lit(i == 0), F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>"))
        .alias(f"s{i}")
        for i in range(size)
    ]
    zipped = F.arrays_zip(*[F.col(f"s{i}") for i in range(size)])
    return df.withColumn("_w", words(text)).select(*keep, *parts).select(*keep, F.inline_outer(zipped))


def vote_sums(hash_: Column, weight: Column, prefix: str) -> list[Column]:
    """32 sums; counter k of the low half belongs to bit k, that of the high half to bit k + 32.

    A text's weights may sum to less than 2**31, which no string that Spark can hold exceeds with weights up to one a character.
    """
    return [F.sum(F.shiftrightunsigned(hash_, k).bitwiseAND(F.lit(_LANES)) * weight).alias(f"{prefix}{k}") for k in range(32)]


def fingerprint_bits(total: Column, prefix: str) -> Column:
    """Bit set where its votes exceed half of ``total``; without any votes zero."""
    out = F.lit(0).cast("bigint")
    for k in range(32):
        lanes = F.col(f"{prefix}{k}")
        for bit, votes in ((k, lanes.bitwiseAND(F.lit(_LOW))), (k + 32, F.shiftrightunsigned(lanes, 32))):
            mask = (1 << bit) - (1 << 64) if bit == 63 else 1 << bit
            out = out.bitwiseOR(F.when(votes * 2 > total, F.lit(mask)).otherwise(F.lit(0).cast("bigint")))
    return out


def shingle_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(doc_id, text_hash, fingerprint)``: a 64-bit SimHash over XXH64 (seed 42) of lower-cased word shingles.

    Repeated rows (same id, same text) give one row; an id with several texts gives one row per text.
    Null text counts as empty; a text without words has fingerprint 0.
    """
    one = docs.select("doc_id", whole(F.col("text")).alias("_t"))
    rows = shingle_rows(one.select("doc_id", F.xxhash64("_t").alias("text_hash"), ascii_lower(F.col("_t")).alias("_l")), F.col("_l"), size)
    rows = rows.select(
        "doc_id", "text_hash", F.xxhash64(F.concat_ws(" ", *[f"s{i}" for i in range(size)])).alias("h"),
        F.when(F.col("s0").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("w"),
    )
    sums = rows.groupBy("doc_id", "text_hash").agg(F.sum("w").alias("total"), *vote_sums(F.col("h"), F.col("w"), "v"))
    return sums.select("doc_id", "text_hash", fingerprint_bits(F.col("total"), "v").alias("fingerprint"))


# --- near-duplicate classes -------------------------------------------------------------------------------------


def _ball(fp: Column, radius: int) -> Column:
    """All values within ``radius`` bits, the value itself first."""
    masks = [0]
    for r in range(1, radius + 1):
        for bits in combinations(range(64), r):
            mask = sum(1 << b for b in bits)
            masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: fp.bitwiseXOR(m))


def ball_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``fingerprint`` values to links ``(a, b)`` that join up exactly what pairs within ``radius`` bits join up.

    Meeting in the middle: two values within the radius share a variant within half of it from both. Values that
    meet on a variant are deduplicated, tied to the smallest one there and verified; that star closes to the same
    classes as all pairs would, since each of its ties is within the radius. A variant's group has no more members than a
    ball of half the radius has values (65 for radius 2), whatever the data. An odd radius ties the larger half's values
    to one within the smaller half.
    """
    near, far = radius // 2, radius - radius // 2
    parts = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes now, 65 times as many rows next
    own = fingerprints.select("fingerprint").distinct().repartition(parts, F.xxhash64("fingerprint"))
    small = own.select("fingerprint", F.explode(_ball(F.col("fingerprint"), near)).alias("variant"), F.lit(True).alias("inner"))
    met = small if near == far else small.unionByName(own.select("fingerprint", F.explode(_ball(F.col("fingerprint"), far)).alias("variant"), F.lit(False).alias("inner")))
    by = W.partitionBy("variant")
    tied = met.withColumn("a", F.min(F.when(F.col("inner"), F.col("fingerprint"))).over(by)).where("a is not null and a <> fingerprint")
    return (
        tied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("fingerprint"))) <= radius)
        .select("a", F.col("fingerprint").alias("b"))
        .distinct()
    )


def near_duplicate_classes(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """``(doc_id, text_hash, fingerprint, component_id)`` over all of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable. Equal texts share one fingerprint and so never meet as pairs. Null ids are linked as others
    but name no class unless it has no other id (then it is null). An empty table gives an empty result.
    """
    prints, _ = stored(shingle_fingerprints(docs, size), "prints")
    roots = components(ball_links(prints, radius))
    named = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = named.join(roots, named.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select("doc_id", "text_hash", "fingerprint", "component_id")


# --- fingerprints of whole texts and their edits ----------------------------------------------------------------

#: Production parameters: bits of a fingerprint, words in a term.
TERM_WORDS = 2
SEEDS = (42, 43)
#: The search: bits that likes may differ in, blocks of a fingerprint, ids that are queries, entries of a key that meet in one task.
RADIUS, BLOCKS, QUERY_EVERY, HOT_ROWS = 6, 8, 50, 4096
SALTS = 16


def _writers(spark: SparkSession) -> int:
    """Tasks that write a table of narrow rows: a sixteenth of the shuffle partitions, but two for each core.

    Hadoop's local file system starts a process for each permission that it sets, so each file costs some.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(parts, max(2 * spark.sparkContext.defaultParallelism, parts // 16))


def _keyed(docs: DataFrame) -> DataFrame:
    """``k1, k2, text``: the id as two columns without nulls, so that plain equality joins it; null text as empty."""
    return docs.select(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("k1"), F.col("doc_id").isNull().alias("k2"), whole(F.col("text")).alias("text"))


def next_keys(docs: DataFrame) -> DataFrame:
    """``(k1, k2, n1, n2)``: each distinct id and the next in descending order; after the last (null ids are last) comes the first.

    Ids are range-partitioned and numbered inside a partition; only one row per partition, its first id, meets in one task.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    falling = [F.col("k2").asc(), F.col("k1").desc()]
    at = _keyed(docs).select("k1", "k2").distinct().repartitionByRange(parts, *falling).withColumn("part", F.spark_partition_id())
    at, _ = stored(at.coalesce(_writers(docs.sparkSession)), "ids")  # ranges are sampled, so they are fixed before they are read twice
    order = W.partitionBy("part").orderBy(*falling)
    at = at.withColumn("follows", F.lead(F.struct("k1", "k2")).over(order)).withColumn("nth", F.row_number().over(order))
    heads = at.where("nth = 1").select("part", F.struct("k1", "k2").alias("head"))
    over = W.orderBy("part")  # one row per partition
    first = F.first("head").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(over), first).alias("next_head"))
    found = at.join(F.broadcast(heads), "part").select("k1", "k2", F.coalesce("follows", "next_head").alias("n"))
    return found.select("k1", "k2", F.col("n.k1").alias("n1"), F.col("n.k2").alias("n2"))


def edited_texts(docs: DataFrame) -> DataFrame:
    """``(k1, k2, n1, n2, text_hash, text, edited)``: the last third of each text replaced by the start of the next document's.

    An id with several texts lends the one whose XXH64 is smallest. The text is shuffled once, by id, and both joins read
    that exchange; what moves besides is the borrowed third. The result is partitioned by id.
    """
    one = _keyed(docs).repartition("k1", "k2")
    third = F.floor(F.char_length("text") / 3).cast("int")
    most = _keyed(docs).select("k1", "k2", third.alias("third")).groupBy("k1", "k2").agg(F.max("third").alias("most"))
    asks = most.join(next_keys(docs), ["k1", "k2"]).select(F.col("k1").alias("t1"), F.col("k2").alias("t2"), F.col("n1").alias("k1"), F.col("n2").alias("k2"), "most")
    lent = one.join(asks, ["k1", "k2"]).select("t1", "t2", "k1", "k2", F.struct(F.xxhash64("text").alias("h"), F.expr("left(text, most)").alias("start")).alias("s"))
    lent = lent.groupBy(F.col("t1").alias("k1"), F.col("t2").alias("k2"), F.col("k1").alias("n1"), F.col("k2").alias("n2")).agg(F.min("s").alias("s"))
    joined = one.join(lent, ["k1", "k2"]).withColumn("third", third)
    edited = F.concat(F.expr("left(text, char_length(text) - third)"), F.expr("left(s.start, third)"))
    return joined.select("k1", "k2", "n1", "n2", F.xxhash64("text").alias("text_hash"), "text", edited.alias("edited"))


def term_fingerprints(texts: DataFrame, keys: list[str], size: int = TERM_WORDS) -> DataFrame:
    """``keys`` and ``f0, f1`` (128 bits): SimHash over word pairs, each weighted by its length in characters.

    ``keys`` are fixed-width columns that identify a row; ``t`` is the text. If the rows are partitioned by one of the
    keys already, nothing is shuffled.
    """
    rows = shingle_rows(texts.select(*keys, F.lower("t").alias("_l")), F.col("_l"), size)
    term = [F.coalesce(F.col(f"s{i}"), F.lit("")) for i in range(size)]
    rows = rows.select(
        *keys, *[F.xxhash64(*term, F.lit(s)).alias(f"h{i}") for i, s in enumerate(SEEDS)],
        sum((F.char_length(x) for x in term[1:]), F.char_length(term[0])).cast("bigint").alias("w"),
    )
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("total"), *vote_sums(F.col("h0"), F.col("w"), "a"), *vote_sums(F.col("h1"), F.col("w"), "b"))
    return sums.select(*keys, fingerprint_bits(F.col("total"), "a").alias("f0"), fingerprint_bits(F.col("total"), "b").alias("f1"))


def differing(a: list[Column], b: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a[1:], b[1:], strict=True)), F.bit_count(a[0].bitwiseXOR(b[0])))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The cosine of the two texts' term vectors as their fingerprints tell it: cos(pi * share of differing bits), 0 at least."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(3.141592653589793) * differing(a, b) / (64.0 * len(a))))


# --- permuted block tables --------------------------------------------------------------------------------------


def block_keys(fp: list[Column], radius: int, blocks: int) -> Column:
    """One key per table: the table's number and the ``blocks - radius`` blocks it puts first. Two fingerprints within
    ``radius`` bits have at least that many equal blocks, so they share a key."""
    bits = 64 * len(fp)
    edges = [bits * i // blocks for i in range(blocks + 1)]

    def block(lo: int, hi: int) -> Column:
        parts = []
        for word in range(len(fp)):
            a, b = max(lo, 64 * word), min(hi, 64 * word + 64)
            if a < b:
                width = b - a
                mask = -1 if width == 64 else (1 << width) - 1
                parts.append(F.shiftrightunsigned(fp[word], a - 64 * word).bitwiseAND(F.lit(mask).cast("bigint")))
        return F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])

    cut = [block(edges[i], edges[i + 1]) for i in range(blocks)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[cut[i] for i in chosen], F.lit(t)).alias("key")) for t, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def find_within(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT_ROWS) -> DataFrame:
    """Pairs ``(query_f0, query_f1, f0, f1, distance)`` of distinct fingerprints within ``radius`` bits, each once.

    Both inputs have ``f0, f1``; equal fingerprints are merged first, so groups of copies count once. Exact: see
    ``block_keys``. With 128 bits, 8 blocks and radius 6 each of the 28 tables has 32-bit keys. Of the index only entries whose key is asked for
    go on; a key with more than ``hot`` of them is split, and its queries meet every part.
    """
    cols = [F.col("f0"), F.col("f1")]
    tables = F.explode(block_keys(cols, radius, blocks)).alias("k")
    writers = _writers(index.sparkSession)
    ask = queries.select("f0", "f1").distinct().coalesce(writers).select(F.col("f0").alias("query_f0"), F.col("f1").alias("query_f1"), tables).select("query_f0", "query_f1", "k.table", "k.key")
    ask, _ = stored(ask, "asked")
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = index.select("f0", "f1").distinct().repartition(parts, F.xxhash64("f0", "f1")).select("f0", "f1", tables).select("f0", "f1", "k.table", "k.key").join(ask.select("table", "key").distinct(), ["table", "key"], "left_semi")
    own, _ = stored(own.repartition(writers), "entries")
    large = own.groupBy("table", "key").agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select("table", "key", F.ceil(F.col("_n") / hot).cast("bigint").alias("_parts"))
    large, _ = stored(large, "large")
    parts = F.coalesce("_parts", F.lit(1).cast("bigint"))
    own = own.join(large, ["table", "key"], "left").withColumn("_part", F.pmod(F.xxhash64("f0", "f1"), parts)).drop("_parts")
    ask = ask.join(large, ["table", "key"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1))).drop("_parts")
    apart = differing([F.col("query_f0"), F.col("query_f1")], cols)
    return ask.join(own, ["table", "key", "_part"]).where(apart <= radius).select("query_f0", "query_f1", "f0", "f1", apart.alias("distance")).distinct()


# --- the documents ----------------------------------------------------------------------------------------------


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness and that to the next document, and the search for likes.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within, nearest_bits``. The last two hold
    for ids divisible by QUERY_EVERY, else null: how many other fingerprints of the table are within RADIUS bits, by the block tables, and the
    least distance of one (null for none). Null text counts
    as empty (fingerprint zero); repeated rows give one row; extra columns are ignored; an empty table gives no rows.
    """
    texts = edited_texts(docs).withColumn("_sha", F.sha2("edited", 256))
    quarter = [F.conv(F.substring("_sha", 16 * i + 1, 16), 16, -10).cast("bigint").alias(f"q{i}") for i in range(4)]
    keys = ["k1", "k2", "n1", "n2", "text_hash", "n_chars", "q0", "q1", "q2", "q3"]
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("t")) for k, c in enumerate(("text", "edited"))])
    texts = texts.select("k1", "k2", "n1", "n2", "text_hash", F.char_length("text").cast("bigint").alias("n_chars"), *quarter, F.inline(both))
    prints = term_fingerprints(texts, [*keys, "kind"])
    pick = [F.max(F.when(F.col("kind") == k, F.col(f"f{i}"))).alias(f"{n}{i}") for k, n in ((0, "f"), (1, "e")) for i in range(2)]
    writers = _writers(docs.sparkSession)
    prints, _ = stored(prints.groupBy(*keys).agg(*pick).repartition(writers), "prints")  # without the texts: dealing them out moves little
    lead = prints.groupBy(F.col("k1").alias("n1"), F.col("k2").alias("n2")).agg(F.min(F.struct("text_hash", "f0", "f1")).alias("n"))
    f, e, n = ([F.col(f"{x}{i}") for i in range(2)] for x in ("f", "e", "n.f"))
    out = prints.join(lead, ["n1", "n2"])
    asks = ~F.col("k2") & (F.col("k1") % QUERY_EVERY == 0)
    found = find_within(prints.where(asks), prints).where("distance > 0 or f0 <> query_f0 or f1 <> query_f1")
    near = found.groupBy(F.col("query_f0").alias("f0"), F.col("query_f1").alias("f1")).agg(F.count("*").alias("n_within"), F.min("distance").cast("int").alias("nearest_bits"))
    # copies share a fingerprint, so what was found is dealt out SALTS times
    salted = near.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    asked = out.where(asks).withColumn("_s", F.pmod(F.xxhash64("k1"), F.lit(SALTS))).join(salted, ["f0", "f1", "_s"], "left").withColumn("n_within", F.coalesce("n_within", F.lit(0).cast("bigint")))
    others = out.where(~asks).withColumns({"n_within": F.lit(None).cast("bigint"), "nearest_bits": F.lit(None).cast("int")})
    result = [
        F.when(~F.col("k2"), F.col("k1")).alias("doc_id"), "n_chars", F.concat(*[hex16(F.col(f"q{i}")) for i in range(4)]).alias("edited_sha256"),
        F.concat(*map(hex16, f)).alias("fingerprint"), F.concat(*map(hex16, e)).alias("edited_fingerprint"), likeness(f, e).alias("near_edited"), likeness(f, n).alias("near_next"), "n_within", "nearest_bits",
    ]
    return others.select(*result).unionByName(asked.select(*result)).coalesce(writers)
