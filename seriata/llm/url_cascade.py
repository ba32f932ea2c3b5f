"""URL filter: exact list membership by a cascade of Bloom filters, without joins.

The universe is every key that the corpus holds (hosts and parent domains). Level 0 encodes the listed keys;
level 1 the universe's keys that level 0 takes wrongly; level 2 the listed keys that level 1 takes wrongly, and so on
until a level takes none wrongly. A key's answer is the parity of the first level that doesn't hold it. As the levels were
built over the complete universe, this is exact for every key of the corpus.
"""

from __future__ import annotations

import string
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

#: Registered domains (with all their subdomains) that the production filter blocks.
BLOCKED_HOSTS = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.org", "ads-track.example.org", "free-bets.example.com")
#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with the rule's; the longest wins.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BITS_PER_KEY = 12
HASHES = 5
#: A segment of a filter is put together by one task. What a pass over the rows carries along is at most about PASS_BYTES (45 million listed keys).
SEGMENT_BYTES, PASS_BYTES = 16 << 20, 64 << 20
MAX_LEVELS = 64


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty for null or without ``://``."""
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def domains(host: Column, labels: list[int]) -> list[Column]:
    """The host's last so many labels, for each number in ``labels``; the host itself where it has fewer."""
    return [F.substring_index(host, ".", -n) for n in labels]


@dataclass
class Cascade:
    """Level ``i`` is a one-row table of an array of segments, each an array of 64-bit words.

    A key goes to one word by its hash and sets HASHES bits in it. Rows read the arrays by scalar subqueries: no plan text, no row and
    no driver holds a filter.
    """

    levels: list[DataFrame] = field(default_factory=list)
    shapes: list[tuple[int, int]] = field(default_factory=list)  #: segments of a level, words of a segment

    def bytes(self) -> int:
        return sum(8 * segments * words for segments, words in self.shapes)

    def might_hold(self, key: Column, level: int) -> Column:
        at, word, bits = _place(key, *self.shapes[level], level)
        return F.get(F.get(self.levels[level].scalar(), at), word).bitwiseAND(bits) == bits

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.might_hold(key, i), out).otherwise(F.lit(i % 2 == 1))
        return out


def _place(key: Column, segments: int, words: int, level: int) -> tuple[Column, Column, Column]:
    """The key's segment, its word there, and its bits in the word, each from a hash of its own."""
    at = F.pmod(F.xxhash64(F.lit("segment"), key, F.lit(level)), F.lit(segments)).cast("int") if segments > 1 else F.lit(0)
    word = F.pmod(F.xxhash64(F.lit("word"), key, F.lit(level)), F.lit(words)).cast("int")
    h, bits = F.xxhash64(key, F.lit(level)), F.lit(0).cast("bigint")
    for j in range(HASHES):
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")))
    return at, word, bits


def _encode(keys: DataFrame, segments: int, words: int, level: int) -> DataFrame:
    """The level's one row. Bits are set and each segment is put together by the executors."""
    at, word, bits = _place(F.col("key"), segments, words, level)
    ones = keys.select(at.alias("segment"), word.alias("word"), bits.alias("bits"))
    every = keys.sparkSession.range(segments * words).select(F.floor(F.col("id") / words).cast("int").alias("segment"), (F.col("id") % words).cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    whole = ones.unionByName(every).groupBy("segment", "word").agg(F.bit_or("bits").alias("bits"))
    parts = whole.groupBy("segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    one = parts.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "words"))), lambda x: x["words"]).alias("words"))
    return stored(one, "filter")[0]


def build_cascade(keys: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> Cascade:
    """``keys(key, listed)``: the whole universe, each key once."""
    cascade = Cascade()
    for level in range(MAX_LEVELS):
        # level i encodes the keys of its side that all levels of the other side below it take
        own = keys.where(F.col("listed") == F.lit(level % 2 == 0))
        for below in range(level - 1, -1, -2):
            own = own.where(cascade.might_hold(F.col("key"), below))
        count = own.count()
        if not count:
            return cascade
        size = -(-count * BITS_PER_KEY // 64)
        segments = -(-8 * size // segment_bytes)
        words = -(-size // segments)
        cascade.levels.append(_encode(own, segments, words, level))
        cascade.shapes.append((segments, words))
    raise RuntimeError("the cascade doesn't end: keys of both sides share all hashes")


def listed_flags(rows: DataFrame, host: str, listed: DataFrame, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``rows`` with a boolean ``listed``: whether the column ``host`` or one of its parent domains is in ``listed(key)``, without joins on the rows.

    Of a host's parents only those with as many labels as some listed key are asked for, so these, over all rows, are the universe. A list
    whose first level would exceed ``pass_bytes`` is split by a hash of the key; each part has a cascade of its own, and the rows
    pass one after another.
    """
    listed = listed.where("key is not null and key <> ''").select("key").distinct().withColumn("listed", F.lit(True))
    rows = rows.withColumn("listed", F.lit(False))
    # one row per number of labels comes to the driver
    labels = sorted(r.n for r in listed.select(F.size(F.split("key", r"\.", -1)).alias("n")).distinct().collect())
    if not labels:
        return rows
    keys = domains(F.col(host), labels)
    universe = rows.select(F.explode(F.array(*keys)).alias("key")).where("key is not null").distinct()
    universe, _ = stored(universe.join(listed, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    parts = max(1, -(-universe.where("listed").count() * BITS_PER_KEY // (8 * pass_bytes)))
    part = lambda key: F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))
    for k in range(parts):
        cascade = build_cascade(universe if parts == 1 else universe.where(part(F.col("key")) == k))
        hit = F.col("listed")
        for key in keys:
            hit = hit | (cascade.holds(key) if parts == 1 else (part(key) == k) & cascade.holds(key))
        rows = rows.withColumn("listed", F.coalesce(hit, F.lit(False)))
        if k + 1 < parts:
            rows, _ = stored(rows, "flags")
    return rows


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls. Of rules equally long, the longer host, then block wins."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in reversed(ranked):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: tuple = RULES, blocked: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages(page_id, url)``.

    The longest fitting rule decides; without one, a host with a listed host or parent domain is blocked, any other allowed.
    Null urls and urls without ``://`` have empty host and path and are allowed. Repeated rows stay; extra columns are ignored;
    an empty table gives no rows. The result is exact for whatever the corpus holds.
    """
    spark: SparkSession = pages.sparkSession
    if blocked is None:
        blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "key string")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = listed_flags(rows, "host", blocked)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
