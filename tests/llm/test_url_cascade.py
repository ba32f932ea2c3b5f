import random

from pyspark.sql import functions as F

from seriata.llm import url_cascade as U


def test_hosts_paths_rules(spark):
    rows = [
        (1, "HTTPS://A.Example.COM/en/78?x#y"), (2, "http://x.com/en/1"), (3, "http://example.net/de/81"), (4, "http://q.example.net/de/9"),
        (5, None), (6, "no scheme"), (7, "http://org"), (8, "http://ÉX.org/es/#f"), (9, "http://www.cheap-pills.example.com/fr/1"),
        (10, "http://notcheap-pills.example.com/fr/1"), (11, "a://b://c.com/en/"), (12, "http:///en/"), (12, "http:///en/"),
        (None, "http://free-bets.example.com"), (13, "http://com"), (14, "http://xcom/en/"), (15, "http://e.com?/en/"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, host string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df).collect()), key=str)
    want = [
        (1, "a.example.com", "/en/78", "example.com/en/7", "allow"), (2, "x.com", "/en/1", "com/en/", "block"), (3, "example.net", "/de/81", "example.net/de/8", "block"),
        (4, "q.example.net", "/de/9", "net/de/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"), (7, "org", "", None, "allow"),
        (8, "Éx.org", "/es/", "org/es/", "block"), (9, "www.cheap-pills.example.com", "/fr/1", None, "block"), (10, "notcheap-pills.example.com", "/fr/1", None, "allow"),
        (11, "b:", "//c.com/en/", None, "allow"), (12, "", "/en/", None, "allow"), (12, "", "/en/", None, "allow"), (0, "free-bets.example.com", "", None, "block"),
        (13, "com", "", None, "allow"), (14, "xcom", "/en/", None, "allow"), (15, "e.com", "", None, "allow"),
    ]
    assert got == sorted(want, key=str)


def test_empty_pages(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    rng = random.Random(1)
    keys = [f"k{rng.getrandbits(40):x}" for _ in range(6000)]
    listed = set(keys[:1500])
    universe = spark.createDataFrame([(k, k in listed) for k in keys], "key string, listed boolean")
    for segment_bytes in (1 << 20, 1000):
        cascade = U.build_cascade(universe, segment_bytes)
        assert len(cascade.levels) >= 2 and (cascade.shapes[0][0] > 1) == (segment_bytes == 1000)
        assert {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()} == listed


def test_a_long_list_takes_several_passes(spark):
    rows = spark.createDataFrame([(i, f"h{i % 50}.example.com") for i in range(200)], "i long, host string")
    listed = spark.createDataFrame([(f"h{i}.example.com",) for i in range(0, 50, 3)] + [("elsewhere",), (None,)], "key string")
    for most in (9, 1 << 20):
        flags = U.listed_flags(rows, "host", listed, most)
        assert {(r.i, r.listed) for r in flags.collect()} == {(i, (i % 50) % 3 == 0) for i in range(200)}


def test_a_list_of_production_size(spark):
    listed = spark.range(300_000).select(F.concat(F.lit("bad"), F.col("id"), F.lit(".example.org")).alias("key"))
    hosts = spark.range(0, 600_000, 7).select("id", F.concat(F.lit("www.bad"), F.col("id"), F.lit(".example.org")).alias("host"))
    flags = U.listed_flags(hosts, "host", listed)
    assert "Join" not in flags._jdf.queryExecution().executedPlan().toString()
    got = flags.groupBy("listed", (F.col("id") < 300_000).alias("low")).count().collect()
    assert {(r.listed, r.low) for r in got} == {(True, True), (False, False)}


def test_nothing_listed(spark):
    rows = spark.createDataFrame([(1, "a.b")], "i long, host string")
    got = U.listed_flags(rows, "host", spark.createDataFrame([("z",)], "key string")).first()
    assert got.listed is False
