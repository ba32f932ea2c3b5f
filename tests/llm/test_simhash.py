import hashlib
import random
import re
import string

import xxhash
from pyspark.sql import functions as F

from seriata.llm import simhash
from seriata.llm.components import components
from seriata.llm.queries import op2_document_fingerprints, op5_simhash_near_dedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def slow_print(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows):
    prints = {i: slow_print(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def test_op5_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash_near_dedup(spark, SF).collect()}
    assert got == slow_classes(docs)


def test_op5_edge_rows(edge_docs):
    got = {r.doc_id: r for r in simhash.near_duplicate_classes(edge_docs).collect()}
    assert len(got) == 11 and got[1].fingerprint == got[2].fingerprint == got[3].fingerprint
    assert got[3].component_id == 1 and got[4].component_id == got[5].component_id == got[8].component_id == 4
    assert got[None].component_id is None
    for i, text in ((6, "one"), (7, "zwei Wörter ÄÖÜ"), (12, "word " * 30000)):
        assert got[i].fingerprint % (1 << 64) == slow_print(text)


def test_empty_tables(empty_docs):
    assert simhash.near_duplicate_classes(empty_docs).count() == 0
    assert simhash.fingerprint_documents(empty_docs).count() == 0


def test_ball_links_close_to_the_same_classes(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set(base)
    for b in base:
        for _ in range(25):
            for _ in range(rng.randint(1, 3)):
                b ^= 1 << rng.randrange(64)
            values.add(b)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    for radius in (1, 2, 3):
        links = simhash.ball_links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), radius)
        got = {r.node: r.root for r in components(links).collect()}
        parent = {v: v for v in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in signed:
            for b in signed:
                if a < b and bin((a ^ b) % (1 << 64)).count("1") <= radius:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        assert {v: got.get(v, v) for v in signed} == {v: find(v) for v in signed}


def test_components_of_a_long_chain(spark):
    links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links.union(spark.createDataFrame([(900, 900), (700, 701)], "a long, b long"))).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(301)}, 700: 700, 701: 700}


def test_op2_texts_and_likeness(spark):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op2_document_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        n = len(t) // 3
        nxt = docs[(k + 1) % len(docs)]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - n] + nxt[1][:n]).encode()).hexdigest()
        apart = bin(int(got[i].fingerprint, 16) ^ int(got[nxt[0]].fingerprint, 16)).count("1")
        assert abs(got[i].near_next - simhash_likeness(apart)) < 1e-12
    rows = list(got.values())
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5 > 0.2 > sum(r.near_next for r in rows) / len(rows)


def simhash_likeness(apart):
    import math

    return max(0.0, math.cos(math.pi * apart / 128))


def test_op2_edge_rows(edge_docs):
    got = {r.doc_id: r for r in simhash.fingerprint_documents(edge_docs).collect()}
    assert len(got) == 11
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint
    assert got[5].n_chars == 0 and got[5].fingerprint == "0" * 32
    tail = "a row without an id has some words too"
    assert got[1].edited_sha256 == hashlib.sha256((TEXT1[: len(TEXT1) - len(TEXT1) // 3] + tail[: len(TEXT1) // 3]).encode()).hexdigest()
    assert got[None].edited_sha256 == hashlib.sha256((tail[: len(tail) - len(tail) // 3] + ("word " * 30)[: len(tail) // 3]).encode()).hexdigest()


TEXT1 = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today"


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(3)
    values = []
    for _ in range(8):
        b = rng.getrandbits(128)
        values += [b ^ sum(1 << x for x in rng.sample(range(128), k)) for k in (0, 1, 3, 5, 6, 7, 9)]
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(sign(v >> 64), sign(v % (1 << 64))) for v in values], "f0 long, f1 long")
    got, split = ([((r.query_f0, r.query_f1), (r.f0, r.f1), r.distance) for r in simhash.find_within(df, df, 6, 8, hot).collect()] for hot in (4096, 2))
    assert len(got) == len(set(got)) and sorted(got) == sorted(split)
    got, want = set(got), set()
    for a in values:
        for b in values:
            d = bin(a ^ b).count("1")
            if d <= 6:
                want.add(((sign(a >> 64), sign(a % (1 << 64))), (sign(b >> 64), sign(b % (1 << 64))), d))
    assert got == want


def slow_terms(text):
    """128 bits over word pairs, hashed as chained XXH64 of both words and a seed, weighted by their characters."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    pairs = [(w[i], w[i + 1]) for i in range(len(w) - 1)] if len(w) > 1 else [(w[0] if w else "", "")]
    total, votes = sum(len(a) + len(b) for a, b in pairs), [0] * 128
    for a, b in pairs:
        for k, seed in enumerate((42, 43)):
            h = 42
            for part in (a.encode(), b.encode(), seed.to_bytes(4, "little")):
                h = xxhash.xxh64_intdigest(part, seed=h)
            for bit in range(64):
                votes[64 * k + bit] += (h >> bit & 1) * (len(a) + len(b))
    f = [sum(1 << bit for bit in range(64) if 2 * votes[64 * k + bit] > total) for k in range(2)]
    return f"{f[0]:016x}{f[1]:016x}"


def test_op2_fingerprints_and_search_against_brute_force(spark, tmp_table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    near = docs.where("doc_id % 50 in (0, 1)").select((F.col("doc_id") * 2 + 100_000).alias("doc_id"), F.concat("text", F.lit(" and a last word")).alias("text"), "lang", "source", "n_chars")
    rows = docs.unionByName(near)
    got = {r.doc_id: r for r in op2_document_fingerprints(spark, tmp_table(documents=rows)).collect()}
    texts = sorted(((r.doc_id, r.text) for r in rows.collect()), reverse=True)
    assert len(got) == len(texts)
    for k, (i, t) in enumerate(texts):
        n, nxt = len(t) // 3, texts[(k + 1) % len(texts)][1]
        assert got[i].fingerprint == slow_terms(t) and got[i].edited_fingerprint == slow_terms(t[: len(t) - n] + nxt[:n])
        apart = bin(int(got[i].fingerprint, 16) ^ int(got[i].edited_fingerprint, 16)).count("1")
        assert abs(got[i].near_edited - simhash_likeness(apart)) < 1e-12
    prints = {int(r.fingerprint, 16) for r in got.values()}
    hits = 0
    for i, r in got.items():
        if i % 50:
            assert r.n_within is None and r.nearest_bits is None
            continue
        gaps = [d for p in prints if 0 < (d := bin(int(r.fingerprint, 16) ^ p).count("1")) <= 6]
        assert (r.n_within, r.nearest_bits) == (len(gaps), min(gaps, default=None))
        hits += len(gaps)
    assert hits


def test_op2_writes_few_files_and_the_same_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, simhash.fingerprint_documents(docs).collect()))
    files, write = {}, simhash.stored

    def counted(df, name):
        out, path = write(df, name)
        files[name] = len(out.inputFiles())
        return out, path

    monkeypatch.setattr(simhash, "stored", counted)
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        out = simhash.fingerprint_documents(docs)
        parts = out.rdd.getNumPartitions()
        got = sorted(map(tuple, out.collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(got) == docs.count()
    assert {"ids", "asked", "entries", "prints"} <= set(files)
    few = 2 * spark.sparkContext.defaultParallelism
    assert max(files.values()) <= few and parts <= few
