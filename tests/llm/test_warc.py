import base64
import gzip
import hashlib
import random
import tracemalloc
from pathlib import Path

from seriata.llm import warc
from seriata.llm.queries import op8_warc

BIG = "<p>" + "x" * 1200 + "</p>"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, "http://a/7", BIG), (3, None, "<b>short</b>"), (4, "http://a/4", "<b>short</b>"), (5, "http://a/\r\nX: y", None),
    (6, "http://a/6", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50), (None, "http://a/n", BIG), (8, "http://a/8", "é" * 500), (9, "u", "é" * 500), (9, "u", "é" * 500), (10, "", "\r\n\r\n" * 400),
]


def expected(pages):
    best = {}
    for i, _, h in pages:
        if h and len(h.encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in pages:
        raw = (h or "").encode()
        old = h in best and (i is None or i < best[h])
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if old else "response", best[h] if old else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_table):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in op8_warc(spark, tmp_table(pages=df)).collect()), key=str)
    assert got == expected(PAGES)


def test_round_trip_of_long_headers(spark, tmp_table):
    pages = [(1, "http://a/" + "u" * (3 << 20), BIG), (2, "http://a/2", "<b>short</b>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    got = sorted((tuple(r) for r in op8_warc(spark, tmp_table(pages=df)).collect()), key=str)
    assert got == expected(pages)


def test_round_trip_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in op8_warc(spark, sf).collect()), key=str) == expected(pages)


def test_digests_beyond_the_bound_are_joined(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/a", max_sent=0, archive_bytes=3000)
    rows = warc.read_archives(spark, f"{tmp_path}/a", with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(PAGES)
    assert {r.payload for r in rows if r.page_id == 9} == {"é" * 500}
    assert len(list(Path(f"{tmp_path}/a").glob("*.txt"))) > 1


def test_empty(spark, tmp_table):
    assert op8_warc(spark, tmp_table(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def archive(spark, tmp_path):
    warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w")
    return next(Path(f"{tmp_path}/w").glob("*.txt")).read_bytes()


def test_salvage_of_damaged_bytes(spark, tmp_path):
    data = archive(spark, tmp_path)
    whole = list(warc.salvage(data))
    assert len(whole) == len(PAGES) and not any(isinstance(x, warc.Gap) for x in whole)
    rng = random.Random(4)
    for _ in range(40):
        hurt = rng.randrange(len(whole))
        r = whole[hurt]
        at = rng.randrange(r.start, r.end)
        broken = data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :]
        if rng.random() < 0.3:
            broken = data[:at] + data[at + 1 :]
        found = list(warc.salvage(broken))
        assert sum(x.end - x.start for x in found) == len(broken) and [x.start for x in found[1:]] == [x.end for x in found[:-1]]
        blocks = [x.block for x in found if isinstance(x, warc.Record)]
        assert blocks == [x.block for k, x in enumerate(whole) if k != hurt] or blocks == [x.block for x in whole]
    for cut in (b"", b"junk", data[:50]):
        assert all(isinstance(x, warc.Gap) for x in warc.salvage(cut))
    assert len([x for x in warc.salvage(b"\0\0noise" + data[:-3]) if isinstance(x, warc.Record)]) == len(PAGES) - 1


def test_salvage_of_gzip_members(spark, tmp_path):
    whole = [x for x in warc.salvage(archive(spark, tmp_path))]
    data = archive(spark, f"{tmp_path}/again")
    members = [gzip.compress(data[x.start : x.end]) for x in whole]
    packed = b"".join(members)
    assert [x.block for x in warc.salvage(packed)] == [x.block for x in whole]
    at = len(members[0]) + len(members[1]) // 2
    found = list(warc.salvage(packed[:at] + b"\xff" + packed[at + 1 :]))
    assert [x.block for x in found if isinstance(x, warc.Record)] == [x.block for k, x in enumerate(whole) if k != 1]
    assert [(x.start, x.end) for x in found if isinstance(x, warc.Gap)] == [(len(members[0]), len(members[0]) + len(members[1]))]


def record(kind, body, *, block=None, payload=None, http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"):
    whole = http + body
    more = b"".join(b"%s: %s\r\n" % (n, v) for n, v in ((b"WARC-Block-Digest", block and block(whole)), (b"WARC-Payload-Digest", payload and payload(body))) if v)
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:1>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, more, len(whole), whole)


def hexed(data):
    return b"sha1:" + hashlib.sha1(data).hexdigest().encode()


def base32(data):
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def test_records_of_other_writers():
    bodies = [b"plain", b"line\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nembedded\r\n\r\n", b"\r\n\r\n" * 9]
    for block in (None, hexed, base32, lambda d: b"blake3:" + b"0" * 64):
        for payload in (None, hexed, base32):
            made = [record(kind, b, block=block, payload=payload) for b in bodies for kind in (b"response", b"resource")]
            for data in (b"".join(made), b"".join(map(gzip.compress, made))):
                found = list(warc.salvage(data))
                assert [x.block.partition(b"\r\n\r\n")[2] for x in found] == [b for b in bodies for _ in range(2)]
    wrong = record(b"response", b"abc", payload=lambda d: hexed(d + b"x"))
    assert isinstance(next(iter(warc.salvage(wrong))), warc.Gap)
    chunked = record(b"response", b"3\r\nabc\r\n0\r\n\r\n", payload=lambda d: hexed(b"abc"), http=b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n")
    assert isinstance(next(iter(warc.salvage(chunked))), warc.Record)


def test_members_are_inflated_no_further_than_they_say():
    lying = record(b"response", b"x").replace(b"\r\n\r\nHTTP", b"\r\n\r\n" + b"\0" * (64 << 20) + b"HTTP", 1)
    tracemalloc.start()
    found = list(warc.salvage(gzip.compress(lying) + gzip.compress(record(b"response", b"next"))))
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()
    assert [type(x) for x in found] == [warc.Gap, warc.Record] and found[1].block.endswith(b"next")


def test_archives_stay_below_their_size(spark, tmp_path):
    df = spark.range(400).selectExpr("id as page_id", "'http://a' as url", "repeat(char(97 + id % 26), if(id % 100 = 0, 90000, cast(id * 30 as int))) as html")
    warc.write_archives(df.coalesce(1), f"{tmp_path}/a", archive_bytes=200_000)
    sizes = [p.stat().st_size for p in Path(f"{tmp_path}/a").glob("*.txt")]
    assert max(sizes) < 300_000 and len(sizes) < 120
    assert warc.read_archives(spark, f"{tmp_path}/a").where("not gap").count() == 400
