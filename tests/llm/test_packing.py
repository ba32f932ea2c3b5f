import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriata.llm import packing
from seriata.llm.queries import op6_packing

SF = "/root/testdata/sf0.001"


def slow_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    return [[*e.ids, 1] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_first_fit_decreasing_against_a_plain_scan():
    rng = random.Random(2)
    for _ in range(30):
        sizes = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 80))), reverse=True)
        room, want = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            if b == len(room):
                room.append(100)
            room[b] -= s
            want.append(b)
        assert packing.first_fit_decreasing(sizes, 100) == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_holds_every_id_once(lengths):
    seen = defaultdict(list)
    bins = packing.pack(lengths, 64, 4)
    for b in bins:
        assert 0 < sum(p[2] for p in b) <= 64
        for i, s, n in b:
            seen[i] += range(s, s + n)
    assert {i: sorted(x) for i, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(lengths)}
    assert sum(sum(p[2] for p in b) < 64 - 4 for b in bins) <= 1


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aAzZsStTéÉßÿÖ×ñ0129'’.,-_<|>\t\n\x1c \x85\xa0²ªµ́İΣς€…", max_size=40), st.lists(st.sampled_from(["'s", "'re", "x", ".", "<|endoftext|>", " ", "É", "don't", "ll"])).map("".join)))
def test_words_give_the_ids_of_the_whole_text(text):
    own = packing.tokenizer_at(public_tokenizers.path(packing.TOKENIZER)).encode(text)
    assert [*own.tolist(), 1] == slow_ids([text])[0]


def check(rows, docs):
    ids = dict(zip([d for d, _ in docs], slow_ids([t or "" for _, t in docs]), strict=True))
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, pieces in parts.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p.length for p in pieces) == len(ids[d])
    assert parts.keys() == ids.keys()
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))]
        assert sum(p.length for p in s) <= 2048
    return sum(2048 - sum(p.length for p in s) for s in sequences.values()) / sum(map(len, ids.values()))


def test_op6_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check(op6_packing(spark, SF).collect(), docs) < 0.05


def test_edges(spark, edge_docs, empty_docs):
    assert packing.pack_documents(empty_docs).count() == 0
    rows = packing.pack_documents(edge_docs.dropDuplicates(["doc_id"]), with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in edge_docs.dropDuplicates(["doc_id"]).collect()])
    assert all(len(r.ids) == r.length for r in rows)
    twice = packing.pack_documents(edge_docs.where("doc_id = 9")).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens
    small = packing.pack_documents(edge_docs, group_ids=50).collect()
    assert sum(r.length for r in small) == sum(r.length for r in packing.pack_documents(edge_docs).collect())


def test_arrival_order_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = [sorted(packing.pack_documents(d, group_ids=50_000).collect()) for d in (docs, docs.orderBy(F.rand(1)), docs.repartition(13))]
    assert made[0] == made[1] == made[2]


def test_a_tokenizer_that_splits_otherwise_reads_whole_texts(monkeypatch):
    path, text = public_tokenizers.path(packing.TOKENIZER), "Don't split 12 words, É!"
    assert packing.WordTokenizer(path).by_units
    monkeypatch.setattr(packing, "_NORMALIZER", {})
    other = packing.WordTokenizer(path)
    assert not other.by_units and [*other.encode(text).tolist(), 1] == slow_ids([text])[0]
