"""Each stage of the pipeline against a plain version, over all that the stage before kept."""

import re
from collections import defaultdict

import pandas as pd
import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline as P
from seriata.llm import packing, secrets

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def first_of_classes(docs):
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    prints = {i: fingerprint(t) for i, t in docs.items()}
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in docs}


def redacted(text):
    out, at = "", 0
    for a, b, _ in secrets.find_spans(text, public_tokenizers.path(secrets.VOCABULARY)):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def base_failed(text):
    w = words(text)
    at = defaultdict(list)
    for k in range(len(w) - 2):
        at[tuple(w[k : k + 3])].append(k)
    again = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.toPandas()
        assert name == "packing" or docs.columns == P.COLUMNS
    before = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    kept = seen["quality_rules"].set_index("doc_id")
    assert set(kept.index) <= {i for i, t in before.text.items() if not base_failed(t)}
    labels = pd.read_parquet(f"{SF}/labels.parquet").set_index("doc_id").quality
    assert all(i in kept.index for i in labels[labels == 1].index if not base_failed(before.text[i]))
    near = seen["simhash_near_dedup"].set_index("doc_id")
    assert set(near.index) == first_of_classes(kept.text.to_dict())
    scanned = seen["secret_scan"].set_index("doc_id")
    assert scanned.text.to_dict() == {i: redacted(t) for i, t in near.text.items()}
    mixed = seen["source_mixing"].set_index("doc_id")
    assert mixed.sort_index().equals(scanned.sort_index())
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    sizes = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in mixed.text.items()}
    pieces = seen["packing"]
    assert pieces.groupby("doc_id").length.sum().to_dict() == sizes
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.SEQUENCE


def test_sequences_follow_the_schedule(spark, tmp_path):
    made = spark.range(6000).selectExpr("id as doc_id", "concat('some words of document ', id) as text", "'en' as lang", "if(id % 3 = 0, 'a', concat('b', id % 2)) as source", "30L as n_chars")
    P.source_mixing(spark, made, "").write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    P.sequence_packing(spark, mixed, "").write.parquet(f"{tmp_path}/packed")
    pieces = pd.read_parquet(f"{tmp_path}/packed")
    order = P.mixing.schedule(made).toPandas().sort_values("position").doc_id.tolist()
    place = {d: k // packing.STRETCH for k, d in enumerate(order)}
    assert (pieces.sequence_id // 2**32 == pieces.doc_id.map(place)).all() and pieces.doc_id.nunique() == 6000
    again = P.sequence_packing(spark, mixed, "").toPandas()
    key = ["sequence_id", "offset"]
    assert again.sort_values(key).reset_index(drop=True).equals(pieces.sort_values(key).reset_index(drop=True))
