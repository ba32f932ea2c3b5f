import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriata.llm import quality as Q
from seriata.llm.queries import op7_quality_rules

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), len(re.findall("[A-Z!]", text))


def slow_failed(s):
    return s[0] < 50 or 100 * s[5] > 50 * s[0]


def slow_features(s):
    n, chars, symbols, lines, dup, rep, shouts = s
    sh = lambda a, b, c: np.arcsin(np.sqrt(min(1.0, a / (b + c))))
    return np.array([np.log((chars + 1) / (n + 1)), sh(symbols, chars, 50), sh(dup, lines, 5), sh(rep, n, 50), sh(shouts, chars, 50)])


def slow_fit(x):
    """The same starts and concentration steps in NumPy, for one group."""
    floor = np.diag(np.array(list(Q.FEATURES.values())) ** 2)

    def quantile(b, share):
        b = np.sort(b)
        return b[int(np.ceil(len(b) * share)) - 1]

    def dist(m, c):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def step(m, c):
        b = np.floor(np.log(dist(m, c) + 1e-9) * 32)
        y = x[b <= quantile(b, Q.H)]
        return y.mean(0), np.cov(y.T, bias=True) * Q.consistency(Q.H, 5) + floor

    med = np.array([quantile(np.floor(v * 256), 0.5) for v in x.T])
    mad = np.array([quantile(np.floor(np.abs(v * 256 - k - 0.5)), 0.5) for v, k in zip(x.T, med, strict=True)])
    center, d = (med + 0.5) / 256, np.sqrt((mad / 256 * 1.4826) ** 2 + np.diag(floor))
    z = (x - center) / d
    squashed, turned = np.tanh(z), z / np.sqrt(np.maximum((z * z).sum(1), 1e-12))[:, None]
    made = []
    for a in (None, squashed, turned):
        r = np.eye(5)
        if a is not None:
            s = a.T @ a / len(a)
            r = 0.99 * s / np.sqrt(np.maximum(np.outer(np.diag(s), np.diag(s)), 1e-12))
            np.fill_diagonal(r, 1)
        m, c = center, r * np.outer(d, d)
        for _ in range(Q.FIRST_STEPS):
            m, c = step(m, c)
        made.append((round(np.linalg.slogdet(c)[1], 9), len(made), m, c))
    _, _, m, c = min(made, key=lambda v: v[:2])
    for _ in range(Q.STEPS):
        m, c = step(m, c)
    y = x[dist(m, c) <= Q.chi2_quantile(0.975, 5)]
    m, c = y.mean(0), np.cov(y.T, bias=True) * Q.consistency(0.975, 5) + floor
    return lambda v: float((v - m) @ np.linalg.inv(c) @ (v - m))


def test_chi_square():
    assert abs(Q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(Q.chi2_cdf(25.745, 5) - 0.9999) < 1e-6


def test_op7_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    stats = {d.doc_id: slow_statistics(d.text) for d in docs}
    got = {r.doc_id: r for r in op7_quality_rules(spark, SF).collect()}
    groups = {}
    for d in docs:
        if not slow_failed(stats[d.doc_id]):
            for g in ((d.lang, d.source), (d.lang,), ()):
                groups.setdefault(g, []).append(slow_features(stats[d.doc_id]))
    fits = {g: slow_fit(np.array(x)) for g, x in groups.items() if len(x) >= Q.MIN_GROUP}
    cut = Q.chi2_quantile(Q.KEEP, 5)
    rejected = 0
    for d in docs:
        s, r = stats[d.doc_id], got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (s[0], s[1], s[2], s[4], s[5])
        assert r.base_failed == slow_failed(s)
        if not r.base_failed:
            fit = next(fits[g] for g in ((d.lang, d.source), (d.lang,), ()) if g in fits)
            v = fit(slow_features(s))
            if abs(v - cut) > 1e-3 * cut:
                assert r.kept == (v <= cut), (d.doc_id, v)
            rejected += not r.kept
        else:
            assert not r.kept
    assert rejected > 10


def test_labels(spark):
    good = spark.read.parquet(f"{SF}/labels.parquet").join(op7_quality_rules(spark, SF), "doc_id").where("not base_failed")
    counts = {(r.quality, r.kept): r["count"] for r in good.groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) == 0 and counts[(0, False)] > 5 * counts.get((0, True), 0)


def test_edges(spark, edge_docs, empty_docs):
    assert Q.judge(empty_docs, ["doc_id"]).count() == 0
    got = Q.judge(edge_docs, ["doc_id", "text", "fingerprint"]).collect()
    assert len(got) == 12 and all(r.fingerprint == "x" for r in got)
    for r in got:
        assert tuple(r[c] for c in Q.STATISTICS) == slow_statistics(r.text)
        assert r.kept == (not slow_failed(slow_statistics(r.text)))  # too few documents for a fit


def test_repeated_windows(spark):
    texts = ["a b c", "a b c a b c", "a a a a", "x a b c y a b c z a b", "a b c d a b d c", "p q " * 5, "a b c a b c d e f d e f"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.text_statistics(df.withColumn("lang", F.lit("en"))).collect()}
    assert got == {i: slow_statistics(t)[5] for i, t in enumerate(texts)}


def test_groups_joined_by_parts_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    told = [{r.doc_id: (r.kept, None if r.distance is None else round(r.distance, 6)) for r in Q.judge(docs, ["doc_id"], few=few).collect()} for few in (True,)]
    monkeypatch.setattr(Q, "PART_ROWS", 60)
    told += [{r.doc_id: (r.kept, None if r.distance is None else round(r.distance, 6)) for r in Q.judge(docs, ["doc_id"], few=False).collect()}]
    assert told[0] == told[1]


def test_a_clash_with_a_result_is_refused(spark, edge_docs):
    with pytest.raises(ValueError, match="kept"):
        Q.judge(edge_docs.withColumn("kept", F.lit(1)), ["doc_id", "kept"])
