import math
import re

import numpy as np
import pytest

from seriata.llm import toxicity as T
from seriata.llm.queries import op3_toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def split(spark):
    """Labelled rows of the table, the larger part to fit on."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = sorted((hash((r.doc_id * 7919) % 10007), r.doc_id, r.text, r.toxic) for r in docs.join(labels, "doc_id").collect())
    k = int(len(rows) * 0.6)
    return rows[:k], rows[k:]


def test_held_out_accuracy(split):
    train, held = split
    model = T.fit([r[2] for r in train], [r[3] for r in train])
    flagged = [(model.exceeds(t)[0] >= T.FLAG_AT, y) for _, _, t, y in held]
    caught = sum(f and y for f, y in flagged) / sum(y for _, y in flagged)
    false = sum(f and not y for f, y in flagged) / sum(not y for _, y in flagged)
    assert caught > 0.75 and false < 0.02


def test_thresholds_are_ordered_and_shared(split):
    train, _ = split
    model = T.fit([r[2] for r in train[:1000]], [r[3] for r in train[:1000]])
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == T.GRADES - 1
    for _, _, text, _ in train[:50]:
        p = model.exceeds(text)
        assert p == sorted(p, reverse=True)
        assert all(abs(q - 1 / (1 + math.exp(-(model.score(text) - b)))) < 1e-12 for q, b in zip(p, model.thresholds, strict=True))


def test_grades_keep_the_labels():
    from collections import Counter

    counts = [Counter(t.split()) for t in ["bad bad x", "bad y", "ok x", "ok y", "fine z", "fine x"] * 6]
    toxic = np.array([1, 1, 0, 0, 0, 0] * 6)
    grades = T.severity_grades(counts, toxic)
    assert set(grades[toxic == 0]) == {0} and set(grades[toxic == 1]) == {1, 2}


def test_query_against_plain_scoring(spark):
    """The query's model scored by the definition, word by word, over all rows."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    sample = T.labelled_sample(docs, labels)
    by_id = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(sample[0]) == len(by_id) and sum(sample[1]) == sum(by_id.values())
    model = T.fit(*sample)
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    for d in docs.collect():
        words = re.findall(r"[^\W\d_]+", d.text.lower())
        score = 0.0
        for w, weight in model.weights.items():
            n = words.count(w)
            score += weight * math.log(1 + 1000 * n / len(words)) if n else 0.0
        p = [1 / (1 + math.exp(b - score)) for b in model.thresholds]
        base = 1 / (1 + math.exp(model.thresholds[0]))
        r = got.pop(d.doc_id)
        assert abs(r.expected_severity - sum(p)) < 1e-9
        if min(abs(x - T.FLAG_AT) for x in p) > 1e-9 and abs(p[0] - base) > 1e-9:
            assert r.grade == (sum(x >= T.FLAG_AT for x in p) if p[0] > base else 0)
    assert not got


def test_severities_that_people_gave(spark):
    words = {0: "calm kind", 1: "rude calm", 2: "vile rude"}
    rows = [(i, f"{words[i % 3]} text number", i % 3) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(g > 0), g) for i, _, g in rows], "doc_id long, quality int, toxic int, severity int")
    got = {r.doc_id: r for r in T.classify(docs, labels).collect()}
    mean = [sum(got[i].expected_severity for i in range(k, 300, 3)) / 100 for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and {got[i].grade for i in range(2, 300, 3)} == {2}


def test_query_covers_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    assert all(0 <= r.expected_severity <= 2 and r.toxic == (r.grade > 0) for r in got)


def test_sample_is_bounded_and_reproducible(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts, toxic, none = T.labelled_sample(docs, labels, rows=300, chars=200_000)
    assert len(texts) == len(toxic) <= 300 and sum(map(len, texts)) <= 200_000
    assert T.labelled_sample(docs.repartition(7), labels.repartition(3), rows=300, chars=200_000) == (texts, toxic, none)
    assert none is None


def test_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.classify(empty_docs, none).count() == 0
    got = T.classify(edge_docs, none).collect()
    assert len(got) == 12 and not any(r.toxic for r in got)
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 1), (None, 1, 1), (3, 1, None), (9, 0, 0)], "doc_id long, quality int, toxic int")
    assert len(T.classify(edge_docs, one).collect()) == 12
