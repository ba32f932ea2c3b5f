"""Toxicity by cumulative-link ordinal regression over sparse text features.

One weight per feature is shared by all thresholds: P(grade > k) = sigmoid(w . x - b_k) with b_0 < b_1 < .. . Features are the
words of a text and the score is built so that its length doesn't matter: a word counts log(1 + occurrences per PER words), and the L1 penalty
leaves weights only to words that tell. The output is the expected severity, the sum of P(grade > k).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production parameters. The sample bounds what is fitted on, and so what the driver holds: rows and characters
#: (whole rows are taken or not; characters are summed over rows).
SAMPLE_ROWS = 5000
SAMPLE_CHARS = 24_000_000
MIN_ROWS_OF_WORD = 5
PER = 1000
#: A word becomes a feature if the shares of toxic and other rows that have it differ by so many standard errors.
MIN_Z = 4.5
L1, STEPS = 1e-3, 300
#: Grades: 0 not toxic, then the toxic rows by their share of telling words, split at the median.
GRADES = 3
FLAG_AT = 0.6
_WORD = re.compile(r"[^\W\d_]+")


def text_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class OrdinalModel:
    """``weights`` of the words that have one; ``thresholds`` ascending."""

    weights: dict[str, float]
    thresholds: list[float]

    def score(self, text: str | None) -> float:
        words = text_words(text)
        found = Counter(filter(self.weights.__contains__, words))
        return sum(self.weights[w] * math.log1p(PER * n / len(words)) for w, n in found.items())

    def bare(self) -> float:
        """P(grade > 0) of a text without telling words."""
        return 1 / (1 + math.exp(max(-60.0, min(60.0, self.thresholds[0]))))

    def exceeds(self, text: str | None) -> list[float]:
        """P(grade > k) for each k, not increasing in k."""
        s = self.score(text)
        return [1 / (1 + math.exp(-max(-60.0, min(60.0, s - b)))) for b in self.thresholds]


def severity_grades(counts: list[Counter], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 2 out of two labels: a toxic row's grade goes with the number of its words that are more frequent in toxic rows.

    So the upper threshold is fitted to what the features themselves tell: it orders the toxic rows by density, and is no severity that
    people gave. Where labels have a ``severity``, that is the grade instead.
    """
    rows = [Counter(), Counter()]
    for c, t in zip(counts, toxic, strict=True):
        rows[int(t)].update(c.keys())
    n = [max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))]
    telling = {w for w, k in rows[1].items() if k >= MIN_ROWS_OF_WORD and k / n[1] > 8 * (rows[0][w] + 0.5) / n[0]}
    hits = np.array([sum(v for w, v in c.items() if w in telling) for c in counts])
    grades = np.zeros(len(counts), int)
    if toxic.any():
        grades[toxic == 1] = 1 + (hits[toxic == 1] > np.median(hits[toxic == 1]))
    return grades


def telling_words(counts: list[Counter], toxic: np.ndarray) -> list[str]:
    """Words whose presence differs between toxic and other rows by ``MIN_Z`` standard errors (pooled share, sorted)."""
    seen = [Counter(), Counter()]
    for c, t in zip(counts, toxic, strict=True):
        seen[int(t)].update(c.keys())
    n1 = int(toxic.sum())
    n0 = len(counts) - n1
    out = []
    if n0 and n1:
        for w in sorted(seen[1].keys() | seen[0].keys()):
            a, b = seen[1][w], seen[0][w]
            if a + b >= MIN_ROWS_OF_WORD:
                p = (a + b) / (n0 + n1)
                error = math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1))
                if error and abs(a / n1 - b / n0) >= MIN_Z * error:
                    out.append(w)
    return out


def fit(texts: list[str | None], toxic: list[int], severity: list[int] | None = None, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Proximal gradient steps on the proportional-odds likelihood, rows of each class weighted to equal sums. Grades are ``severity`` (0 to 2) or made of ``toxic``."""
    counts = [Counter(text_words(t)) for t in texts]
    y = np.array(severity, int).clip(0, GRADES - 1) if severity else severity_grades(counts, np.array(toxic, int)) if texts else np.zeros(0, int)
    vocabulary = {w: i for i, w in enumerate(telling_words(counts, y > 0))}
    if not vocabulary or len(set(y)) < 2:
        return OrdinalModel({}, [20.0, 21.0])
    rows, cols, vals = [], [], []
    for r, c in enumerate(counts):
        size = sum(c.values())
        for w, n in c.items():
            if w in vocabulary:
                rows.append(r), cols.append(vocabulary[w]), vals.append(math.log1p(PER * n / size))
    rows, cols, vals = np.array(rows), np.array(cols), np.array(vals)
    present = [g for g in range(GRADES) if (y == g).any()]
    weight = np.zeros(len(y))
    for g in present:
        weight[y == g] = 1 / (len(present) * (y == g).sum())
    over = np.stack([y > k for k in range(GRADES - 1)], 1).astype(float)
    w, b = np.zeros(len(vocabulary)), np.arange(1, GRADES, dtype=float)
    scale = np.maximum(1e-3, np.bincount(cols, weight[rows] * vals * vals, len(w)))
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    rate = 4.0 / max(1.0, float(np.bincount(rows, vals * vals / scale[cols], len(y)) @ weight))
    for step in range(steps):
        z = np.bincount(rows, vals * mw[cols], len(y))[:, None] - mb[None, :]
        err = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - over) * weight[:, None]
        grad = np.bincount(cols, err.sum(1)[rows] * vals, len(w)) / scale
        new_w = mw - rate * grad
        new_w = np.sign(new_w) * np.maximum(0, np.abs(new_w) - rate * l1 / scale)
        new_b = np.sort(mb + err.sum(0))
        new_b[1:] = np.maximum(new_b[1:], new_b[:-1] + 1e-3)
        push = step / (step + 3)
        mw, mb = new_w + push * (new_w - w), np.sort(new_b + push * (new_b - b))
        w, b = new_w, new_b
    return OrdinalModel({v: float(w[i]) for v, i in vocabulary.items() if w[i]}, [float(x) for x in b])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str | None], list[int], list[int] | None]:
    """Texts, labels and, if the labels have any, severities (null: the toxic label) of at most ``rows`` labelled ids, those with the smallest hash, leaving out what doesn't fit ``chars``.

    The order of files doesn't matter. An id with several labels counts as toxic if one says so; one with several texts
    gives them all. The labels are cut down before the join, so that the text of sampled rows alone moves, and at most
    ``rows`` labels are sent to the tasks.
    """
    graded = "severity" in labels.columns
    severity = F.coalesce(F.col("severity").cast("int"), "toxic") if graded else F.col("toxic")
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(severity).alias("severity"))
    chosen = marked.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id")).orderBy("h", "doc_id").limit(rows)
    spread = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    cost = F.sum(F.char_length(F.coalesce("text", F.lit(""))) + 64).alias("n")
    total, taken = 0, []
    for r in sorted(spread.groupBy("h", "doc_id").agg(cost).collect()):
        if total + r.n <= chars:
            total += r.n
            taken.append(r.doc_id)
    found = spread.where(F.col("doc_id").isin(taken)).select("h", "doc_id", "toxic", "severity", "text").collect() if taken else []
    found.sort(key=lambda r: (r.h, r.doc_id, r.text or ""))
    return [r.text for r in found], [r.toxic for r in found], [r.severity for r in found] if graded else None


def score_documents(docs: DataFrame, model: OrdinalModel, flag_at: float = FLAG_AT) -> DataFrame:
    """``doc_id, expected_severity, grade, toxic`` for every row of ``docs(doc_id, text)``, over whole texts, without a shuffle.

    ``expected_severity`` is the sum of P(grade > k); ``grade`` counts the k for which P(grade > k) reaches ``flag_at``, 0 for a text that
    no telling word raises; ``toxic`` is grade > 0. Null and empty texts score as texts without telling words; repeated rows stay.
    """

    @F.pandas_udf("struct<expected_severity: double, grade: int>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            p = np.array([model.exceeds(t) for t in texts]).reshape(len(texts), -1)
            told = (p[:, :1] > model.bare() + 1e-12) & (p >= flag_at)
            yield pd.DataFrame({"expected_severity": p.sum(1), "grade": told.sum(1).astype("int32")})

    return docs.select("doc_id", scored(F.col("text")).alias("s")).select("doc_id", "s.expected_severity", "s.grade", (F.col("s.grade") > 0).alias("toxic"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled sample, score everything. Without labels of both kinds nothing is flagged."""
    return score_documents(docs, fit(*labelled_sample(docs, labels)))
