"""Secret scan: fixed patterns, and random strings that a tokenizer's vocabulary can't compress.

A string that people wrote splits into tokens of several characters; a random one into tokens of one or two. Strings
whose characters-per-token ratio is low are reported, unless they are known digests or identifiers.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Characters of a random string at least.
MIN_RANDOM = 20
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RANDOM},}}")
_SEPARATORS = frozenset("/_=+-")
_PARTS = re.compile(r"[/_=+-]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"(?:md5|sha1|sha256|sha384|sha512)?[-_=]?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
#: UUIDs and digests that stand between separators.
_NAMED = re.compile(rf"(?<![A-Za-z0-9])(?:{_UUID.pattern}|{_DIGEST.pattern})(?![A-Za-z0-9])", re.IGNORECASE)
#: Production parameters: vocabulary, most characters per token of a random string.
VOCABULARY = "byte_bpe_50k.tiktoken"
MAX_RATIO = 2.0
#: Digests that occur in public text without being secret (of the empty string).
KNOWN = frozenset(hashlib.new(n, b"").hexdigest() for n in ("md5", "sha1", "sha224", "sha256", "sha384", "sha512"))
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points. A keyword's absence is told by plain search, so most texts never meet the slow pattern."""
    out = []
    low = text.lower()
    if "password" in low or "passwd" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _windows(s: str, path: str, max_ratio: float) -> list[tuple[int, int]]:
    """Stretches of ``s`` whose windows of MIN_RANDOM characters or just over hold few characters per token, widened to the nearest separators."""
    ends = [0, *accumulate(map(len, _encoding(path).decode_tokens_bytes(_encoding(path).encode_ordinary(s))))]
    out: list[tuple[int, int]] = []
    j = 0
    for i, a in enumerate(ends):
        while j < len(ends) and ends[j] - a < MIN_RANDOM:
            j += 1
        if j == len(ends):
            break
        if ends[j] - a <= max_ratio * (j - i):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], ends[j])
            else:
                out.append((a, ends[j]))
    wide: list[tuple[int, int]] = []
    for a, b in out:
        while a and s[a - 1] not in _SEPARATORS and s[a] not in _SEPARATORS:
            a -= 1
        while b < len(s) and s[b] not in _SEPARATORS and s[b - 1] not in _SEPARATORS:
            b += 1
        if wide and a <= wide[-1][1]:
            wide[-1] = (wide[-1][0], b)
        else:
            wide.append((a, b))
    return wide


def _unnamed(s: str) -> bool:
    """A part between separators is too long for paths, snake_case names and dates, and isn't a number."""
    return any(len(p) >= 12 and not p.isdigit() for p in _PARTS.split(s))


def random_spans(text: str, taken: list[tuple[int, int, str]], path: str, max_ratio: float = MAX_RATIO, known: frozenset[str] = KNOWN) -> list[tuple[int, int, str]]:
    """Long strings with few characters per token, outside ``taken``: a whole candidate, or else the stretches of it that are so by themselves.

    A readable key or path around a random stretch doesn't hide it, nor does a span of ``taken``, a digest or a UUID beside it.
    """
    out = []
    for m in _CANDIDATE.finditer(text):
        s = m[0]
        if not any(c.isalpha() for c in s) or max(map(len, _PARTS.split(s))) < 12:
            continue
        if _UUID.fullmatch(s) or _DIGEST.fullmatch(s) or s.lower() in known:
            continue
        cut = sorted((max(a - m.start(), 0), min(b - m.start(), len(s))) for a, b, _ in taken if a < m.end() and m.start() < b)
        if not cut and len(s) <= max_ratio * len(_encoding(path).encode_ordinary(s)):
            out.append((m.start(), m.end(), "random"))
            continue
        at = 0
        for a, b in sorted(cut + [x.span() for x in _NAMED.finditer(s)]) + [(len(s), len(s))]:
            if a - at >= MIN_RANDOM:
                out += [(m.start() + at + x, m.start() + at + y, "random") for x, y in _windows(s[at:a], path, max_ratio) if _unnamed(s[at + x : at + y])]
            at = max(at, b)
    return out


def find_spans(text: str | None, path: str, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    text = text or ""
    base = base_spans(text)
    return sorted(base + random_spans(text, base, path, max_ratio), key=lambda s: (s[0], KINDS.index(s[2])))


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])


def secret_spans(docs: DataFrame, column: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with ``spans``, an array of (start, end, kind) over the whole text, by start, then kind.

    Null and empty texts have none. All rows and columns stay. Texts cross to Python in bounded batches and nothing is shuffled.
    """

    @F.pandas_udf(T.ArrayType(SPAN))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        path = public_tokenizers.path(vocabulary)
        for texts in batches:
            yield pd.Series([[{"start": a, "end": b, "kind": k} for a, b, k in find_spans(t, path, max_ratio)] for t in texts])

    return docs.withColumn("spans", scan(F.col(column)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark`` (overlapping spans by one) and ``n_chars`` counted anew. No document is dropped."""
    kept = docs.columns
    found = secret_spans(docs.withColumn("_own", F.struct(*docs.columns)).select("_own", F.col("text").alias("_t")), "_t", **options)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(F.col("_t"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(F.col("_t"), (acc["at"] + 1).cast("int"), F.length("_t")))

    text = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, rest)).otherwise(F.col("_t"))
    out = found.select("_own", text.alias("_new"), (F.size("spans") > 0).alias("_hit"))
    fields = {c: F.col("_own")[c] for c in kept} | {"text": F.col("_new")}
    if "n_chars" in kept:
        fields["n_chars"] = F.when(F.col("_hit"), F.char_length("_new").cast("bigint")).otherwise(F.col("_own")["n_chars"])
    return out.select(*[fields[c].alias(c) for c in kept])
