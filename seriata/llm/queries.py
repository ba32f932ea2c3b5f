"""The registered queries of this subpackage, with SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, packing, quality, secrets, simhash, toxicity, url_cascade, warc
from .text import hex16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.filter_urls(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: A conversation of the contract: texts made of other templates' control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    made = chat.format_turns(chat.table_turns(rows)).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return made.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), chat.turns_digest(F.col("turns")).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))
    return classes.select("doc_id", hex16(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"))
    return read.where("not gap").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _count_kind(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    counts = [_count_kind(kind) for kind in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc": op8_warc,
    "op9_secret_scan": op9_secret_scan,
    "op10_mixing": op10_mixing,
}

def _sql_rules() -> tuple[str, str]:
    ranked = sorted(url_cascade.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ranked]
    return " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits), " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)


_RULE, _VERDICT = _sql_rules()
_LISTED = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in url_cascade.BLOCKED_HOSTS)
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase

OP1_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
)
SELECT page_id, host, path, CASE {_RULE} END AS rule, CASE {_VERDICT} WHEN {_LISTED} THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


def _sql_escaped_length(column: str) -> str:
    """Characters of the escaped text: every control string becomes two, every escape sign gains one."""
    out = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE}0')"
    for c, code in zip(chat.CONTROLS, chat._CODES, strict=False):
        out = f"replace({out}, '{c}', '{chat.ESCAPE}{code}')"
    return f"length({out})"


OP4_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), told AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM rows
), sized AS (
  SELECT *, {_sql_escaped_length("replace(role, chr(10), 'xx')")} + {_sql_escaped_length("text")} + {len(chat.START) + len(chat.END) + 2} AS chars FROM told
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id, alone
"""

OP8_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), marked AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS best FROM p
), told AS (SELECT *, n >= {warc.MIN_DEDUP_BYTES} AND best IS NOT NULL AND (page_id IS NULL OR page_id < best) AS again FROM marked)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to
FROM told
"""

ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op4_chat_format": OP4_SQL, "op8_warc": OP8_SQL}
