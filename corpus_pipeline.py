"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing, each over all that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.llm import mixing, packing, quality, secrets, simhash
from seriata.llm.storage import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the MCD reject go; the others stay as they are."""
    return quality.judge(docs, COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; of rows that repeat it, those that differ in text stay.

    A class whose rows have no ids at all keeps one row per text.
    """
    classes = simhash.near_duplicate_classes(docs.select("doc_id", "text"))
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_k"), F.col("doc_id").isNull().alias("_null"), "text_hash")
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("_k"), F.col("doc_id").isNull().alias("_null"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return keyed.join(first, ["_k", "_null", "text_hash"], "left_semi").dropDuplicates(["_k", "_null", "text_hash"]).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; no document goes."""
    return secrets.redact(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows in the order of the Pfair schedule, which the files keep."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence. Groups are consecutive stretches of the files' order, so sequences follow the mixing schedule."""
    return packing.pack_documents(packing.stretches(docs), stretch="stretch")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("packing", sequence_packing),
]

#: No stage of the five can be stated in SQL (an iterated fit, a tokenizer, a bin packing); tests/llm holds run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
