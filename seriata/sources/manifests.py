"""Manifests, inventories and tables: nested JSON to segment rows, violation queries, hashes, columnar output with a sidecar."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.model import issues

SEGMENT = "struct<segment_id:string,path:string,continuous_with_previous:boolean,timing:struct<first:double,interval:double,unit:string>,sample_axis:struct<first:double,interval:double,unit:string>>"
SYSTEMS = f"systems array<struct<system_id:string,replicas:array<struct<replica_id:string,segments:array<{SEGMENT}>>>>>"
#: Picoseconds of each time unit.
UNITS = {"fs": 0.001, "ps": 1.0, "ns": 1000.0, "us": 1_000_000.0}


def load_json(text: str) -> dict:
    """JSON in which a repeated key is an error."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) < len(keys):
            raise ValueError(f"repeated keys: {sorted({k for k in keys if keys.count(k) > 1})}")
        return dict(items)

    return json.loads(text, object_pairs_hook=pairs)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """One row per segment of the manifests under ``path``, with its axis in picoseconds or samples."""
    rows = spark.read.schema(SYSTEMS).option("multiLine", True).json(path).select(F.explode("systems").alias("s"))
    rows = rows.select("s.system_id", F.explode("s.replicas").alias("r")).select("system_id", "r.replica_id", F.posexplode("r.segments").alias("segment_ord", "g"))
    axis = F.coalesce("g.timing", "g.sample_axis")
    scale = F.coalesce(*[F.when(F.col("g.timing.unit") == u, F.lit(k)) for u, k in UNITS.items()], F.when(F.col("g.timing").isNull(), F.lit(1.0)))
    kind = F.when(F.col("g.timing").isNotNull() & F.col("g.sample_axis").isNull(), "time").when(F.col("g.timing").isNull() & F.col("g.sample_axis").isNotNull(), "sample")
    return rows.select("system_id", "replica_id", "g.segment_id", "segment_ord", "g.path", F.coalesce("g.continuous_with_previous", F.lit(False)).alias("continuous_with_previous"), kind.alias("axis_kind"), (axis["first"] * scale).alias("first"), (axis["interval"] * scale).alias("interval"))


def segment_issues(rows: DataFrame) -> DataFrame:
    """Broken contracts of a segment table; empty if it is sound."""
    where = F.concat_ws("/", "system_id", "replica_id", "segment_id")
    twice = rows.groupBy("system_id", "replica_id", "segment_id").agg(F.count("*").alias("n"))
    return (
        issues(rows, "axis", F.col("axis_kind").isNull(), where, "a segment needs a timing or a sample axis, not both")
        .unionByName(issues(rows, "interval", F.col("axis_kind").isNotNull() & (F.coalesce("interval", F.lit(0.0)) <= 0), where, "the interval must be positive and its unit known"))
        .unionByName(issues(twice, "duplicate_segment", F.col("n") > 1, where, "a segment is named twice"))
    )


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of all files under ``path``; hashes are taken where the files are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def signature(record) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


def write_table(df: DataFrame, path: str, constants: dict | None = None, partition_by: list[str] | None = None) -> None:
    """Parquet and, beside the data, a ``_contract`` table of its schema, row count, constants and signature; readers check it."""
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/data")
    spark = df.sparkSession
    told = {"schema": json.loads(df.schema.json()), "rows": spark.read.parquet(f"{path}/data").count(), "constants": constants or {}}
    spark.createDataFrame([(json.dumps(told, sort_keys=True), signature(told))], "contract string, signature string").coalesce(1).write.json(f"{path}/_contract")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``write_table``, with its constants as columns. A missing or altered contract is an error."""
    row = spark.read.schema("contract string, signature string").json(f"{path}/_contract").first()
    told = json.loads(row.contract) if row else None
    if told is None or signature(told) != row.signature:
        raise ValueError(f"the contract of {path} does not hold")
    df = spark.read.parquet(f"{path}/data").select(*[f["name"] for f in told["schema"]["fields"]])
    if df.count() != told["rows"]:
        raise ValueError(f"{path} does not have {told['rows']} rows")
    return df.withColumns({k: F.lit(v) for k, v in told["constants"].items()}) if told["constants"] else df


def compare_values(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Regression assertions ``(name, operator, expected, tolerance)`` against ``(name, value)``: equal, close, contains, is_null."""
    both = expected.join(observed, "name", "left")
    ok = (
        F.when(F.col("operator") == "equal", F.col("value").eqNullSafe(F.col("expected")))
        .when(F.col("operator") == "close", F.abs(F.col("value").try_cast("double") - F.col("expected").try_cast("double")) <= F.coalesce("tolerance", F.lit(0.0)))
        .when(F.col("operator") == "contains", F.contains("value", "expected"))
        .when(F.col("operator") == "is_null", F.col("value").isNull())
    )
    return both.select("name", "operator", F.coalesce(ok, F.lit(False)).alias("passed"))
