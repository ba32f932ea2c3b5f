"""Signed contracts and tables that are built once: an interrupted run takes up what its earlier steps wrote."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalars import minimum_image
from ..operators.model import in_replica
from .manifests import load_json, read_table, signature, write_table

#: Modules whose results need frames in order, and mean nothing for an unordered ensemble.
ORDERED = frozenset({"residence_runs", "transition_matrix", "markov_model", "autocorrelation", "effective_sample_size", "time_lagged_components", "transfer_entropy", "lagged_correlation", "unwrapping", "displacement_propagator"})


def compile_context(project: str, system: str) -> dict:
    """A project's and a system's JSON as one contract with its signature. Repeated keys, a missing section, systems without replicas, and
    modules that need order in a static ensemble are errors."""
    p, s = load_json(project), load_json(system)
    if not p.get("modules") or not s.get("systems"):
        raise ValueError("a context needs modules and systems")
    names = [x.get("system_id") for x in s["systems"]]
    if len(set(names)) < len(names) or None in names:
        raise ValueError("systems need distinct names")
    if any(not x.get("replicas") for x in s["systems"]):
        raise ValueError("a system has no replicas")
    require_order(p["modules"], bool(p.get("static_ensemble")))
    told = {"project": p, "systems": s["systems"]}
    return told | {"signature": signature(told)}


def require_order(modules: list[str], static_ensemble: bool) -> None:
    """A static ensemble has no time: modules that read the order of frames may not run on it."""
    if static_ensemble and (ordered := sorted(ORDERED & set(modules))):
        raise ValueError(f"a static ensemble has no order for {ordered}")


def resumed(spark: SparkSession, folder: str, name: str, contract: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` under ``folder`` if one was finished for this contract, else what ``build`` makes, written first.

    The path holds the contract's signature, and the sidecar is written after the data: a table without it, or with other rows than it tells, was
    left by an interrupted run and is an error to read, so it is built anew beside it.
    """
    base = f"{folder.rstrip('/')}/{name}-{signature(contract)[:24]}"
    for attempt in range(100):
        path = f"{base}-{attempt}"
        try:
            return read_table(spark, path)
        except (AnalysisException, ValueError):
            if _exists(spark, f"{path}/data"):
                continue
            write_table(build(), path)
            return read_table(spark, path)
    raise RuntimeError(f"{base}: a hundred attempts were left unfinished")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def coordinate_cache(spark: SparkSession, folder: str, points: DataFrame, box: tuple[float, float, float], stride: int = 1) -> DataFrame:
    """``points(system_id, replica_id, segment_id, ord, id, x, y, z)`` unwrapped along each atom's path and thinned by ``stride``, built once per contract.

    Paths are made continuous before rows are left out, so that the stride can't step over half a box."""
    atom = in_replica().partitionBy("system_id", "replica_id", "segment_id", "id").orderBy("ord")
    smooth = {}
    for c, length in zip("xyz", box, strict=True):
        step = F.col(c) - F.lag(c).over(atom)
        smooth[c] = F.first(c).over(atom) + F.sum(F.coalesce(minimum_image(step, length), F.lit(0.0))).over(atom)
    contract = {"box": list(box), "stride": stride, "schema": json.loads(points.schema.json())}
    return resumed(spark, folder, "coordinates", contract, lambda: points.withColumns(smooth).where(F.col("ord") % stride == 0))
