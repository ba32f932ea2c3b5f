"""Registration of queries with their SQL. Floats named in ``floats`` are rounded to six decimals on both sides, after a shift that keeps means of
short decimals off the halfway points, where the last bit of a sum would decide."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
SHIFT = 3.7e-9
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, floats: str = ""):
    """Registers a function under its own name."""
    names = floats.split()

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c) + SHIFT, 6) + F.lit(0.0) for c in names}) if names else df

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c} + {SHIFT}, 6) + 0.0e0 AS {c}' for c in names)}) FROM ({sql})" if names else sql
        return run

    return wrap
