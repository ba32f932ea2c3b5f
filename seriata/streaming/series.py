"""Structured Streaming forms: mergeable one-pass summaries, gap-defined segments, and ordered unwrapping with state.

The models have no event-time windows of their own; these carry their summaries over to streams of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.summaries import summary_columns


def running_summary(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The sample summary per key as an updating streaming aggregate; its state is one row of moments a key."""
    return stream.groupBy(*keys).agg(*summary_columns(F.col(value)))


def windowed_summary(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Summaries of tumbling windows; a window closes ``delay`` after its end, so its state is dropped."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", delay)
    return timed.groupBy(F.window("_t", width).alias("w"), *keys).agg(*summary_columns(F.col(value))).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "sd", "sem")


def gap_segments(rows: DataFrame, time: str, keys: list[str], value: str, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Segments of a key that end where no row follows within ``gap``, with their summary; for streams and tables alike."""
    timed = rows.withColumn("_t", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_t", delay) if rows.isStreaming else timed
    return timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(*summary_columns(F.col(value))).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean", "sd", "sem")


def quarantine(rows: DataFrame, time: str, arrived: str, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """``(on_time, late)``: late rows go to an output of their own instead of being dropped in silence."""
    late = F.unix_micros(F.col(arrived).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp")) > delay_seconds * 1_000_000
    return rows.where(~late), rows.where(late)


def unwrap_stream(stream: DataFrame, replica: str, order: str, value: str, box: float) -> DataFrame:
    """``(replica, ord, value, unwrapped)`` of a stream that is ordered within each replica; the state is the last raw and unwrapped value.

    A row that does not follow the last one fails the query.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for rows in batches:
            out = []
            for at, raw in rows.sort_values("ord")[["ord", "value"]].itertuples(index=False):
                if last is None:
                    smooth = raw
                else:
                    if at <= last[0]:
                        raise ValueError(f"frame {at} of {key[0]} does not follow {last[0]}")
                    d = raw - last[1]
                    smooth = last[2] + d - box * ((d / box + 0.5) // 1)
                last = (int(at), float(raw), float(smooth))
                out.append((key[0], *last))
            yield pd.DataFrame(out, columns=["replica", "ord", "value", "unwrapped"])
        if last is not None:
            state.update(last)

    rows = stream.select(F.col(replica).cast("string").alias("replica"), F.col(order).cast("bigint").alias("ord"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("replica").applyInPandasWithState(step, "replica string, ord long, value double, unwrapped double", "ord long, raw double, smooth double", "append", "NoTimeout")
