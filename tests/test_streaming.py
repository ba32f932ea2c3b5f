"""Streams driven to the end give the batch answer."""

import pytest
from pyspark.sql import functions as F

from seriata.streaming import series as S

EVENTS = "/root/testdata/sf0.001/events.parquet"


def run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark):
    schema = spark.read.parquet(EVENTS).schema
    return spark.readStream.schema(schema).parquet(EVENTS.replace("events.parquet", "event[s].parquet"))


def test_running_summary(spark):
    got = run(S.running_summary(stream(spark), ["event_type"], "value"), "complete", "running")
    want = S.running_summary(spark.read.parquet(EVENTS), ["event_type"], "value")
    assert {(r.event_type, r.n, round(r.mean, 9)) for r in got.collect()} == {(r.event_type, r.n, round(r.mean, 9)) for r in want.collect()}


def test_windows_close(spark):
    got = run(S.windowed_summary(stream(spark), "ts", ["event_type"], "value", "1 day"), "append", "windows")
    assert 0 < got.agg(F.sum("n")).first()[0] <= spark.read.parquet(EVENTS).count()


def test_unwrap_stream(spark):
    got = run(S.unwrap_stream(stream(spark), "event_type", "event_id", "value", 100.0), "append", "unwrapped").collect()
    assert len(got) == spark.read.parquet(EVENTS).count()
    assert all(abs((r.unwrapped - r.value) / 100 - round((r.unwrapped - r.value) / 100)) < 1e-6 for r in got)


def test_quarantine(spark):
    df = spark.sql("select timestamp'2024-01-01 00:00:00' as ts, timestamp'2024-01-01 00:00:05' as seen union all select timestamp'2024-01-01 00:00:00', timestamp'2024-01-01 00:01:00'")
    on_time, late = S.quarantine(df, "ts", "seen", 10)
    assert (on_time.count(), late.count()) == (1, 1)


@pytest.mark.parametrize("gap, segments", [("10 seconds", 2), ("2 minutes", 1)])
def test_gap_segments(spark, gap, segments):
    df = spark.sql("select 1 as k, timestamp_ntz'2024-01-01 00:00:00' as ts, 1.0D as v union all select 1, timestamp_ntz'2024-01-01 00:01:00', 2.0D")
    assert S.gap_segments(df, "ts", ["k"], "v", gap).count() == segments
