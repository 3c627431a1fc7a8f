"""Streams come to what their batch form says."""

import time

import pytest
from pyspark.sql import functions as F

from quern.streaming import windows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    rows = spark.range(200).select(F.col("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97 + F.floor(F.col("id") / 50) * 7200).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    rows.write.parquet(path)
    return path


@pytest.mark.parametrize("make", [windows.tumbling, windows.sliding, windows.sessions])
def test_stream_equals_batch(spark, folder, make):
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    name = f"out_{make.__name__}_{time.time_ns()}"
    q = make(stream, "ts", ["k"], "v").writeStream.outputMode("complete" if make is not windows.sessions else "append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table(name).collect()}
    want = {tuple(r) for r in make(batch, "ts", ["k"], "v").collect()}
    assert got == want if make is not windows.sessions else got <= want and len(got) > 0


def test_batches_are_checked(spark, folder, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    out = str(tmp_path / "checks")
    windows.checked_batches(stream, lambda b: b.agg(F.count("*").alias("n")), out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 200
