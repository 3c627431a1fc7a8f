"""Visits of a batch against plain Python, and of a stream against the batch."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from quern.streaming.visits import split_visits, visits

START = 1_700_000_000
SCHEMA = "k long, ts timestamp, kind string, v double"


def rows_of(n, keys, seed, spread=200_000):
    rng = random.Random(seed)
    pick = lambda: None if rng.random() < 0.05 else rng.choice("abc")
    return [(rng.choice(keys), dt.datetime.fromtimestamp(START + rng.randrange(spread), dt.UTC), pick(), None if rng.random() < 0.1 else float(rng.randrange(9))) for _ in range(n)]


def brute(rows, gap):
    by = {}
    for k, ts, kind, v in rows:
        if ts is not None:
            by.setdefault(k, []).append((round(ts.timestamp() * 1e6), kind, v or 0.0))
    out = []
    for k, some in by.items():
        for visit in split_visits(some, round(gap * 1e6)):
            kinds = [x[1] for x in visit]
            out.append((k, visit[0][0], visit[-1][0], len(visit), sum(x[2] for x in visit), kinds[0], kinds[-1], sum(kinds[i] != kinds[i - 1] for i in range(1, len(kinds)))))
    return sorted(out, key=str)


def found(df):
    return sorted([tuple(r) for r in df.select("k", F.unix_micros("start"), F.unix_micros("end"), "n", "total", "first", "last", "switches").collect()], key=str)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_batch_equals_brute_force(spark, parts):
    """One key holds most rows, so that its visits lie across ranges; some visits span several."""
    rows = rows_of(1500, [1] * 6 + [2, 3, None], parts) + [(1, None, "a", 1.0)]
    rows += [(9, dt.datetime.fromtimestamp(START + i, dt.UTC), "ab"[i % 2], 1.0) for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(visits(spark.createDataFrame(rows, SCHEMA), "ts", ["k"], "kind", "v", 600)) == brute(rows, 600)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_nothing_in_nothing_out(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert visits(empty, "ts", ["k"], "kind", "v").count() == 0
    with pytest.raises(ValueError, match="longer than nothing"):
        visits(empty, "ts", ["k"], "kind", "v", 0)


def streamed(spark, batches, gap, late):
    """What a stream tells, its input given file by file in the order of the batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tempfile.mkdtemp(prefix="spark-visits-")
    name = f"visits_{folder[-8:].replace('-', '_')}"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder + "/in")
        stream = spark.readStream.schema(SCHEMA).parquet(folder + "/in")
        out = visits(stream, "ts", ["k"], "kind", "v", gap, late).writeStream.outputMode("append").format("parquet").option("path", folder + "/out")
        q = out.option("checkpointLocation", folder + "/checkpoint").queryName(f"{name}_{i}").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return found(spark.read.parquet(folder + "/out"))


def test_stream_comes_to_the_batch(spark):
    """Rows out of order within the lateness, over batches that stop and resume; a last row closes every visit."""
    rows = sorted(rows_of(240, [1, 1, 2, None], 5, 40_000), key=lambda r: r[1])
    rng = random.Random(1)
    mixed = [r for _, r in sorted(((r[1].timestamp() + rng.uniform(0, 500), i), r) for i, r in enumerate(rows))]
    end = (7, dt.datetime.fromtimestamp(START + 100_000, dt.UTC), "a", 0.0)
    got = streamed(spark, [mixed[:90], mixed[90:160], [*mixed[160:], end]], 600, "20 minutes")
    assert got == brute(rows, 600)  # the last row's own visit stays open


def test_late_rows_change_nothing(spark):
    at = lambda s: dt.datetime.fromtimestamp(START + s, dt.UTC)
    first = [(1, at(0), "a", 1.0), (1, at(100), "b", 2.0), (2, at(9000), "a", 1.0)]
    late = [(1, at(50), "c", 5.0), (2, at(9100), "b", 1.0), (3, at(20_000), "a", 1.0)]
    got = streamed(spark, [first, late], 600, "10 minutes")
    assert got == brute([*first, late[1]], 600)
