"""Neighbours by pivots against all distances."""

import numpy as np
import pytest

from quern.operators import nearest


def table(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r], float(i % 5)) for i, r in enumerate(x)], "k long, x array<double>, v double").repartition(3)


def brute(train, probes, k):
    rows = {}
    for i, q in enumerate(probes):
        d = np.sqrt(((train - q) ** 2).sum(1))
        rows[10_000_000 + i] = [(d[j], int(j), float(j % 5)) for j in np.lexsort((np.arange(len(train)), d))[:k]]
    return rows


def told(found):
    return {r["k"]: [tuple(n) for n in r["near"]] for r in found.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, near in want.items():
        assert [n[1:] for n in got[k]] == [n[1:] for n in near]
        assert [n[0] for n in got[k]] == pytest.approx([n[0] for n in near], abs=1e-12)


@pytest.fixture
def small_rings(monkeypatch):
    monkeypatch.setattr(nearest, "RING", 40)
    monkeypatch.setattr(nearest, "PROBES", 16)
    monkeypatch.setattr(nearest, "MARKS", 4)


@pytest.mark.parametrize("kind", ["clusters", "spread", "grid", "one place"])
def test_neighbours_equal_all_distances(spark, small_rings, kind):
    """Clusters of very different size, vectors without structure, many ties, nothing but copies."""
    rng = np.random.default_rng(2)
    if kind == "clusters":
        centres = rng.normal(0, 50, (12, 6))
        pick = rng.choice(12, 1500, p=[0.6] + [0.4 / 11] * 11)
        x = centres[pick] + rng.normal(size=(1500, 6))
    else:
        x = {"spread": rng.normal(size=(900, 6)), "grid": rng.integers(0, 3, (900, 4)).astype(float), "one place": np.ones((300, 3))}[kind]
    probes = np.vstack([x[::23] + (0.01 if kind == "clusters" else 0.0), x[:3] + 100.0])
    got = told(nearest.neighbours(table(spark, x), table(spark, probes, 10_000_000), "x", "k", "v", 5))
    same(got, brute(x, probes, 5))


def test_clusters_leave_most_rings_alone(spark, small_rings):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 100, (20, 8))
    x = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8))
    index = nearest.Index(table(spark, x), "x", "k", "v")
    probes = table(spark, x[:60] + 0.01, 10_000_000).select(nearest.F.col("k").alias("_pk"), nearest.F.col("x").alias("_px"))
    homes = nearest.stored(probes.withColumn("_home", nearest.placed(nearest.F.col("_px"), index.pivots)).select("_pk", "_px", "_home.part", "_home.distance").toDF("_pk", "_px", "_part", "_d"), "probes")
    looked = nearest.visited(index, nearest.first_rings(index, homes), 5).select("_pk", nearest.F.get("near", nearest.F.lit(4))["distance"].alias("_bound"))
    reach = homes.join(looked, "_pk").select(nearest.F.size(nearest.reached(nearest.F.col("_px"), nearest.F.col("_part"), nearest.F.col("_bound"), index.pivots, index.farthest)).alias("n"))
    assert reach.agg(nearest.F.avg("n")).first()[0] < 0.25 * len(index.pivots)
    assert index.rows.groupBy("_part", "_ring").count().agg(nearest.F.max("count")).first()[0] <= 40


def test_neighbours_of_odd_tables(spark):
    x = np.arange(12.0).reshape(6, 2)
    train = table(spark, x).unionByName(spark.createDataFrame([(99, None, 1.0)], "k long, x array<double>, v double"))
    probes = table(spark, x[:2], 10_000_000)
    same(told(nearest.neighbours(train, probes, "x", "k", "v", 9)), brute(x, x[:2], 9))  # fewer rows than neighbours
    assert nearest.neighbours(train.where("false"), probes, "x", "k").count() == 0
    assert nearest.neighbours(train, probes.where("false"), "x", "k").count() == 0
    got = nearest.nearest_distance(train, table(spark, [[0.0, 2.0]], 10_000_000), "x", "k").first()
    assert (got["distance"], got["nearest"]) == (1.0, 0)
