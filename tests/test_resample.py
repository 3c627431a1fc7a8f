"""Paired intervals against explicit resampling with the same weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import resample


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    y = rng.integers(0, 3, 700)
    return [(i, int(t), int(t if rng.random() < 0.8 else rng.integers(0, 3)), int(t if rng.random() < 0.6 else 2), float(np.round(t / 2 + rng.normal(0, 0.5), 1)), float(rng.normal())) for i, t in enumerate(y)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, a int, b int, s double, z double").repartition(4)


def drawn(table, n):
    keys = np.array([r[0] for r in table.orderBy("id").select(F.xxhash64(F.col("id"), F.lit(resample.SEED))).collect()])
    return resample.weights(keys, n)


def f1(y, p, w):
    out = []
    for k in np.unique(np.concatenate([y[w > 0], p[w > 0]])):
        hit, held, said = (w[m].sum() for m in ((y == k) & (p == k), y == k, p == k))
        out.append(2 * hit / (held + said))
    return np.mean(out)


def auc(y, s, w):
    up, down = y == 1, y == 0
    better = (s[up][:, None] > s[down][None, :]) + 0.5 * (s[up][:, None] == s[down][None, :])
    return (w[up][:, None] * w[down][None, :] * better).sum() / (w[up].sum() * w[down].sum())


def test_weights_are_poisson(table):
    w = drawn(table, 400)[:, 1:]
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.02)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15


@pytest.mark.parametrize("metric", ["accuracy", "macro_f1", "rmse", "mae"])
def test_every_resample_is_the_metric_of_its_weights(table, rows, metric):
    x = np.array([r[1:4] for r in rows])
    w = drawn(table, 25)
    one = {
        "accuracy": lambda p, v: (v * (x[:, 0] == p)).sum() / v.sum(), "macro_f1": lambda p, v: f1(x[:, 0], p, v),
        "rmse": lambda p, v: np.sqrt((v * (x[:, 0] - p) ** 2).sum() / v.sum()), "mae": lambda p, v: (v * abs(x[:, 0] - p)).sum() / v.sum(),
    }[metric]
    found = {(r["model"], r["b"]): r["value"] for r in resample.resampled(table, "id", "y", {"a": F.col("a"), "b": F.col("b")}, metric, 25).collect()}
    assert len(found) == 52
    for (m, b), value in found.items():
        assert value == pytest.approx(one(x[:, 1 if m == "a" else 2], w[:, b]))


def test_areas_of_every_resample(spark, table, rows):
    """Scores with many ties, over several ranges."""
    y, s = np.array([int(r[1] > 0) for r in rows]), np.array([r[4] for r in rows])
    w = drawn(table, 10)
    binary = table.withColumn("t", (F.col("y") > 0).cast("int"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    found = {r["b"]: r["value"] for r in resample.resampled(binary, "id", "t", {"s": F.col("s")}, "auc", 10).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [found[b] for b in range(11)] == pytest.approx([auc(y, s, w[:, b]) for b in range(11)])


def test_differences_come_from_the_same_draws(table, rows):
    x = np.array([r[1:4] for r in rows])
    w = drawn(table, 200)[:, 1:]
    right = [(x[:, 0] == x[:, i])[:, None] for i in (1, 2)]
    delta = [(w * r).sum(0) / w.sum(0) for r in right]
    gap = delta[0] - delta[1]
    found = resample.paired_intervals(table, "id", "y", {"a": F.col("a"), "b": F.col("b"), "copy": F.col("b")}, "accuracy", "b", 200).collect()
    assert [r["model"] for r in found] == ["a", "b", "copy"]
    a, b, copy = found
    assert (a["delta_low"], a["delta_high"]) == pytest.approx(np.quantile(gap, [0.025, 0.975]).tolist())
    assert (a["low"], a["high"]) == pytest.approx(np.quantile(delta[0], [0.025, 0.975]).tolist())
    assert a["win_share"] == pytest.approx((gap > 0).mean()) and a["decisive"] and not b["decisive"]
    assert (copy["delta_low"], copy["delta_high"], copy["win_share"]) == (0, 0, 0)  # not apart at all, though both intervals are wide


def test_intervals_of_odd_tables(table):
    assert resample.paired_intervals(table.limit(7), "id", "y", {"a": F.col("a")}, "accuracy", "a", 20).count() == 0
    assert resample.paired_intervals(table.where("false"), "id", "y", {"a": F.col("a")}, "auc", "a", 20).count() == 0
    for bad in ({"metric": "f2", "against": "a"}, {"metric": "auc", "against": "c"}):
        with pytest.raises(ValueError):
            resample.paired_intervals(table, "id", "y", {"a": F.col("a")}, **bad)
    nulls = table.withColumn("a", F.when(F.col("id") % 2 == 0, F.col("a")))
    half = resample.resampled(nulls, "id", "y", {"a": F.col("a")}, "accuracy", 5).where("b = 0").first()["value"]
    assert half == table.where("id % 2 = 0").agg(F.avg((F.col("y") == F.col("a")).cast("double"))).first()[0]
