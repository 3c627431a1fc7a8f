"""Exact order statistics and distinct counts against NumPy and pandas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import profile, quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns_of(rng, n):
    heavy = rng.choice([0.0, 1.0, 1e9], n, p=[0.7, 0.2, 0.1])
    tailed = np.exp(rng.normal(0, 12, n)) * rng.choice([-1, 1], n)
    return {"even": rng.permutation(n).astype(float), "tied": rng.integers(0, 7, n).astype(float), "heavy": heavy, "tailed": tailed, "same": np.full(n, 3.5)}


@pytest.mark.parametrize("few", [1, 20, 1 << 16])
def test_quantiles_by_narrowing(spark, few):
    """Bounds that close in over several passes: ties, tails over twenty orders of magnitude, one value only."""
    given = columns_of(np.random.default_rng(1), 3000)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*given.values(), strict=True)], ", ".join(f"{c} double" for c in given)).repartition(4)
    got = quantiles.quantiles(df, {c: SHARES for c in given}, few=few)
    for c, x in given.items():
        assert got[c] == pytest.approx(np.quantile(x, SHARES).tolist(), rel=1e-12), c


def test_millions_of_distinct_values(spark):
    """No bound holds more than FEW values one by one, though the column has two million different ones."""
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("gaps"), (F.col("id") % 5).alias("tied"))
    assert quantiles.quantiles(df, {"x": [0.5, 0.999], "gaps": [0.25], "tied": [0.5]}, few=1000) == {"x": [(n - 1) / 2, pytest.approx((n - 1) * 0.999)], "gaps": [pytest.approx(np.quantile(np.arange(0, n, 3), 0.25))], "tied": [2.0]}
    assert quantiles.distinct_counts(df, df.columns) == {"x": n, "gaps": -(-n // 3), "tied": 5}


def test_quantiles_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), "n/a", 1), (None, 2.0, " 7 ", 2), (None, float("inf"), "x", 3), (None, 1.0, "8", 4)], "none double, odd double, words string, k int")
    got = quantiles.quantiles(df, {c: [0.5] for c in df.columns})
    assert got == {"none": [None], "odd": [1.5], "words": [7.5], "k": [2.5]}
    empty = df.where("false")
    assert quantiles.medians(empty, ["odd", "words"]) == {"odd": None, "words": None}
    assert quantiles.distinct_counts(empty, ["odd", "words"]) == {"odd": 0, "words": 0}
    assert quantiles.distinct_counts(df, df.columns) == {"none": 0, "odd": 4, "words": 4, "k": 4}


def test_group_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 11}", float(rng.integers(0, 500)) if i % 17 else None) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for q in (0.0, 0.3, 0.5, 1.0):
        got = {r["g"]: r["quantile"] for r in quantiles.group_quantile(df, "g", "v", q).collect()}
        want = {g: np.quantile([v for h, v in rows if h == g and v is not None], q) for g in {g for g, _ in rows}}
        assert got == pytest.approx(want)


def test_correlations_of_two_hundred_columns(spark):
    """All pairs in one pass, each over the rows where both are given; constants and columns without rows give 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 200)) + 1e6
    x[:, 1] = 2 * x[:, 0] + rng.normal(size=400)
    x[:, 2], x[rng.random((400, 200)) < 0.1], x[:, 3] = 5.0, np.nan, np.nan
    names = [f"c{i}" for i in range(200)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in row) for row in x], ", ".join(f"{c} double" for c in names)).repartition(4)
    found = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df, names).collect()}
    assert len(found) == 199 * 100
    for i, j in ((0, 1), (0, 2), (1, 3), (17, 150), (198, 199)):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        want = np.corrcoef(x[both, i], x[both, j])[0, 1] if both.sum() > 1 and x[both, i].std() > 0 and x[both, j].std() > 0 else 0.0
        assert found[f"c{i}", f"c{j}"] == pytest.approx(want, abs=1e-9)


def test_group_quantiles_never_gather_a_group(spark):
    """Interpolated and discrete quantiles of groups of all sizes, as the aggregates say; no aggregate or task holds a group's values."""
    rows = [(g, None if i % 11 == 0 else float((i * 37) % 101)) for g, n in (("a", 400), ("b", 3), ("c", 1), (None, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    found = quantiles.group_quantiles(df, "g", "v", {"q1": 0.25, "q9": 0.9}, {"d0": 0.0, "d": 0.5, "d1": 1.0})
    assert "percentile" not in found._jdf.queryExecution().executedPlan().toString().lower()
    df.createOrReplaceTempView("grouped_values")
    disc = ", ".join(f"percentile_disc({q}) WITHIN GROUP (ORDER BY v) AS {n}" for n, q in (("d0", 0.0), ("d", 0.5), ("d1", 1.0)))
    want = spark.sql(f"SELECT g, percentile(v, 0.25) AS q1, percentile(v, 0.9) AS q9, {disc} FROM grouped_values GROUP BY g")
    order = lambda t: sorted(map(tuple, t.collect()), key=repr)
    got = order(found)
    assert [r[0] for r in got] == [r[0] for r in order(want)] and len(got) == 4
    for a, b in zip(got, order(want), strict=True):
        assert a[1:] == pytest.approx(b[1:]) if a[1] is not None else a == b
