"""Boosting against a plain tree builder over all rows, and replays of trees against their predictions."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quern.operators import boosting, models, trees

SMALL = boosting.Settings(rounds=12, least_rows=5)


def table(spark, x, y):
    rows = [(i, [None if np.isnan(v) else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k long, x array<double>, y double").repartition(3)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 5, 500), rng.exponential(size=500), np.full(500, 2.0)])
    x[rng.random(500) < 0.05, 2] = np.nan
    return x, np.round(3 * np.sin(2 * x[:, 0]) + x[:, 1] + rng.normal(0, 0.2, 500), 3)


def brute_edges(x, bins):
    out = []
    for column in x.T:
        v = sorted({a for a in column if not np.isnan(a)})
        out.append(v if len(v) <= bins else sorted({v[b * len(v) // bins - 1] for b in range(1, bins + 1)}))
    return out


def brute_boost(x, edges, base, loss, s):
    """Row by row and split by split; the scores after all rounds."""
    codes = np.array([[min(int(np.searchsorted(e, -np.inf if np.isnan(v) else v)), len(e) - 1) for v, e in zip(row, edges, strict=True)] for row in x])
    score = np.full(len(x), base)
    for _ in range(s.rounds):
        g, h = loss(score)

        def grow(rows, depth):
            best = None
            G, H = g[rows].sum(), h[rows].sum()
            if depth < s.depth and len(rows) >= 2 * s.least_rows:
                for f, e in enumerate(edges):
                    for b in range(len(e) - 1):
                        left = rows[codes[rows, f] <= b]
                        if min(len(left), len(rows) - len(left)) < s.least_rows:
                            continue
                        GL, HL = g[left].sum(), h[left].sum()
                        gain = 0.5 * (GL**2 / (HL + s.ridge) + (G - GL) ** 2 / (H - HL + s.ridge) - G**2 / (H + s.ridge))
                        if gain > (best[0] + 1e-12 if best else -1e-9):
                            best = (gain, f, b)
            if best is None:
                score[rows] += s.rate * -G / (H + s.ridge)
                return
            at = codes[rows, best[1]] <= best[2]
            grow(rows[at], depth + 1)
            grow(rows[~at], depth + 1)

        grow(np.arange(len(x)), 0)
    return score


def test_edges_are_quantiles_of_distinct_values(spark, points):
    x, y = points
    assert boosting.bin_edges(table(spark, x, y), "x", 4, 32) == brute_edges(x, 32)
    assert boosting.bin_edges(table(spark, x, y).where("false"), "x", 2, 32) == [[], []]


@pytest.mark.parametrize("rows_a_task", [1 << 16, 100])
def test_regression_equals_the_plain_builder(spark, points, monkeypatch, rows_a_task):
    """In one task, and in several whose sums are added up."""
    monkeypatch.setattr(boosting, "ROWS_A_TASK", rows_a_task)
    x, y = points
    df = table(spark, x, y)
    model = boosting.fit_regressor(df, "x", "y", SMALL)
    want = brute_boost(x, brute_edges(x, 32), y.mean(), lambda score: (score - y, np.ones(len(y))), SMALL)
    got = {r["k"]: r["p"][0] for r in df.select("k", model.predict("x").alias("p")).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(want.tolist(), abs=1e-9)
    assert len(model.trees) == 12  # scores were stored once on the way


@pytest.mark.parametrize("classes", [2, 3])
def test_classes_equal_the_plain_builder(spark, points, classes):
    x, y = points
    label = np.minimum(np.digitize(y, [1.5, 4.0]), classes - 1)
    weights = {0: 2.0}
    df = table(spark, x, label)
    model = boosting.fit_classifier(df, "x", "y", classes, SMALL, weights)
    w = np.where(label == 0, 2.0, 1.0)
    want = []
    for k in [1] if classes == 2 else range(classes):
        prior = w[label == k].sum() / w.sum()

        def loss(score, k=k):
            p = 1 / (1 + np.exp(-score))
            return w * (p - (label == k)), w * np.maximum(p * (1 - p), 1e-12)

        want.append(1 / (1 + np.exp(-brute_boost(x, brute_edges(x, 32), np.log(prior / (1 - prior)), loss, SMALL))))
    want = np.column_stack([1 - want[0], want[0]]) if classes == 2 else np.column_stack(want) / np.sum(want, axis=0)[:, None]
    got = {r["k"]: r["p"] for r in df.select("k", model.predict("x").alias("p")).collect()}
    assert np.array([got[i] for i in range(len(y))]) == pytest.approx(want, abs=1e-9)
    assert (want.argmax(1) == label).mean() > 0.8


def test_boosting_of_odd_tables(spark):
    same = table(spark, np.ones((30, 2)), np.full(30, 4.0))
    model = boosting.fit_regressor(same, "x", "y")
    assert model.trees == () and {r[0][0] for r in same.select(model.predict("x")).collect()} == {4.0}
    empty = boosting.fit_regressor(same.where("false"), "x", "y")
    assert (empty.trees, empty.base) == ((), 0.0)


def test_replayed_stages_come_to_the_prediction(spark, points):
    x, y = points
    df = table(spark, x, y)
    model = boosting.fit_regressor(df, "x", "y", SMALL)
    told = df.select("k", "x", model.predict("x").alias("p"), model.replay("x").alias("replay"))
    for r in told.collect():
        assert [t["tree"] for t in r["replay"]] == list(range(12))
        assert r["replay"][-1]["so_far"] == pytest.approx(r["p"])
        assert model.base + 0.1 * sum(t["value"][0] for t in r["replay"]) == pytest.approx(r["p"][0])
        assert all(t["path"][0] == 0 and model.trees[t["tree"]].feature[t["path"][-1]] == -1 for t in r["replay"])
    steps = trees.conditions(told, model, "x", list("abcd"), ["k"]).where("k < 40").collect()
    for s in steps:
        value = x[s["k"], "abcd".index(s["feature"])]
        assert s["goes"] == ("right" if value > s["threshold"] else "left")
    assert len(steps) == sum(len(t["path"]) - 1 for r in told.where("k < 40").collect() for t in r["replay"])
    nodes = model.nodes(spark)
    assert nodes.where("node = 0 AND rows = 500").count() == 12


@pytest.mark.parametrize("family", ["tree", "forest", "boosting"])
def test_mllib_models_replay_to_their_own_predictions(spark, points, family):
    x, y = points
    df = table(spark, np.nan_to_num(x), y)
    rows = df.select("k", "x", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    fitted = models.REGRESSORS[family](3).fit(rows)
    ensemble = trees.from_mllib(fitted, spark)
    for r in fitted.transform(rows).select("prediction", ensemble.predict("x").alias("p"), ensemble.replay("x").alias("replay")).collect():
        assert r["p"][0] == pytest.approx(r["prediction"]) == r["replay"][-1]["so_far"][0]


@pytest.mark.parametrize("family", ["tree", "forest"])
def test_votes_of_mllib_classifiers(spark, points, family):
    x, y = points
    df = table(spark, np.nan_to_num(x), np.digitize(y, [1.5, 4.0]))
    rows = df.select("k", "x", array_to_vector("x").alias("features"), F.col("y").alias("label"))
    fitted = models.CLASSIFIERS[family](3, None).fit(rows)
    ensemble = trees.from_mllib(fitted, spark)
    for r in fitted.transform(rows).select("probability", ensemble.predict("x").alias("p"), ensemble.replay("x").alias("replay")).collect():
        assert r["p"] == pytest.approx(r["probability"].toArray().tolist())
        votes = np.mean([t["value"] for t in r["replay"]], axis=0)
        assert votes.tolist() == pytest.approx(r["p"])


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_rows_of_the_same_codes_are_stored_once(spark, points, task):
    """A table fifty times as long, with the same values, makes passes no longer."""
    x, y = points
    y = y if task == "regression" else (y > 2).astype(float)
    df = table(spark, x, y)
    edges = boosting.bin_edges(df, "x", 4, 4)
    once, _ = boosting.coded(df, "x", "y", F.lit(2.0), edges, [0.0], task)
    often, _ = boosting.coded(df.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(50)))), "x", "y", F.lit(2.0), edges, [0.0], task)
    assert once.count() == often.count() < 300
    sums = lambda rows: rows.agg(F.sum("rows"), F.sum("weight"), F.sum(F.col("weight") * F.col("y"))).first()
    assert tuple(sums(once)) == pytest.approx((500, 1000, 2 * y.sum()))
    assert tuple(sums(often)) == pytest.approx((25_000, 50_000, 100 * y.sum()))


def test_replay_in_arrays(spark):
    """Trees of different depths, a null row, and a model without trees."""
    a = trees.Tree(np.array([0, -1, 1, -1, -1]), np.array([1.0, 0, 2.0, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.array([[0.0], [1.0], [0.0], [2.0], [3.0]]), np.ones(5))
    b = trees.Tree(np.array([-1]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([[5.0]]), np.ones(1))
    rows = spark.createDataFrame([(0, [0.0, 9.0]), (1, [3.0, 1.0]), (2, [3.0, 3.0]), (3, None)], "k long, x array<double>")
    told = {r["k"]: [(t["tree"], t["path"], t["value"], t["so_far"]) for t in r["r"]] for r in rows.select("k", trees.Ensemble((a, b), (1.0, 0.5), 10.0, "sum").replay("x").alias("r")).collect()}
    last = lambda path, v: [(0, path, [v], [10 + v]), (1, [0], [5.0], [12.5 + v])]
    assert told == {0: last([0, 1], 1.0), 1: last([0, 2, 3], 2.0), 2: last([0, 2, 4], 3.0), 3: last([0, 1], 1.0)}
    assert {tuple(r[0]) for r in rows.select(trees.Ensemble((), (), 1.0, "sum").replay("x")).collect()} == {()}
    assert trees.lists_of(np.arange(3), np.array([2, 0, 1])).to_pylist() == [[0, 1], [], [2]]


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_a_pass_serves_two_levels(spark, points, monkeypatch, depth):
    """Where one task has all rows: half the passes, and the trees that a pass for each level gives."""
    x, y = points
    df = table(spark, x, np.minimum(np.digitize(y, [1.5, 4.0]), 2))
    passes = []
    histograms = boosting.Boosters.histograms
    monkeypatch.setattr(boosting.Boosters, "histograms", lambda self, *given: passes.append(1) or histograms(self, *given))
    fit = lambda: boosting.fit_classifier(df, "x", "y", 3, boosting.Settings(rounds=3, depth=depth, bins=16))
    fast = fit()
    assert len(passes) == 3 * -(-depth // 2)
    monkeypatch.setattr(boosting, "PAIRS", 0)
    slow = fit()
    assert len(passes) == 3 * -(-depth // 2) + 3 * depth
    for a, b in zip((t for e in fast.boosters for t in e.trees), (t for e in slow.boosters for t in e.trees), strict=True):
        # The order of nodes is the same too.
        assert (a.feature.tolist(), a.threshold.tolist(), a.left.tolist(), a.rows.tolist()) == (b.feature.tolist(), b.threshold.tolist(), b.left.tolist(), b.rows.tolist())
        assert a.value == pytest.approx(b.value, abs=1e-12)
