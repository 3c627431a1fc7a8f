"""The network against finite differences and a plain loop over epochs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting, network


def loss(shape, weights, x, y, classes):
    out = shape.forward(weights, x, classes)[1]
    return -np.log(out[np.arange(len(y)), y.astype(int)]).sum() if classes else ((out[:, 0] - y) ** 2).sum()


@pytest.mark.parametrize("classes", [3, 0])
def test_gradient_equals_finite_differences(classes):
    rng = np.random.default_rng(1)
    shape = network.Shape(4, 7, classes or 1)
    x, y, w = rng.normal(size=(30, 4)), rng.integers(0, 3, 30).astype(float), shape.start(5)
    got = shape.gradient(w, x, y, bool(classes))
    for i in range(shape.size):
        step = np.zeros(shape.size)
        step[i] = 1e-6
        want = (loss(shape, w + step, x, y, bool(classes)) - loss(shape, w - step, x, y, bool(classes))) / 2e-6
        assert got[i] == pytest.approx(want, rel=1e-4, abs=1e-5)


def table(spark, x, y):
    return spark.createDataFrame([(i, [float(v) for v in r], None if t is None else float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "k long, x array<double>, y double").repartition(3)


@pytest.mark.parametrize(("classes", "rows_a_task"), [(3, 1 << 16), (0, 50)])
def test_fit_equals_a_loop_over_all_rows(spark, monkeypatch, classes, rows_a_task):
    """In one task, and in several whose gradients are added up."""
    monkeypatch.setattr(boosting, "ROWS_A_TASK", rows_a_task)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = np.digitize(x[:, 0] + x[:, 1] ** 2, [0.0, 1.5]).astype(float) if classes else 3 * x[:, 0] - x[:, 1] + 7
    model = network.fit(table(spark, x, y), "x", "y", classes, seed=3, epochs=25)
    shape, target = model.shape, y if classes else (y - y.mean()) / y.std()
    w, m, v = shape.start(3), 0.0, 0.0
    for t in range(1, 26):
        g = shape.gradient(w, x, target, bool(classes)) / len(y) + 1e-4 * shape.decayed() * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert shape.hidden == 16 and model.weights == pytest.approx(w, abs=1e-9)


def test_network_learns_and_predicts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    df = table(spark, x, y)
    model = network.fit(df, "x", "y", 2, epochs=150)
    told = {r["k"]: r["p"] for r in df.select("k", model.predict("x").alias("p")).collect()}
    assert np.mean([np.argmax(told[i]) == y[i] for i in range(400)]) > 0.9
    assert all(sum(p) == pytest.approx(1) for p in told.values())


def test_network_of_odd_tables(spark):
    df = table(spark, np.ones((5, 2)), [1.0, 1.0, None, 1.0, 1.0])
    model = network.fit(df, "x", "y", 0, epochs=3)
    assert (model.mean, model.spread) == (1.0, 1.0)
    empty = network.fit(df.where("false"), "x", "y", 0)
    assert empty.shape.inputs == 0 and df.select(empty.predict("x")).limit(0).count() == 0


def test_rows_are_packed_in_blocks(spark, monkeypatch):
    """Many rows to a stored block; whatever the blocks, the gradient is that of all rows."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(500, 3)), rng.integers(0, 2, 500)
    df = spark.createDataFrame([(list(map(float, r)), int(t)) for r, t in zip(x, y, strict=True)], "x array<double>, y int").coalesce(1)
    shape = network.Shape(3, 4, 2)
    want = shape.gradient(shape.start(1), x, y, True)
    for block, least, most in ((1 << 19, 1, 8), (30, 50, 60)):
        monkeypatch.setattr(network, "BLOCK", block)
        rows = network.packed(df, "x", F.col("y"), 500)
        assert least <= rows.count() <= most
        assert network.summed_gradient(rows, shape, shape.start(1), True, 1) == pytest.approx(want)
