"""A network of one hidden ReLU layer, fitted by full-batch Adam over all rows.

Rows are stored packed, thousands to a block. Each epoch every task adds up the gradient of its rows in
matrix products; Spark adds up the tasks' gradients by weight, and the driver,
which holds the weights and nothing of the rows, takes the step. Starts are drawn
from a seed (normal, with the variance of He), so that the same rows give the same
network up to the order in which sums are rounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.boosting import tasks_for, width_of
from quern.operators.trees import matrix
from quern.sources.stored import discard, stored

# How the network is sized and trained.
EPOCHS, RATE, DECAY = 300, 0.01, 1e-4
MOMENTUM, SCALE, TINY = 0.9, 0.999, 1e-8
LEAST_HIDDEN, MOST_HIDDEN = 16, 64
PACKED = "y binary, x binary"
#: Numbers of a block: 4 MiB of them, or one row.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Shape:
    """Sizes of the layers; all weights are one vector: first layer, its bias, second layer, its bias."""

    inputs: int
    hidden: int
    outputs: int

    def parts(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.inputs * self.hidden, self.hidden * self.outputs
        cuts = np.cumsum([a, self.hidden, b, self.outputs])
        return weights[: cuts[0]].reshape(self.inputs, self.hidden), weights[cuts[0] : cuts[1]], weights[cuts[1] : cuts[2]].reshape(self.hidden, self.outputs), weights[cuts[2] : cuts[3]]

    @property
    def size(self) -> int:
        return (self.inputs + 1) * self.hidden + (self.hidden + 1) * self.outputs

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        one = rng.normal(0, np.sqrt(2 / max(1, self.inputs)), self.inputs * self.hidden)
        two = rng.normal(0, np.sqrt(2 / self.hidden), self.hidden * self.outputs)
        return np.concatenate([one, np.zeros(self.hidden), two, np.zeros(self.outputs)])

    def decayed(self) -> np.ndarray:
        """1 for what is pulled to zero: the layers, not the biases."""
        return np.concatenate([np.ones(self.inputs * self.hidden), np.zeros(self.hidden), np.ones(self.hidden * self.outputs), np.zeros(self.outputs)])

    def forward(self, weights: np.ndarray, x: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
        """(hidden, outputs): activations, and shares of classes or a value."""
        w1, b1, w2, b2 = self.parts(weights)
        hidden = np.maximum(x @ w1 + b1, 0)
        out = hidden @ w2 + b2
        if classes:
            out = np.exp(out - out.max(axis=1, keepdims=True))
            out /= out.sum(axis=1, keepdims=True)
        return hidden, out

    def gradient(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, classes: bool) -> np.ndarray:
        """The summed gradient of the rows' loss: cross entropy or squares."""
        hidden, out = self.forward(weights, x, classes)
        delta = out - (y[:, None] == np.arange(self.outputs)) if classes else 2 * (out - y[:, None])
        back = (delta @ self.parts(weights)[2].T) * (hidden > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (hidden.T @ delta).ravel(), delta.sum(axis=0)])


@dataclass(frozen=True)
class Network:
    shape: Shape
    weights: np.ndarray
    classes: bool
    mean: float = 0.0
    spread: float = 1.0

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = self.shape.forward(self.weights, np.nan_to_num(x), self.classes)[1]
        return out if self.classes else out * self.spread + self.mean

    def predict(self, features: Column | str) -> Column:
        """The classes' shares, or the value, of an array of features."""

        @F.arrow_udf("array<double>")
        def told(vectors: pa.Array) -> pa.Array:
            return pa.array(list(self.scores(matrix(vectors))), pa.list_(pa.float64()))

        return told(features)


def summed_gradient(rows: DataFrame, shape: Shape, weights: np.ndarray, classes: bool, tasks: int) -> np.ndarray:
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape.size)
        for batch in batches:
            for y, x in zip(batch[0], batch[1], strict=True):
                y, x = (np.frombuffer(block.as_buffer(), np.float64) for block in (y, x))
                total += shape.gradient(weights, x.reshape(len(y), shape.inputs), y, classes)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape.size, dtype=np.int32)), pa.array(total)], names=["i", "g"])

    parts = rows.mapInArrow(add_up, "i int, g double")
    if tasks > 1:  # one task's sums are the sums
        parts = parts.groupBy("i").agg(F.sum("g").alias("g"))
    sums = parts.toArrow()  # a number for each weight
    out = np.zeros(shape.size)
    out[sums["i"].to_numpy()] = sums["g"].to_numpy()
    return out


def packed(df: DataFrame, features: str, label: Column, n: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, x = batch[0].to_numpy(zero_copy_only=False), np.nan_to_num(matrix(batch[1]))
            cuts = range(0, len(y), max(1, BLOCK // max(1, x.shape[1])))
            blocks = [[v[at : at + cuts.step].tobytes() for at in cuts] for v in (y, x)]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.binary()) for b in blocks], names=["y", "x"])

    rows = df.select(label.cast("double").alias("y"), F.col(features).alias("x")).where("y IS NOT NULL")
    return stored(rows.mapInArrow(pack, PACKED).coalesce(tasks_for(n)), "network")


def fit(df: DataFrame, features: str, label: str, classes: int = 0, seed: int = 42, epochs: int = EPOCHS, hidden: int | None = None) -> Network:
    """A classifier of ``classes`` (0, 1, ...), or with 0 a regression. features: arrays of doubles, one length; nulls count as 0."""
    width = width_of(df, features)
    y = F.col(label).cast("double")
    n, mean, spread = df.agg(F.count(y), F.avg(y), F.stddev_pop(y)).first()
    mean, spread = (0.0, 1.0) if classes else (mean or 0.0, spread or 1.0)
    shape = Shape(width, hidden or max(LEAST_HIDDEN, min(MOST_HIDDEN, 2 * width)), classes or 1)
    weights = shape.start(seed)
    if not n:
        return Network(shape, weights, bool(classes), mean, spread)
    rows = packed(df, features, (y - mean) / spread, n)
    first, second = np.zeros(shape.size), np.zeros(shape.size)
    for t in range(1, epochs + 1):
        g = summed_gradient(rows, shape, weights, bool(classes), tasks_for(n)) / n + DECAY * shape.decayed() * weights
        first, second = MOMENTUM * first + (1 - MOMENTUM) * g, SCALE * second + (1 - SCALE) * g * g
        weights = weights - RATE * (first / (1 - MOMENTUM**t)) / (np.sqrt(second / (1 - SCALE**t)) + TINY)
    discard(rows)
    return Network(shape, weights, bool(classes), mean, spread)
