"""Paired bootstrap intervals of any metric: every model is measured on the same resamples.

A resample is a Poisson(1) weight for each row, drawn from a hash of (seed, resample,
key): no order, no copies, and the same weights for all models, so that the
differences between models come from the same draws. The first column of weights is
all ones, which gives the metric itself. Means (accuracy, errors) are sums of weights;
F1 comes from a weighted confusion table for each resample; the area under the curve
from rows dealt into ranges of score, where every range adds up what its positives
outweigh within it, and what lies in the ranges below is added. A task keeps sums
for each resample, whatever the number of its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import all_of, in_ranges
from quern.sources.stored import stored

RESAMPLES, LEVEL, SEED = 1000, 0.95, 42
#: Fewer rows say nothing about an interval.
LEAST_ROWS = 8
#: Rows whose weights are laid out at once.
AT_ONCE = 1024
#: Inverse of the Poisson(1) distribution, to where its tail is below 1e-9.
STEPS = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
#: Whether more is better.
METRICS = {"accuracy": True, "rmse": False, "mae": False, "macro_f1": True, "auc": True}


def weights(keys: np.ndarray, resamples: int) -> np.ndarray:
    """rows x (resamples + 1): ones, then the weight of each row in each resample. keys: 64-bit hashes."""
    x = keys.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) >> np.uint64(11)
    return np.concatenate([np.ones((len(keys), 1)), np.searchsorted(STEPS, x / float(1 << 53), side="right")], axis=1)


def parts_of(batch: pa.RecordBatch, resamples: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """A batch a few rows at a time: its columns but the first, and the rows' weights."""
    columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    for low in range(0, batch.num_rows, AT_ONCE):
        some = [c[low : low + AT_ONCE] for c in columns]
        yield some[1:], weights(some[0], resamples)


def told(sums: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """(kind, b, <a column for each row of sums>)."""
    b = np.arange(sums.shape[1], dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), kind, np.int32)), pa.array(b), *map(pa.array, sums)], names=["kind", "b", *(f"s{i}" for i in range(len(sums)))])


def means(rows: DataFrame, models: list[str], resamples: int) -> DataFrame:
    """(model, b, value): the weighted mean of each model's column."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models) + 1, resamples + 1))
        for batch in batches:
            for values, w in parts_of(batch, resamples):
                total += np.vstack([np.ones(len(w)), *values]) @ w
        yield from told(total, 0)

    schema = "kind int, b int, " + ", ".join(f"s{i} double" for i in range(len(models) + 1))
    sums = rows.select("_k", *models).mapInArrow(add_up, schema).groupBy("b").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(models) + 1)])
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.try_divide(F.col(f"s{i + 1}"), F.col("s0")).alias("value")) for i, m in enumerate(models)])
    return sums.select("b", F.explode(each).alias("e")).select("e.model", "b", "e.value")


def confusions(rows: DataFrame, models: list[str], classes: int, resamples: int) -> DataFrame:
    """(model, b, value): macro F1 over the classes that a resample holds or predicts. rows: classes as 0, 1, ..."""
    cells = classes * classes

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), cells, resamples + 1))
        for batch in batches:
            for (truth, *said), w in parts_of(batch, resamples):
                for m, p in enumerate(said):
                    cell = (truth * classes + p).astype(int)
                    for c in np.unique(cell):
                        total[m, c] += w[cell == c].sum(axis=0)
        for m in range(len(models)):
            for c in np.flatnonzero(total[m, :, 0]):
                yield from told(total[m, c][None], m * cells + int(c))

    table = rows.select("_k", "_y", *models).mapInArrow(add_up, "kind int, b int, s0 double").groupBy("kind", "b").agg(F.sum("s0").alias("w"))
    cell = table.select(F.floor(F.col("kind") / cells).cast("int").alias("m"), F.floor((F.col("kind") % cells) / classes).cast("int").alias("t"), (F.col("kind") % classes).cast("int").alias("p"), "b", "w")
    per = cell.select("m", "b", "w", F.explode(F.array_distinct(F.array("t", "p"))).alias("k"), "t", "p").groupBy("m", "b", "k").agg(
        F.sum(F.when((F.col("t") == F.col("k")) & (F.col("p") == F.col("k")), F.col("w")).otherwise(0.0)).alias("hit"),
        F.sum(F.when(F.col("t") == F.col("k"), F.col("w")).otherwise(0.0)).alias("held"), F.sum(F.when(F.col("p") == F.col("k"), F.col("w")).otherwise(0.0)).alias("said"),
    )
    f1 = F.avg(2 * F.col("hit") / (F.col("held") + F.col("said")))
    names = F.array(*[F.lit(m) for m in models])
    return per.where("held + said > 0").groupBy("m", "b").agg(f1.alias("value")).select(F.get(names, F.col("m")).alias("model"), "b", "value")


def areas(rows: DataFrame, model: str, resamples: int) -> DataFrame:
    """(model, b, value): the area under the curve of a model's scores; equal scores count half."""
    ranges = in_ranges(rows.select("_k", F.col("_y").cast("double").alias("_y"), F.col(model).alias("_s")), ["_s"])

    def outweigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Within a range: positives' and negatives' weight, and what positives outweigh. A score's rows are held until the next score."""
        positive, negative, above, tied = (np.zeros(resamples + 1) for _ in range(4))
        tied_up, score, part = np.zeros(resamples + 1), None, 0

        def close() -> None:
            nonlocal above, negative, positive
            above = above + tied_up * (negative + tied / 2)
            positive, negative = positive + tied_up, negative + tied

        for batch in batches:
            part = batch.column("_p")[0].as_py() if batch.num_rows else part
            for (y, s, _), w in parts_of(batch, resamples):
                starts = np.append(0, np.flatnonzero(s[1:] != s[:-1]) + 1)
                up, down = (np.add.reduceat(w * (y == k)[:, None], starts, axis=0) for k in (1, 0))
                for i, at in enumerate(starts):
                    if s[at] != score:
                        close()
                        score, tied, tied_up = s[at], down[i], up[i]
                    else:
                        tied, tied_up = tied + down[i], tied_up + up[i]
        close()
        yield from told(np.vstack([positive, negative, above]), part)

    sums = ranges.select("_k", "_y", "_s", "_p").mapInArrow(outweigh, "kind int, b int, s0 double, s1 double, s2 double")
    below = F.coalesce(F.sum("s1").over(Window.partitionBy("b").orderBy("kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # a row for each range
    found = sums.where("s0 + s1 > 0").withColumn("below", below).groupBy("b").agg(F.try_divide(F.sum(F.col("s2") + F.col("s0") * F.col("below")), F.sum("s0") * F.sum("s1")).alias("value"))
    return found.select(F.lit(model).alias("model"), "b", "value")


def resampled(df: DataFrame, key: str, truth: str, models: dict[str, Column], metric: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """(model, b, value), stored: the metric of every model on all rows (b = 0) and on each resample. Rows where anything is null are left out."""
    if metric not in METRICS:
        raise ValueError(f"no metric {metric}")
    names = list(models)
    y = F.col(truth)
    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_k"), y.alias("_y"), *[c.alias(m) for m, c in models.items()]).dropna()
    if metric == "macro_f1":
        values = sorted({r[0] for c in ("_y", *names) for r in rows.select(c).distinct().collect()})  # the classes
        at = lambda c: F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1
        coded = rows.select("_k", *[at(c).alias(c) for c in ("_y", *names)])
        return stored(confusions(coded, names, max(1, len(values)), resamples), "resampled")
    if metric == "auc":
        return stored(all_of([areas(rows, m, resamples) for m in names]), "resampled")
    loss = {"accuracy": lambda m: (F.col("_y") == F.col(m)).cast("double"), "rmse": lambda m: F.pow(F.col("_y") - F.col(m), 2.0), "mae": lambda m: F.abs(F.col("_y") - F.col(m))}[metric]
    found = means(rows.select("_k", *[loss(m).cast("double").alias(m) for m in names]), names, resamples)
    return stored(found.withColumn("value", F.sqrt("value")) if metric == "rmse" else found, "resampled")


def paired_intervals(df: DataFrame, key: str, truth: str, models: dict[str, Column], metric: str, against: str, resamples: int = RESAMPLES, level: float = LEVEL, seed: int = SEED) -> DataFrame:
    """(model, estimate, low, high, delta, delta_low, delta_high, win_share, decisive) of each model, the best first.

    delta is how much better a model is than ``against``, in the metric's own
    direction; win_share the share of resamples where it is strictly better; decisive
    whether the interval of the delta lies above zero. Resamples where the metric
    isn't defined (a class is missing) don't count. No rows for fewer than eight.
    """
    if against not in models:
        raise ValueError(f"no model {against}")
    found = resampled(df, key, truth, models, metric, resamples, seed)
    sign = 1.0 if METRICS[metric] else -1.0
    base = found.where(F.col("model") == against).select("b", F.col("value").alias("_base"))
    both = found.join(base, "b").withColumn("_delta", sign * (F.col("value") - F.col("_base")))
    drawn = F.col("b") > 0
    tail = (1 - level) / 2
    interval = lambda c, q: F.percentile(F.when(drawn, F.col(c)), F.lit(q))  # noqa: E731  one value a resample
    rows = both.groupBy("model").agg(
        F.max(F.when(~drawn, F.col("value"))).alias("estimate"), interval("value", tail).alias("low"), interval("value", 1 - tail).alias("high"),
        F.max(F.when(~drawn, F.col("_delta"))).alias("delta"), interval("_delta", tail).alias("delta_low"), interval("_delta", 1 - tail).alias("delta_high"),
        F.avg(F.when(drawn, (F.col("_delta") > 0).cast("double"))).alias("win_share"),
    )
    enough = df.select(F.lit(1)).limit(LEAST_ROWS).count() >= LEAST_ROWS
    return rows.withColumn("decisive", F.col("delta_low") > 0).where(F.lit(enough)).orderBy(F.desc(sign * F.col("estimate")), "model")
