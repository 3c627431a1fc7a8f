"""What stands behind a metric: intervals, segments, groups, conformal sets, policies, explanations."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stats import normal_quantile, wilson
from quern.operators.metrics import argmax
from quern.operators.ordering import all_of, numbered, running
from quern.operators.resample import parts_of
from quern.sources.stored import stored


def bootstrap(df: DataFrame, key: str, value: Column, resamples: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(estimate, low, high) of a mean by the Poisson bootstrap.

    Every row's weight in a resample is a Poisson(1) count drawn from a hash of
    (seed, resample, key): resamples need no order, no copy of the rows, and are
    the same for every model that is compared on the same keys. A batch of rows
    becomes one sum of weights and values for each resample.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, wv = np.zeros(resamples), np.zeros(resamples)
            for (values,), drawn in parts_of(batch, resamples):
                w += drawn[:, 1:].sum(axis=0)
                wv += values @ drawn[:, 1:]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples, dtype=np.int32)), pa.array(w), pa.array(wv)], names=["b", "w", "wv"])

    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_k"), value.cast("double").alias("_v")).where("_v IS NOT NULL")
    means = rows.mapInArrow(sums, "b int, w double, wv double").groupBy("b").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")).crossJoin(F.broadcast(rows.agg(F.avg("_v").alias("estimate")))).select("estimate", "low", "high")


def segments(df: DataFrame, segment: str, truth: str, predicted: str, least: int = 8, most: int = 8) -> DataFrame:
    """(segment, n, accuracy) of the largest segments of ``least`` rows or more."""
    found = df.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return found.where(F.col("n") >= least).orderBy(F.desc("n"), "segment").limit(most)


def group_audit(df: DataFrame, group: str, truth: str, predicted: str, least: int = 20, least_cases: int = 10, level: float = 0.95) -> DataFrame:
    """Selection, recall, false alarms and accuracy by group, with score intervals and gaps to the largest group."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"), F.count_if(p).alias("selected"), F.count_if(t).alias("positives"), F.count_if(t & p).alias("hits"), F.count_if(~t & p).alias("alarms"), F.count_if(t == p).alias("right")
    ).where(F.col("n") >= least)
    z = normal_quantile(0.5 + level / 2)
    rate = lambda k, n: F.when(n >= least_cases, k / F.when(n > 0, n))
    negatives = F.col("n") - F.col("positives")
    rates = {"selection": (F.col("selected"), F.col("n")), "recall": (F.col("hits"), F.col("positives")), "false_alarm": (F.col("alarms"), negatives), "accuracy": (F.col("right"), F.col("n"))}
    columns = []
    for name, (k, n) in rates.items():
        share = rate(k, n)
        low, high = wilson(share, n, z)
        columns += [share.alias(name), F.when(share.isNotNull(), low).alias(f"{name}_low"), F.when(share.isNotNull(), high).alias(f"{name}_high")]
    found = counts.select("group", "n", *columns)
    largest = found.agg(F.min_by(F.struct(*rates), F.struct(-F.col("n"), "group")).alias("_first"))  # one row
    return found.crossJoin(F.broadcast(largest)).select(*found.columns, *[(F.col(name) - F.col(f"_first.{name}")).alias(f"{name}_gap") for name in rates])


def value_audit(df: DataFrame, group: str, key: str, truth: str, predicted: str, least: int = 20, most: int = 8, resamples: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bias and absolute error of a predicted number by group, with intervals, and gaps to the largest group with theirs.

    The ``most`` largest groups of ``least`` rows and more, the largest first (ties by
    name); no rows where fewer than two are large enough to compare. Rows without a
    group, a truth or a prediction are left out. Every row's weight in a resample is
    the same for both figures; tasks keep sums for each group and resample. A gap is
    ``decisive`` if its interval doesn't hold zero.
    """
    error = F.col(predicted).cast("double") - F.col(truth).cast("double")
    rows = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_k"), F.trim(F.col(group).cast("string")).alias("_g"), error.alias("_e")).where("_g <> '' AND _e IS NOT NULL")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "_g").limit(most).collect()
    names = [r["_g"] for r in sizes] if len(sizes) > 1 else []
    at = {g: i for i, g in enumerate(names)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 3, resamples + 1))
        for batch in batches:
            for (groups, errors), w in parts_of(batch, resamples):
                place = np.array([at[g] for g in groups])
                for i in np.unique(place):
                    e = errors[place == i]
                    total[i] += np.vstack([np.ones(len(e)), e, np.abs(e)]) @ w[place == i]
        for i, part in enumerate(total):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples + 1, i, np.int32)), pa.array(np.arange(resamples + 1, dtype=np.int32)), *map(pa.array, part)], names=["i", "b", "w", "e", "a"])

    drawn = rows.where(F.col("_g").isin(*names)).mapInArrow(sums, "i int, b int, w double, e double, a double").groupBy("i", "b").agg(*[F.sum(c).alias(c) for c in ("w", "e", "a")])
    each = drawn.select("i", "b", F.col("w").alias("n"), F.try_divide(F.col("e"), F.col("w")).alias("bias"), F.try_divide(F.col("a"), F.col("w")).alias("mae"))
    first = each.where("i = 0").select("b", F.col("bias").alias("bias_of"), F.col("mae").alias("mae_of"))  # a row for each resample
    gaps = each.join(first, "b").withColumns({f"{c}_gap": F.col(c) - F.col(f"{c}_of") for c in ("bias", "mae")})
    tail, figures = (1 - level) / 2, []
    for c in ("bias", "mae", "bias_gap", "mae_gap"):
        figures += [F.max(F.when(F.col("b") == 0, F.col(c))).alias(c), *[F.percentile(F.when(F.col("b") > 0, F.col(c)), F.lit(q)).alias(f"{c}_{end}") for end, q in (("low", tail), ("high", 1 - tail))]]  # one value a resample
    found = gaps.groupBy("i").agg(F.max(F.when(F.col("b") == 0, F.col("n"))).cast("long").alias("n"), *figures).orderBy("i")
    decisive = [((F.col(f"{c}_gap_low") > 0) | (F.col(f"{c}_gap_high") < 0)).alias(f"{c}_decisive") for c in ("bias", "mae")]
    name = F.get(F.array(*[F.lit(g) for g in names]).cast("array<string>"), F.col("i"))
    return found.select(name.alias("group"), *found.columns[1:], *decisive)


def conformal_quantile(scores: DataFrame, score: str, alpha: float) -> DataFrame:
    """(quantile): the ceil((n + 1)(1 - alpha))-th least score; no row for too few scores."""
    counted = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("k"))
    total = counted.agg(F.sum("k").alias("n"))
    wanted = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    found = running(counted, ["s"], {"upto": "k"}).crossJoin(F.broadcast(total)).where((F.col("upto") >= wanted) & (wanted <= F.col("n")))
    return found.orderBy("s").limit(1).select(F.col("s").alias("quantile"))


def conformal_coverage(calibration: DataFrame, test: DataFrame, score: str, alpha: float) -> DataFrame:
    """(quantile, n, covered): the share of test scores within the calibration quantile."""
    q = conformal_quantile(calibration, score, alpha)
    return test.crossJoin(F.broadcast(q)).groupBy("quantile").agg(F.count("*").alias("n"), F.avg((F.col(score) <= F.col("quantile")).cast("double")).alias("covered"))


def multiclass_policy(probabilities: Column, thresholds: list[float]) -> Column:
    """The class with the greatest (p - t) / (1 - t); -1 where none reaches its threshold."""
    over = F.array(*[(F.get(probabilities, F.lit(i)) - t) / (1 - t) for i, t in enumerate(thresholds)])
    return F.when(F.array_max(over) >= 0, argmax(over)).otherwise(-1)


def permutation_importance(df: DataFrame, features: list[str], predict: Column, truth: str, key: str, seed: int = 42) -> DataFrame:
    """(feature, rise): how much the squared error rises when a feature is shuffled among rows.

    Rows are numbered once, in a hash order; each takes the value of the row some
    places on, another distance for each feature.
    """
    base = df.agg(F.avg(F.pow(F.col(truth) - predict, 2.0)).alias("base"))
    rows = stored(numbered(df.withColumn("_o", F.xxhash64(key, F.lit(seed))), ["_o", key], "_n"), "shuffled")
    n = rows.count()
    distance = random.Random(seed)
    parts = []
    for c in features:
        moved = rows.select(F.pmod(F.col("_n") + F.lit(distance.randrange(1, max(2, n))), F.lit(max(1, n))).alias("_n"), c)
        shuffled = rows.drop(c).join(moved, "_n")
        parts.append(shuffled.agg(F.avg(F.pow(F.col(truth) - predict, 2.0)).alias("mse")).crossJoin(F.broadcast(base)).select(F.lit(c).alias("feature"), (F.col("mse") - F.col("base")).alias("rise")))
    return all_of(parts)


def partial_dependence(df: DataFrame, feature: str, predict: Column, points: int = 20) -> DataFrame:
    """(x, mean): the mean prediction with ``feature`` held at each of evenly spaced values; one pass over the rows."""
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    grid = [low + (high - low) * i / (points - 1) for i in range(points)]
    each = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(x)) for x in grid])))
    return each.groupBy(F.col(feature).alias("x")).agg(F.avg(predict).alias("mean"))


def counterfactuals(rows: DataFrame, grids: dict[str, list[float]], predict: Column, wanted: Column, key: str, keep: int = 3) -> DataFrame:
    """(key, feature, value, predicted): the smallest single changes that give the wanted outcome, by distance in grid steps, ``keep`` for each row.

    A row's changes are tried and chosen within the row: only those that are told become rows.
    """
    tried = rows.withColumns({f"_was_{c}": F.col(c) for c in grids})
    told = []
    for c, values in grids.items():
        distance = lambda v: F.abs(F.col(f"_was_{c}") - F.lit(v)) / ((max(values) - min(values)) or 1.0)  # noqa: B023, E731
        for v in map(float, values):
            change = F.struct(distance(v).alias("d"), F.lit(c).alias("feature"), F.lit(v).alias("value"), F.col("predicted").alias("predicted"))
            told.append(f"_change_{len(told)}")
            tried = tried.withColumn(c, F.lit(v)).withColumn("predicted", predict).withColumn(told[-1], F.when(wanted & (distance(v) > 0), change))
        tried = tried.withColumn(c, F.col(f"_was_{c}"))
    nearest = F.slice(F.array_sort(F.filter(F.array(*told), lambda change: change.isNotNull())), 1, keep)
    return tried.select(key, F.explode(nearest).alias("_c")).select(key, "_c.feature", "_c.value", "_c.predicted")


def ledger_levels(readings: DataFrame) -> DataFrame:
    """(test_set, configs, level): how often a test set was read with distinct configurations: fresh, 2, 5, 10 and more."""
    n = F.col("configs")
    level = F.when(n >= 10, "worn").when(n >= 5, "used").when(n >= 2, "seen").otherwise("fresh")
    return readings.groupBy("test_set").agg(F.count_distinct("config").alias("configs")).withColumn("level", level)


def performance_signal(reference: DataFrame, current: DataFrame, right: str, level: float = 0.95) -> DataFrame:
    """(reference, current, low, high, verdict): retrain only when accuracy dropped measurably."""
    from quern.functions.stats import share_difference

    z = normal_quantile(0.5 + level / 2)
    a = reference.agg(F.avg(F.col(right).cast("double")).alias("reference"), F.count("*").alias("_n"))
    b = current.agg(F.avg(F.col(right).cast("double")).alias("current"), F.count("*").alias("_m"))
    low, high = share_difference(F.col("reference"), F.col("_n"), F.col("current"), F.col("_m"), z)
    both = a.crossJoin(F.broadcast(b)).select("reference", "current", low.alias("low"), high.alias("high"))  # one row each
    return both.withColumn("verdict", F.when(F.col("low") > 0, "retrain").when(F.col("reference") > F.col("current"), "watch").otherwise("stable"))
