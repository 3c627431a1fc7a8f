"""Scoring batches, watching them, and explaining or searching models."""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import drift, evaluate, metrics, models, resample, runs, split
from quern.sources.stored import stored

# How many sizes a learning curve has, how far they span, and the least of them.
CURVE_POINTS, CURVE_SPAN, CURVE_LEAST = 6, 16, 16

#: A prediction as a function of named columns, so that inputs can be replaced.
Predictor = Callable[[dict[str, Column]], Column]


def linear_predictor(model: models.Linear) -> Predictor:
    return lambda x: reduce(lambda a, b: a + b, [x[n] * w for n, w in zip(model.features, model.weights, strict=True)], F.lit(model.bias))


def predict_batch(df: DataFrame, features: list[str], predict: Predictor) -> DataFrame:
    """The input with ``predicted``; columns that are missing are refused by name."""
    gone = [c for c in features if c not in df.columns]
    if gone:
        raise ValueError(f"missing-columns:{','.join(gone)}")
    return df.withColumn("predicted", predict({c: df[c].cast("double") for c in features}))


def score_batch(df: DataFrame, truth: str, predicted: str, classes: list[object] | None = None) -> DataFrame:
    """One row: rows, labelled, unknown labels, and accuracy over the known ones."""
    known = F.col(truth).isNotNull() & (F.col(truth).isin(*classes) if classes else F.lit(True))
    return df.agg(
        F.count("*").alias("rows"), F.count(truth).alias("labelled"), F.count_if(F.col(truth).isNotNull() & ~known).alias("unknown"),
        F.avg(F.when(known, (F.col(truth) == F.col(predicted)).cast("double"))).alias("accuracy"),
    )


def check_production(reference: DataFrame, batch: DataFrame, numeric: list[str], words: list[str], right: str | None = None) -> DataFrame:
    """(signal, subject, value, verdict): drift of each column says watch at most; only a measured drop says retrain."""
    parts = []
    level = 1 - drift.FALSE_ALERTS / max(1, len(numeric) + len(words))
    for names, measure in ((numeric, drift.numeric_sides), (words, drift.categorical_sides)):
        if names:
            moved = drift.graded(measure(reference, batch, names), level)
            verdict = F.when(F.col("severity") == "stable", "stable").otherwise("watch")
            parts.append(moved.select(F.lit("drift").alias("signal"), F.col("column").alias("subject"), F.col("psi").alias("value"), verdict.alias("verdict")))
    if right:
        parts.append(evaluate.performance_signal(reference, batch, right).select(F.lit("performance").alias("signal"), F.lit(right).alias("subject"), F.col("current").alias("value"), "verdict"))
    return reduce(DataFrame.unionByName, parts)


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], words: list[str]) -> DataFrame:
    """(column, kind, psi, severity) of shared columns, and a row for each added or removed one."""
    level = 1 - drift.FALSE_ALERTS / max(1, len(numeric) + len(words))
    sides = ((numeric, drift.numeric_sides, "numeric"), (words, drift.categorical_sides, "categorical"))
    parts = [drift.graded(measure(reference, current, names), level).select("column", F.lit(kind).alias("kind"), "psi", "severity") for names, measure, kind in sides if names]
    changes = [(c, "added") for c in current.columns if c not in reference.columns] + [(c, "removed") for c in reference.columns if c not in current.columns]
    if changes:
        parts.append(reference.sparkSession.createDataFrame([(c, k, None, "moderate") for c, k in changes], "column string, kind string, psi double, severity string"))
    return reduce(DataFrame.unionByName, parts)


def what_if(df: DataFrame, features: list[str], predict: Predictor, changes: dict[str, float]) -> DataFrame:
    """The input with ``predicted`` and ``changed``: the prediction with some inputs replaced."""
    as_is = {c: F.col(c).cast("double") for c in features}
    return df.withColumns({"predicted": predict(as_is), "changed": predict(as_is | {c: F.lit(float(v)) for c, v in changes.items()})})


def shapley(df: DataFrame, key: str, features: list[str], predict: Predictor, permutations: int = 8, references: int = 24, seed: int = 42) -> DataFrame:
    """(key, feature, share): sampled Shapley values against reference rows, the first by hash order.

    For each row and reference, inputs turn from the reference's to the row's one
    by one along a few fixed permutations; a feature's share is its mean step.
    """
    refs = df.orderBy(split.hash_order(key, seed), key).limit(references).select(*[F.col(c).cast("double").alias(f"_r_{c}") for c in features])  # a bounded number of rows
    rng = random.Random(seed)
    orders = [rng.sample(features, len(features)) for _ in range(permutations)]
    steps = []
    for order in orders:
        x = {c: F.col(f"_r_{c}") for c in features}
        before = predict(x)
        for c in order:
            x = x | {c: F.col(c).cast("double")}
            after = predict(x)
            steps.append(F.struct(F.lit(c).alias("feature"), (after - before).alias("step")))
            before = after
    each = df.crossJoin(F.broadcast(refs)).select(key, F.explode(F.array(*steps)).alias("s"))
    return each.groupBy(key, "s.feature").agg(F.avg("s.step").alias("share"))


def word_effects(df: DataFrame, tokens: str, words: list[str], predict_tokens: Callable[[Column], Column]) -> DataFrame:
    """(word, rows, shift): how far taking a word out moves the prediction, on average over rows that hold it."""
    base = predict_tokens(F.col(tokens))
    each = [F.when(F.array_contains(tokens, w), F.struct(F.lit(w).alias("word"), (predict_tokens(F.array_remove(tokens, w)) - base).alias("d"))) for w in words]
    found = df.select(F.explode(F.array_compact(F.array(*each))).alias("e"))
    return found.groupBy("e.word").agg(F.count("*").alias("rows"), F.avg("e.d").alias("shift"))


def learning_curve(train: DataFrame, test: DataFrame, features: list[str], target: str, label: str, key: str, shares: tuple[float, ...] = (0.0625, 0.125, 0.25, 0.5, 1.0)) -> DataFrame:
    """(share, rmse): a linear model on nested samples; each holds the ones before it."""
    nested = split.nested_order(train, label, key)
    parts = []
    for s in shares:
        model = models.fit_linear(nested.where(F.col("place") <= s), features, target)
        told = test.withColumn("_p", model.predict())
        parts.append(metrics.regression(told, target, "_p").select(F.lit(s).alias("share"), "rmse"))
    return reduce(DataFrame.unionByName, parts)


def curve_sizes(rows: int, least: int) -> list[int]:
    """Up to six sizes from a sixteenth of the rows to all of them, evenly spaced in ratio, each of ``least`` rows at least."""
    step = CURVE_SPAN ** (1 / (CURVE_POINTS - 1))
    sizes = {round(rows / step**i) for i in range(CURVE_POINTS)}
    return sorted(n for n in sizes if least <= n <= rows)


def family_curve(data: runs.Prepared, family: str, classes: int = 2, task: str = "classification", seed: int = 42) -> DataFrame:
    """(rows, estimate, low, high, gain, gain_low, gain_high, win_share, verdict): a family fitted on nested samples, told on the same held rows.

    The samples are prefixes of one order in which every class keeps its share;
    encoders are fitted on each sample alone. Intervals and the gain over the size
    before come from shared resamples of the test part, a positive gain being better.
    The last row's verdict is ``climbing`` where its gain is decisive, else
    ``plateau``. Fewer than two sizes give no rows: one point is no curve.
    """
    train, test = data.rows.where("part = 'train'").drop("part"), data.rows.where("part = 'test'").drop("part")
    sizes = curve_sizes(train.count(), max(CURVE_LEAST, classes * 4))
    nothing = "rows long, estimate double, low double, high double, gain double, gain_low double, gain_high double, win_share double, verdict string"
    if len(sizes) < 2:
        return data.rows.sparkSession.createDataFrame([], nothing)
    order = train.withColumn("_stratum", F.lit(0) if task == "regression" else F.col(data.label))
    nested = stored(split.nested_order(order, "_stratum", data.key, seed), "nested")
    within = [F.col("place") <= n / sizes[-1] for n in sizes]  # as many rows as asked for, up to half a row of each class
    sizes = list(nested.agg(*[F.count_if(w).alias(f"c{i}") for i, w in enumerate(within)]).first())
    told, held = test, {}
    for i, inside in enumerate(within):
        some = nested.where(inside)
        encoders = data.recipe.fit(some)
        rows = encoders.transform(some).select(data.key, "features", F.col(data.label).cast("double").alias("label"))
        model = runs.fit(family, rows, classes, seed=seed, task=task)
        told = model.transform(encoders.transform(told)).withColumn(f"_at_{i}", F.col("prediction")).select(*told.columns, f"_at_{i}")
        held[str(i)] = F.col(f"_at_{i}")
    told = stored(told.withColumn("_truth", F.col(data.label).cast("double")), "curve")
    metric = "rmse" if task == "regression" else "accuracy"
    draws = resample.resampled(told, data.key, "_truth", held, metric)
    sign, tail = (1.0 if resample.METRICS[metric] else -1.0), (1 - resample.LEVEL) / 2
    before = draws.select((F.col("model").cast("int") + 1).alias("i"), "b", F.col("value").alias("_was"))
    steps = draws.withColumn("i", F.col("model").cast("int")).join(before, ["i", "b"], "left").withColumn("gain", sign * (F.col("value") - F.col("_was")))
    drawn = F.col("b") > 0
    figures = []
    for c, name in (("value", "estimate"), ("gain", "gain")):
        ends = [F.percentile(F.when(drawn, F.col(c)), F.lit(q)).alias(end if c == "value" else f"gain_{end}") for end, q in (("low", tail), ("high", 1 - tail))]  # one value a resample
        figures += [F.max(F.when(~drawn, F.col(c))).alias(name), *ends]
    won = F.avg(F.when(drawn & F.col("gain").isNotNull(), (F.col("gain") > 0).cast("double")))
    verdict = F.when(F.col("i") == len(sizes) - 1, F.when((F.col("gain") > 0) & (F.col("gain_low") > 0), "climbing").otherwise("plateau"))
    return steps.groupBy("i").agg(*figures, won.alias("win_share")).select(F.get(F.array(*[F.lit(n).cast("long") for n in sizes]), F.col("i")).alias("rows"), "estimate", "low", "high", "gain", "gain_low", "gain_high", "win_share", verdict.alias("verdict")).orderBy("rows")


def random_search(rows: DataFrame, key: str, family: Callable[[dict], object], grid: dict[str, list], configs: int = 4, folds: int = 3, seed: int = 42) -> DataFrame:
    """(config, mean, sd): k-fold accuracy of configurations drawn from a grid, the best first. rows: key, features, label."""
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    chosen = random.Random(seed).sample(every, min(configs, len(every)))
    dealt = split.k_folds(rows, "label", key, folds, seed).persist()
    results = []
    for config in chosen:
        for fold in range(folds):
            model = family(config).fit(dealt.where(F.col("fold") != fold))
            told = model.transform(dealt.where(F.col("fold") == fold))
            results.append(told.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).select(F.lit(str(config)).alias("config"), "a"))
    told = [r for part in results for r in part.collect()]  # a row for each fit
    dealt.unpersist()
    found = rows.sparkSession.createDataFrame(told, "config string, a double").groupBy("config").agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("sd"))
    return found.orderBy(F.desc("mean"), "config")


def export_predictions(scored: DataFrame, keep: list[str], probability: str | None, classes: list[str]) -> DataFrame:
    """Original columns, the prediction, and a column for each class's probability."""
    extra = [F.get(F.col(probability), F.lit(i)).alias(f"p_{c}") for i, c in enumerate(classes)] if probability else []
    return scored.select(*keep, "predicted", *extra)
