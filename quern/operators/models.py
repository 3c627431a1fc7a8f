"""Model families: those that aggregates can fit exactly, and MLlib's for the rest."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import boosting, network

RIDGE = 1e-6
LEAST_VARIANCE = 1e-9


def baseline(df: DataFrame, label: str) -> DataFrame:
    """(label, share, is_prediction): class frequencies; the majority is what is predicted, the first by name of equals."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"), F.min_by(label, F.struct(-F.col("n"), label)).alias("_best"))
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("n") / F.col("_all")).alias("share"), (F.col(label) == F.col("_best")).alias("is_prediction"))


@dataclass(frozen=True)
class Linear:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float

    def predict(self) -> Column:
        total = F.lit(self.bias)
        for name, w in zip(self.features, self.weights, strict=True):
            total = total + F.col(name) * w
        return total

    def to_json(self) -> str:
        return json.dumps({"family": "linear", "features": self.features, "weights": self.weights, "bias": self.bias})

    @staticmethod
    def from_json(text: str) -> Linear | None:
        try:
            raw = json.loads(text)
            if raw["family"] != "linear" or len(raw["features"]) != len(raw["weights"]):
                return None
            return Linear(tuple(map(str, raw["features"])), tuple(map(float, raw["weights"])), float(raw["bias"]))
        except (ValueError, KeyError, TypeError):
            return None


def fit_linear(df: DataFrame, features: list[str], target: str) -> Linear:
    """Least squares with a tiny ridge: X'X and X'y in one aggregate of all rows, solved on the driver."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    y = F.col(target).cast("double")
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(len(x)) for j in range(i, len(x))] + [F.sum(c * y).alias(f"b{i}") for i, c in enumerate(x)]
    row = df.agg(*sums).first()
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))], dtype=float)
    w = np.linalg.solve(a + RIDGE * np.eye(len(x)), np.array([row[f"b{i}"] for i in range(len(x))], dtype=float))
    return Linear(tuple(features), tuple(map(float, w[1:])), float(w[0]))


def naive_bayes(train: DataFrame, rows: DataFrame, label: str, features: list[str], key: str) -> DataFrame:
    """(key, predicted): Gaussian naive Bayes, Laplace priors, population variances; ties to the first class.

    The fitted table has one row a class and travels as an array of parameters.
    """
    stats = [s for c in features for s in (F.avg(c).alias(f"m_{c}"), F.greatest(F.var_pop(c), F.lit(LEAST_VARIANCE)).alias(f"v_{c}"))]
    fitted = train.groupBy(label).agg(F.count("*").alias("n"), *stats).orderBy(label).collect()  # a row for each class
    total = sum(r["n"] for r in fitted)
    x = F.array(*[F.col(c).cast("double") for c in features])

    def log_joint(r: Row) -> Column:
        means, spreads = ([r[f"{k}_{c}"] for c in features] for k in "mv")
        fixed = np.log((r["n"] + 1) / (total + len(fitted))) - 0.5 * np.log(2 * np.pi * np.array(spreads)).sum()
        m, v = (F.array(*map(F.lit, values)) for values in (means, spreads))
        parts = F.transform(x, lambda value, i: F.pow(value - F.get(m, i), 2) / F.get(v, i))
        return F.lit(float(fixed)) - 0.5 * F.aggregate(parts, F.lit(0.0), lambda done, part: done + part)

    scores = [log_joint(r) for r in fitted]
    best = F.array_position(F.array(*scores), F.array_max(F.array(*scores))).cast("int")
    classes = F.array(*[F.lit(r[label]) for r in fitted])
    return rows.select(key, F.element_at(classes, best).alias("predicted"))


def knn_vote(found: DataFrame, key: str) -> DataFrame:
    """(key, predicted): the most frequent value of the neighbours, the least of equals."""
    votes = found.select(key, F.explode("near").alias("n")).groupBy(key, F.col("n.value").cast("int").alias("v")).agg(F.count("*").alias("c"))
    return votes.groupBy(key).agg(F.min_by("v", F.struct(-F.col("c"), "v")).alias("predicted"))


def knn_mean(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, (F.aggregate("near", F.lit(0.0), lambda a, n: a + n["value"]) / F.size("near")).alias("predicted"))


def blend(scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, score): the mean of several models' probabilities."""
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return scores.select(key, (total / len(columns)).alias("score"))


CLASSIFIERS = {
    "logistic": lambda seed, layers: LogisticRegression(regParam=1e-4, maxIter=100),
    "tree": lambda seed, layers: DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=3, seed=seed),
    "forest": lambda seed, layers: RandomForestClassifier(numTrees=40, maxDepth=10, seed=seed),
    "boosting": lambda seed, layers: OneVsRest(classifier=GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.1, maxBins=32, seed=seed)),
    "mlp": lambda seed, layers: MultilayerPerceptronClassifier(layers=layers, maxIter=100, seed=seed),
}
REGRESSORS = {
    "tree": lambda seed: DecisionTreeRegressor(maxDepth=10, minInstancesPerNode=3, seed=seed),
    "forest": lambda seed: RandomForestRegressor(numTrees=40, maxDepth=10, seed=seed),
    "boosting": lambda seed: GBTRegressor(maxIter=20, maxDepth=4, stepSize=0.1, maxBins=32, seed=seed),
}


def assembled(df: DataFrame, features: list[str] | str, label: str, keep: list[str]) -> DataFrame:
    """keep + features (vector) + label (double)."""
    vector = F.col(features).cast("array<double>") if isinstance(features, str) else F.array(*[F.col(c).cast("double") for c in features])
    return df.select(*keep, array_to_vector(vector).alias("features"), F.col(label).cast("double").alias("label"))


def fit_predict(family: str, train: DataFrame, rows: DataFrame, keep: list[str], classes: int = 2, width: int = 0, seed: int = 42, task: str = "classification") -> DataFrame:
    """(keep, predicted[, probability]): a family of MLlib, or the library's own boosting and network, trained on all of ``train``, without caps."""
    if family == "boosting":
        return boosted(train, rows, keep, classes, task)
    if family == "mlp":
        return networked(train, rows, keep, classes, task, seed)
    if task == "regression":
        return REGRESSORS[family](seed).fit(train).transform(rows).select(*keep, F.col("prediction").alias("predicted"))
    found = CLASSIFIERS[family](seed, [width, 16, classes]).fit(train).transform(rows)
    extra = [vector_to_array("probability").alias("probability")] if "probability" in found.columns else []
    return found.select(*keep, F.col("prediction").cast("int").alias("predicted"), *extra)


def boosted(train: DataFrame, rows: DataFrame, keep: list[str], classes: int, task: str) -> DataFrame:
    """Histogram boosting with its defaults: 120 rounds, depth 4, 32 bins; the first of equal classes."""
    given = train.select(vector_to_array("features").alias("x"), "label")
    asked = rows.select(*keep, vector_to_array("features").alias("_x"))
    if task == "regression":
        model = boosting.fit_regressor(given, "x", "label")
        return asked.select(*keep, F.get(model.predict("_x"), F.lit(0)).alias("predicted"))
    model = boosting.fit_classifier(given, "x", "label", classes)
    told = asked.select(*keep, model.predict("_x").alias("probability"))
    return told.select(*keep, (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("predicted"), "probability")


def networked(train: DataFrame, rows: DataFrame, keep: list[str], classes: int, task: str, seed: int) -> DataFrame:
    """The network of ``network`` with its defaults: one hidden ReLU layer, 300 epochs; the first of equal classes."""
    model = network.fit(train.select(vector_to_array("features").alias("x"), "label"), "x", "label", 0 if task == "regression" else classes, seed)
    told = rows.select(*keep, vector_to_array("features").alias("_x")).select(*keep, model.predict("_x").alias("probability"))
    if task == "regression":
        return told.select(*keep, F.get("probability", F.lit(0)).alias("predicted"))
    return told.select(*keep, (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("predicted"), "probability")


def kmeans_step(points: DataFrame, key: str, vector: str, centres: list[list[float]]) -> DataFrame:
    """(key, cluster, distance): the nearest centre, the first of equals."""
    x = F.col(vector)
    squared = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: F.pow(a - b, 2.0)), F.lit(0.0), lambda s, v: s + v) for c in centres]
    d = F.array(*squared)
    return points.select(key, (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("cluster"), F.sqrt(F.array_min(d)).alias("distance"))
