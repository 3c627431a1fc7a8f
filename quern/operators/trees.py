"""Fitted trees as tables of nodes: prediction, and the replay of a row's way through them.

Whatever grew the trees (MLlib's trees, forests and boosting, or ``boosting``
here), they become one structure: nodes in arrays, a row goes left where its
feature is at most the threshold. The tables are as large as the model; rows are
walked through them where they lie, a batch at a time, and a replay gives for
every tree the nodes on the way, what the leaf says, and what the trees so far
add up to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.stored import work_folder

NODES = "tree int, node int, feature int, threshold double, left int, right int, value array<double>, rows long"


@dataclass(frozen=True)
class Tree:
    """One tree: ``feature`` is -1 for leaves; ``value`` has a number for each class (one for scores)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # nodes x outputs
    rows: np.ndarray

    def ways(self, x: np.ndarray) -> np.ndarray:
        """rows x (depth + 1): the nodes each row comes through; a leaf repeats to the end. Nulls (NaN) go left."""
        at = np.zeros(len(x), np.int64)
        ways = [at]
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return np.column_stack(ways)
            value = x[np.arange(len(x)), np.maximum(self.feature[at], 0)]
            step = np.where(~(value > self.threshold[at]), self.left[at], self.right[at])
            at = np.where(inner, step, at)
            ways.append(at)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        return self.ways(x)[:, -1]


@dataclass(frozen=True)
class Ensemble:
    """Trees with what becomes of their leaves: the sum of weighted scores from ``base`` on, or the mean of class shares."""

    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    base: float
    kind: str  # "sum" or "mean"

    def stages(self, x: np.ndarray) -> np.ndarray:
        """rows x (trees + 1) x outputs: what the first trees come to, from none to all."""
        said = np.stack([w * t.value[t.leaves(x)] for t, w in zip(self.trees, self.weights, strict=True)], axis=1) if self.trees else np.zeros((len(x), 0, 1))
        done = np.concatenate([np.full((len(x), 1, said.shape[2]), self.base), said], axis=1).cumsum(axis=1)
        if self.kind == "mean":
            done[:, 1:] /= np.cumsum(self.weights)[None, :, None]
        return done

    def scores(self, x: np.ndarray) -> np.ndarray:
        """rows x outputs, as the last stage."""
        total = np.full((len(x), self.trees[0].value.shape[1] if self.trees else 1), self.base)
        for t, w in zip(self.trees, self.weights, strict=True):
            total += w * t.value[t.leaves(x)]
        return total / sum(self.weights) if self.kind == "mean" else total

    def nodes(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value, rows): the model as a table."""
        rows = [
            (i, n, int(t.feature[n]), float(t.threshold[n]), int(t.left[n]), int(t.right[n]), t.value[n].tolist(), int(t.rows[n]))
            for i, t in enumerate(self.trees)
            for n in range(len(t.feature))
        ]
        return spark.createDataFrame(rows, NODES)

    def predict(self, features: Column | str) -> Column:
        """The scores of an array of features, one for each output."""

        @F.arrow_udf("array<double>")
        def told(vectors: pa.Array) -> pa.Array:
            return pa.array(list(self.scores(matrix(vectors))), pa.list_(pa.float64()))

        return told(features)

    def replay(self, features: Column | str) -> Column:
        """array<struct<tree, path, value, so_far>>: for each tree the nodes on the way, what its leaf says, what all trees up to it come to."""

        @F.arrow_udf("array<struct<tree:int,path:array<int>,value:array<double>,so_far:array<double>>>")
        def retold(vectors: pa.Array) -> pa.Array:
            x = matrix(vectors)
            stages = self.stages(x)
            ways = [t.ways(x) for t in self.trees]
            lasts = [1 + np.argmax(way == way[:, -1:], axis=1) for way in ways]  # nodes on the way
            n, count = len(x), len(ways)
            sizes = np.stack(lasts, axis=1) if count else np.zeros((n, 0), np.int64)
            deepest = max((way.shape[1] for way in ways), default=1)
            nodes = np.zeros((n, count, deepest), np.int32)
            said = np.zeros((n, count, stages.shape[2]))
            for i, (t, way) in enumerate(zip(self.trees, ways, strict=True)):
                nodes[:, i, : way.shape[1]] = way
                said[:, i] = t.value[way[:, -1]]
            path = nodes[np.arange(deepest) < sizes[:, :, None]]
            fields = [
                pa.array(np.tile(np.arange(count, dtype=np.int32), n)), lists_of(path, sizes.ravel()),
                lists_of(said.ravel(), np.full(n * count, stages.shape[2])), lists_of(stages[:, 1:].ravel(), np.full(n * count, stages.shape[2])),
            ]
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(count)), pa.StructArray.from_arrays(fields, names=["tree", "path", "value", "so_far"]))

        return retold(features)


def lists_of(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of given sizes, one after the other."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def matrix(vectors: pa.Array) -> np.ndarray:
    """An array of lists of equal length as rows x features; nulls are NaN."""
    sizes = np.diff(vectors.offsets.to_numpy()) if len(vectors) and not vectors.null_count else np.zeros(0)
    if len(sizes) and sizes[0] and (sizes == sizes[0]).all():
        return vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), sizes[0])
    lists = vectors.to_pylist()
    width = max((len(v) for v in lists if v), default=1)
    return np.array([v if v else [None] * width for v in lists], dtype=float).reshape(len(lists), width)


def step_of(feature: int, threshold: float, value: float, names: list[str]) -> str:
    return f"{names[feature]} {'>' if value > threshold else '<='} {threshold:g}"


def conditions(replayed: DataFrame, ensemble: Ensemble, features: str, names: list[str], keep: list[str]) -> DataFrame:
    """(keep, tree, depth, feature, threshold, value, goes): the tests on the way of each row, a row for each step."""
    inner = ensemble.nodes(replayed.sparkSession).where("feature >= 0").select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "feature", "threshold")
    walked = replayed.select(*keep, features, F.explode("replay").alias("r")).select(*keep, features, F.col("r.tree").alias("tree"), F.posexplode("r.path").alias("depth", "_node"))
    joined = walked.join(inner, (F.col("tree") == F.col("_t")) & (F.col("_node") == F.col("_n")))
    value = F.get(F.col(features), F.col("feature"))
    name = F.get(F.array(*map(F.lit, names)), F.col("feature"))
    return joined.select(*keep, "tree", "depth", name.alias("feature"), "threshold", value.alias("value"), F.when(value > F.col("threshold"), "right").otherwise("left").alias("goes"))


def from_mllib(model: Model, spark: SparkSession) -> Ensemble:
    """The nodes of a fitted MLlib tree, forest or boosting, as it saves them; the table is as large as the model.

    Leaves of classifiers hold class shares, those of regressors and boosting scores.
    """
    path = work_folder(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    flat = saved if "nodeData" not in saved.columns else saved.select(F.col("treeID"), "nodeData.*")
    flat = flat if "treeID" in flat.columns else flat.withColumn("treeID", F.lit(0))
    rows = flat.orderBy("treeID", "id").collect()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    shares = hasattr(model, "numClasses") and "GBT" not in type(model).__name__
    by_tree: dict[int, list] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], []).append(r)
    found = []
    for nodes in by_tree.values():
        value = np.array([np.array(r["impurityStats"]) / sum(r["impurityStats"]) if shares else [r["prediction"]] for r in nodes], dtype=float)
        cut = [r["split"]["leftCategoriesOrThreshold"] for r in nodes]
        if any(r["split"]["numCategories"] not in (-1, 0) for r in nodes if r["leftChild"] >= 0):
            raise ValueError("splits by sets of categories have no threshold")
        found.append(Tree(
            np.array([r["split"]["featureIndex"] if r["leftChild"] >= 0 else -1 for r in nodes]), np.array([c[0] if c else 0.0 for c in cut]),
            np.array([r["leftChild"] for r in nodes]), np.array([r["rightChild"] for r in nodes]), value, np.array([r["rawCount"] for r in nodes]),
        ))
    weights = tuple(model.treeWeights) if hasattr(model, "treeWeights") else (1.0,) * len(found)
    return Ensemble(tuple(found), weights, 0.0, "sum" if "GBT" in type(model).__name__ else "mean")
