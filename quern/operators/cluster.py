"""Clusters and components: MLlib's k-means, silhouettes, traits, covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.trees import matrix

MOST_PROBES = 300


def kmeans(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> tuple[DataFrame, list[list[float]]]:
    """(key, cluster) and the centres, over all rows."""
    points = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=100).fit(points)
    return model.transform(points).select(key, F.col("prediction").alias("cluster")), [c.tolist() for c in model.clusterCenters()]


def silhouette(points: DataFrame, key: str, vector: str, cluster: str, probes: int = MOST_PROBES) -> DataFrame:
    """(silhouette, n): the mean over at most ``probes`` rows, chosen by hash, against all rows; singletons are skipped.

    The probes are a bounded set; every batch of rows becomes a sum of distances and
    a number for each probe and cluster where it lies. Missing vectors don't count.
    """
    chosen = points.orderBy(F.md5(F.col(key).cast("string")), key).limit(probes).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), F.col(cluster).alias("c"))
    told = [r for r in chosen.collect() if r["v"] is not None and r["c"] is not None]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, labels = matrix(batch[1]), batch[2].dictionary_encode()
            names, at = labels.dictionary.to_pylist(), labels.indices.to_numpy()
            same = {k: i for i, k in enumerate(batch[0].to_pylist())} if len(set(batch[0].to_pylist())) == batch.num_rows else None
            found = []
            for i, r in enumerate(told):
                d = np.sqrt(((x - np.array(r["v"], float)) ** 2).sum(axis=1))
                counts = ~np.isnan(d)
                if same is None:
                    counts &= np.array([k != r["k"] for k in batch[0].to_pylist()])
                elif r["k"] in same:
                    counts[same[r["k"]]] = False
                n, total = np.bincount(at[counts], minlength=len(names)), np.bincount(at[counts], d[counts], len(names))
                found += [(i, c, c == r["c"], total[j], n[j]) for j, c in enumerate(names) if n[j]]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), batch[2].type, pa.bool_(), pa.float64(), pa.int64()), strict=True)], names=["p", "c", "own", "d", "n"])

    known = points.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.col(cluster).isNotNull())
    kind = points.schema[cluster].dataType.simpleString()
    added = known.select(key, F.col(vector).cast("array<double>"), cluster).mapInArrow(sums, f"p int, c {kind}, own boolean, d double, n long")
    means = added.groupBy("p", "c", "own").agg((F.sum("d") / F.sum("n")).alias("m"))
    each = means.groupBy("p").agg(F.min(F.when(F.col("own"), F.col("m"))).alias("a"), F.min(F.when(~F.col("own"), F.col("m"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return each.agg(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"), F.count("*").alias("n"))


def traits(df: DataFrame, cluster: str, names: list[str], most: int = 3) -> DataFrame:
    """(cluster, column, gap, rank): where a cluster's mean is farthest from the whole's, in deviations."""
    from quern.operators.profile import ranked

    whole = df.agg(*[f(c).alias(f"{k}_{c}") for c in names for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    means = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in names]).crossJoin(F.broadcast(whole))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")).alias("gap")) for c in names]))
    return ranked(means.select(cluster, each.alias("t")).select(cluster, "t.*"), [cluster], [F.desc(F.abs("gap")), F.col("column")], most)


def choose_kmeans(df: DataFrame, key: str, vector: str, ks: tuple[int, ...] = (2, 3, 4, 5), seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(assignments, tried): the clusters of the number that has the best silhouette, and (k, silhouette) of all that were tried."""
    tried, best = [], None
    for k in ks:
        found, _ = kmeans(df, key, vector, k, seed + k)
        score = silhouette(df.join(found.select(key, "cluster"), key), key, vector, "cluster").first()["silhouette"]
        tried.append((k, score))
        if score is not None and (best is None or score > best[0]):
            best = (score, found)
    if best is None:
        raise ValueError("too-few-rows")
    return best[1], df.sparkSession.createDataFrame(tried, "k int, silhouette double")


def categorical_traits(df: DataFrame, cluster: str, names: list[str], most: int = 3) -> DataFrame:
    """(cluster, column, value, share, overall, rank): for each column the value whose share is farthest from the whole's; missing cells don't count."""
    from quern.functions import cells
    from quern.operators.profile import ranked

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cells.text(df, c).alias("value")) for c in names]))
    counts = df.select(cluster, each.alias("v")).select(cluster, "v.*").where("value IS NOT NULL").groupBy(cluster, "column", "value").agg(F.count("*").alias("n"))
    within = counts.groupBy(cluster, "column").agg(F.sum("n").alias("total"))
    whole = counts.groupBy("column", "value").agg(F.sum("n").alias("all"))
    sizes = within.groupBy("column").agg(F.sum("total").alias("rows"))
    told = counts.join(within, [cluster, "column"]).join(whole, ["column", "value"]).join(sizes, "column")
    share, overall = F.col("n") / F.col("total"), F.col("all") / F.col("rows")
    told = told.select(cluster, "column", "value", share.alias("share"), overall.alias("overall"))
    weight = F.abs(F.col("share") - F.col("overall"))
    best = told.groupBy(cluster, "column").agg(F.min_by(F.struct("value", "share", "overall"), F.struct(-weight, "value")).alias("b")).select(cluster, "column", "b.*")
    return ranked(best, [cluster], [F.desc(weight), F.col("column")], most)


def project(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(key, x, y): each row on the two leading components, around the means."""
    means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
    axes = pca2(df, names)
    on = lambda axis: sum((F.coalesce(F.col(c) - means[c], F.lit(0.0)) * float(w) for c, w in zip(names, axis, strict=True)), F.lit(0.0))
    return df.select(key, on(axes[0]).alias("x"), on(axes[1]).alias("y"))


def covariance(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, cov) of all pairs, each over the rows that have both.

    Every batch of rows becomes a few sums for each pair (products, either side,
    rows), around the columns' means so that large values don't cancel; sums are
    added up in Spark.
    """
    means = [x or 0.0 for x in df.agg(*[F.avg(c) for c in names]).first()]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    left, right = (np.array(side, np.int32) for side in zip(*pairs, strict=True))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - means
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            found = [m[left, right] for m in (x.T @ x, x.T @ there, (x.T @ there).T, there.T @ there)]
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), *map(pa.array, found)], names=["i", "j", "xy", "x", "y", "n"])

    added = df.select(*[F.col(c).cast("double") for c in names]).mapInArrow(sums, "i int, j int, xy double, x double, y double, n double")
    total = added.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("xy", "x", "y", "n")])
    n = F.when(F.col("n") > 0, F.col("n"))
    name = F.array(*map(F.lit, names))
    return total.select(F.get(name, F.col("i")).alias("a"), F.get(name, F.col("j")).alias("b"), (F.col("xy") / n - F.col("x") * F.col("y") / (n * n)).alias("cov"))


def pca2(df: DataFrame, names: list[str]) -> np.ndarray:
    """The two leading components, the sign fixed on the largest loading; the driver sees the covariance matrix only."""
    at = {c: i for i, c in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in covariance(df, names).collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["cov"]
    _, vectors = np.linalg.eigh(m)
    top = vectors[:, ::-1][:, :2].T
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(axis=1)])[:, None]
