"""Splits and samples by hash order: the same rows whatever the partitioning, and reproducible in SQL.

Where a random order is wanted, rows are ordered by the MD5 of seed and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.ordering import numbered, ranked_within, running

LEAST_FOR_VALIDATION = 60


def hash_order(key: str, seed: int = 42) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def with_size(df: DataFrame, label: str, more: list[Column] | None = None) -> DataFrame:
    """The rows with ``_n``, the size of their class, and further columns of the classes."""
    sizes = df.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n"))
    return df.join(sizes.select("*", *(more or [])), F.col(label).eqNullSafe(F.col("_class"))).drop("_class")


def stratified(df: DataFrame, label: str, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The input with ``part`` (train or test): of each class round(n * ratio) rows, one at least, none of a single row."""
    take = F.when(F.col("_n") < 2, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("_n") * ratio)))
    ranked = ranked_within(with_size(df.where(F.col(label).isNotNull()), label), label, hash_order(key, seed), key)
    return ranked.withColumn("part", F.when(F.col("_rank") <= take, "test").otherwise("train")).drop("_rank", "_n")


def chronological(df: DataFrame, time: str, key: str, ratio: float = 0.2) -> DataFrame:
    """The dated rows with ``part``: the last round(n * ratio) by time are the test.

    The boundary is a quantile of (time, key) found by range partitions, not by
    one window over all rows.
    """
    dated = df.where(F.col(time).isNotNull())
    n = dated.count()
    test = max(1, round(n * ratio)) if n > 1 else 0
    return numbered(dated, [time, key], "_n").withColumn("part", F.when(F.col("_n") >= n - test, "test").otherwise("train")).drop("_n")


def grouped(df: DataFrame, group: str, key: str, test: float = 0.2, validation: float = 0.16, seed: int = 42) -> DataFrame:
    """Whole groups to test, then validation, then train, in hash order until each is full; a missing group is the row's own."""
    own = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string")))
    named = df.withColumn("_g", own)
    sizes = named.groupBy("_g").agg(F.count("*").alias("_n")).withColumn("_o", F.md5(F.concat_ws(":", F.lit(seed), "_g")))
    total = named.count()
    before = F.col("_upto") - F.col("_n")
    part = F.when(F.col("_before") < test * total, "test").when(F.col("_before") < (test + validation) * total, "validation").otherwise("train")
    parts = running(sizes, ["_o", "_g"], {"_upto": "_n"}).withColumn("_before", before).select("_g", part.alias("part"))
    return named.join(parts, "_g").drop("_g")


def k_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """The input with ``fold`` 0..k-1, dealt in turn within each class."""
    return ranked_within(df, label, hash_order(key, seed), key).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def nested_order(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """The input with ``place`` in 0..1: any prefix by it holds the classes in proportion."""
    ranked = ranked_within(with_size(df.where(F.col(label).isNotNull()), label), label, hash_order(key, seed), key)
    return ranked.withColumn("place", (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")


def capped(df: DataFrame, label: str, key: str, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` rows, the classes in proportion."""
    return nested_order(df, label, key, seed).orderBy("place", label, hash_order(key, seed)).limit(cap).drop("place")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n / (classes * n of class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_k"))
    return counts.crossJoin(F.broadcast(totals)).select(label, "n", (F.col("_all") / (F.col("_k") * F.col("n"))).alias("weight"))  # totals is one row


def balanced(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Rows repeated in hash order until each class has as many as the largest."""
    most = df.groupBy(label).agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    ranked = ranked_within(with_size(df.where(F.col(label).isNotNull()), label), label, hash_order(key, seed), key)
    copies = F.expr(f"({most} - _rank) div _n + 1")
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).drop("_n", "_rank")
