"""Encoders: fitted by one aggregate, applied as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators.profile import per_column, top_values
from quern.operators.quantiles import medians

MOST_ONE_HOT = 12
MOST_TERMS = 256


@dataclass(frozen=True)
class Numeric:
    """Median where missing, then z-scores by the population's mean and deviation of what was there."""

    column: str
    fill: float
    mean: float
    std: float

    def columns(self, df: DataFrame) -> dict[str, Column]:
        return {self.column: (F.coalesce(cells.number(df, self.column), F.lit(self.fill)) - self.mean) / (self.std or 1.0)}


@dataclass(frozen=True)
class OneHot:
    """A column for each category, the mode where missing; unseen ones are all zero."""

    column: str
    categories: tuple[str, ...]

    def columns(self, df: DataFrame) -> dict[str, Column]:
        value = F.coalesce(cells.text(df, self.column), F.lit(self.categories[0] if self.categories else ""))
        return {f"{self.column}={c}": (value == c).cast("double") for c in self.categories}


def fit_numeric(df: DataFrame, names: list[str]) -> list[Numeric]:
    rows = per_column(df, names, {"mean": lambda d, c: F.avg(cells.number(d, c)), "std": lambda d, c: F.stddev_pop(cells.number(d, c))}).collect()
    found, fill = {r["column"]: r for r in rows}, medians(df, names)
    return [Numeric(c, fill[c] or 0.0, found[c]["mean"] or 0.0, found[c]["std"] or 0.0) for c in names]


def fit_one_hot(df: DataFrame, names: list[str]) -> list[OneHot]:
    found: dict[str, list[str]] = {c: [] for c in names}
    for r in top_values(df, names, MOST_ONE_HOT).orderBy("column", "rank").collect():
        found[r["column"]].append(r["value"])
    return [OneHot(c, tuple(v)) for c, v in found.items()]


def encoded(df: DataFrame, encoders: list[Numeric | OneHot], keep: list[str]) -> DataFrame:
    columns = {name: c for e in encoders for name, c in e.columns(df).items()}
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def ordinal(df: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """(keep, rank, z): a category's rank by frequency, from 0; missing has the mode's."""
    value = cells.text(df, name)
    counts = df.select(value.alias("_v")).where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("_n"))
    ranks = counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_n"), "_v")) - 1)  # the dictionary, not the rows
    joined = df.select(*keep, value.alias("_w")).join(ranks, F.col("_w") == F.col("_v"), "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    # The rows' mean and deviation follow from the dictionary and its counts.
    moments = ranks.agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("rank")).alias("s"), F.sum(F.col("_n") * F.col("rank") * F.col("rank")).alias("q")).first()
    n, s, q = (float(x or 0) for x in moments)
    mean = s / n if n else 0.0
    std = max(0.0, q / n - mean * mean) ** 0.5 if n else 0.0
    return joined.select(*keep, "rank", ((F.col("rank") - mean) / (std or 1.0)).alias("z"))


def filled_cells(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, empty, unreadable): what an encoder has to fill."""
    return per_column(df, names, {
        "empty": lambda d, c: F.count_if(cells.is_missing(d, c)),
        "unreadable": lambda d, c: F.count_if(cells.text(d, c).isNotNull() & cells.number(d, c).isNull()),
    })


def tfidf_vocabulary(df: DataFrame, text: str, most: int = MOST_TERMS, least: int = 2) -> DataFrame:
    """(term, df, idf) of the most frequent terms: ln((1 + N) / (1 + df)) + 1."""
    n = df.count()
    terms = df.select(F.explode(F.array_distinct(cells.tokens(F.col(text)))).alias("term"))
    found = terms.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(most)
    return found.withColumn("idf", F.log((1.0 + n) / (1 + F.col("df"))) + 1)


def tfidf_vectors(df: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """(key, term, weight): unit vectors; documents without a known term have no rows.

    The vocabulary has at most a few hundred rows: tokens are kept and counted
    per document before they are shuffled.
    """
    tokens = df.select(key, F.explode(cells.tokens(F.col(text))).alias("term")).join(F.broadcast(vocabulary), "term")
    weights = tokens.groupBy(key, "term").agg((F.count("*") * F.max("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weights.select(key, "term", (F.col("w") / norm).alias("weight"))


def task_of(df: DataFrame, target: str) -> DataFrame:
    """(target, distinct, task): binary, multiclass, regression, or none."""
    numeric = cells.is_numeric(df, target)
    value = cells.text(df, target)
    row = df.agg(F.count_distinct(value).alias("distinct"), F.count_if(cells.number(df, target) != F.floor(cells.number(df, target))).alias("_f"))
    d = F.col("distinct")
    classes = F.when(d == 2, "binary").when(d.between(3, 10 if numeric else 20), "multiclass")
    task = F.when((F.col("_f") == 0) & classes.isNotNull(), classes).otherwise("regression") if numeric else F.coalesce(classes, F.lit("none"))
    return row.select(F.lit(target).alias("target"), "distinct", task.alias("task"))
