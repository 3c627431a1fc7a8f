"""Where queries are registered with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder by attribute: ``t.lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, -0 as 0, so that results can be compared whatever the order of summing."""
    return df.select(*[(F.round(c.name, places) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name) for c in df.schema.fields])


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of the tables; its doubles are rounded to six places, and so must the SQL's be."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[name] = sql
        return build

    return register


def determines_sql(rows: str, pairs: list[tuple[str, str]]) -> str:
    """Whether each value of a goes with one value of b in ``rows``, where there are enough rows to tell."""
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS a, '{b}' AS b, coalesce(sum(n) >= 30 AND count(*) BETWEEN 2 AND 50 AND sum(n) >= 5 * count(*) AND count(*) FILTER (low <> high) = 0, false) AS determined
        FROM (SELECT {a} AS x, count(*) AS n, min({b}) AS low, max({b}) AS high FROM {rows} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)"""
        for a, b in pairs
    )


def exclusions_sql(table: str, columns: dict[str, str]) -> str:
    """Identifiers, nearly empty and constant columns; columns: name -> expression."""
    figures = " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", count(*) AS n, count({x}) AS present, count(DISTINCT {x}) AS d, regexp_matches('{name}', '(?i)(^|_)(id|key|code|uuid|guid|ref|no|num|number)$|key$|id$') AS named FROM {table}"""
        for name, x in columns.items()
    )
    return f"""SELECT * FROM (SELECT "column", CASE WHEN present > 0 AND d >= 0.99 * present AND named THEN 'id' WHEN n - present >= 0.95 * greatest(n, 1) THEN 'nearEmpty' WHEN d <= 1 THEN 'constant' END AS reason FROM ({figures})) WHERE reason IS NOT NULL"""
