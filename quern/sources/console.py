"""Any SQL over registered views; a few foreign spellings are told apart from errors."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from quern.sources.sinks import exportable, write_csv, write_parquet

#: Spellings of other engines, with what to write here.
HINTS = {
    r"\bqualify\b": "put the window in a subquery and filter it with WHERE",
    r"\bexclude\s*\(": "write * EXCEPT (...)",
    r"\basof\s+join\b": "use quern.operators.joins.asof_join",
    r"\bpositional\s+join\b": "use quern.operators.joins.positional_join",
    r"\bunnest\s*\(": "write explode(...)",
}


class SqlError(ValueError):
    """The engine's own words, with a hint where one fits."""


def run(spark: SparkSession, sql: str) -> DataFrame:
    try:
        return spark.sql(exportable(sql))
    except (AnalysisException, ParseException) as e:
        hint = next((h for p, h in HINTS.items() if re.search(p, sql, re.I)), None)
        raise SqlError(f"{e}" + (f"\nHint: {hint}" if hint else "")) from e


def export(spark: SparkSession, sql: str, path: str, kind: str = "parquet") -> None:
    """The whole result, written by Spark; nothing passes through the driver."""
    df = run(spark, sql)
    write_csv(df, path) if kind == "csv" else write_parquet(df, path)
