"""Writers: CSV with a guard against spreadsheet formulas, full results, submissions, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.cells import NUMBER, fnv1a

DISPLAY_ROWS = 200


def guarded(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, with an apostrophe before it; numbers are left."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~F.trim(c).rlike(NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def guard_formulas(df: DataFrame) -> DataFrame:
    return df.select(*[guarded(F.col(c.name)).alias(c.name) if isinstance(c.dataType, T.StringType) else F.col(c.name) for c in df.schema.fields])


def write_csv(df: DataFrame, path: str, guard: bool = True) -> None:
    """CSV with a header, nulls as empty, quotes doubled."""
    (guard_formulas(df) if guard else df).write.options(header=True, nullValue="", emptyValue="", escape='"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def exportable(sql: str) -> str:
    return sql.strip().rstrip("; \n\t").strip()


def result_name(sql: str, extension: str) -> str:
    """The same name for the same query."""
    return f"query-{fnv1a(exportable(sql))}.{extension}"


def display(df: DataFrame, rows: int = DISPLAY_ROWS) -> DataFrame:
    """The first rows as text: NULL marks, bytes as hex, nested values as JSON."""
    shown = []
    for c in df.schema.fields:
        col = F.col(f"`{c.name}`")
        if isinstance(c.dataType, T.BinaryType):
            col = F.concat(F.lit("0x"), F.lower(F.hex(col)))
        elif isinstance(c.dataType, T.StructType | T.ArrayType | T.MapType):
            col = F.to_json(col)
        shown.append(F.coalesce(col.cast("string"), F.lit("NULL")).alias(c.name))
    return df.limit(rows).select(*shown)


def submission(scored: DataFrame, sample: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): a prediction for each id that is asked for; ids without one have null."""
    return sample.select(key).join(scored.select(key, value), key, "left")


def submission_checks(scored: DataFrame, sample: DataFrame, key: str, value: str) -> DataFrame:
    """One row: rows asked for, missing, extra and repeated ids."""
    a = sample.groupBy(key).agg(F.count("*").alias("asked"))
    b = scored.groupBy(key).agg(F.count("*").alias("given"), F.count(value).alias("filled"))
    both = a.join(b, key, "full")
    return both.agg(
        F.coalesce(F.sum("asked"), F.lit(0)).alias("asked"), F.count_if(F.col("asked").isNotNull() & (F.coalesce("filled", F.lit(0)) == 0)).alias("missing"),
        F.count_if(F.col("asked").isNull()).alias("extra"), F.count_if(F.col("given") > 1).alias("repeated"),
    )
