"""Column profiles in few passes: one job for all columns' figures, one for all their top values."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import cells
from quern.operators import quantiles

BINS = 12
TOP_VALUES = 8
NEAR_EMPTY = 0.95
ID_NAME = re.compile(r"(^|_)(id|key|code|uuid|guid|ref|no|num|number)$", re.I)
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
TYPED_DATE = r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$|^\d{1,2}[/.-]\d{1,2}[/.-](\d{2}|\d{4})$"
#: Expressions in one aggregate: beyond this its generated code is no longer compiled.
MOST_EXPRESSIONS = 200


def per_column(df: DataFrame, names: list[str], figures: dict[str, object]) -> DataFrame:
    """(column, figures...): aggregates of every column, many columns to a job. figures: name -> f(df, column)."""
    at_once = max(1, MOST_EXPRESSIONS // len(figures))
    parts = []
    for i in range(0, len(names), at_once):
        some = names[i : i + at_once]
        row = df.agg(*[f(df, c).alias(f"{j}_{k}") for j, c in enumerate(some) for k, f in figures.items()])
        each = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{j}_{k}").alias(k) for k in figures]) for j, c in enumerate(some)])
        parts.append(row.select(F.explode(each).alias("p")).select("p.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_columns(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, rows, missing, distinct, numbers, min, max, mean, median, std) of each column.

    Exact medians and distinct counts are found by selection and by grouping, in
    a few more passes (``quantiles``): no column's values meet in one buffer.
    With ``exact=False`` sketches of fixed size (1 % error) take their place, and
    the whole profile is one pass whose shuffle doesn't grow with the rows.
    """
    names = names or df.columns
    # Cells are read once a row; the aggregates then refer to plain columns.
    read, numeric = [], []
    for j, c in enumerate(names):
        typed = not cells.is_string(df, c)
        read += [cells.is_missing(df, c).alias(f"m{j}"), (df[c] if typed else cells.text(df, c)).alias(f"v{j}")]
        if cells.is_numeric(df, c) or not typed:
            read.append(cells.number(df, c).alias(f"x{j}"))
            numeric.append(c)
    rows = df.select(*read)
    distinct = quantiles.distinct_counts(rows, [f"v{j}" for j in range(len(names))]) if exact else {}
    middle = quantiles.medians(df, numeric) if exact and numeric else {}
    figures = ("rows", "missing", "distinct", "numbers", "min", "max", "mean", "median", "std")
    none = {n: F.lit(0).cast("long") if n == "numbers" else F.lit(None).cast("double") for n in figures[3:]}
    parts = []
    at_once = max(1, MOST_EXPRESSIONS // len(figures))
    for low in range(0, len(names), at_once):
        some = range(low, min(len(names), low + at_once))
        aggregates = [F.count("*").alias("rows")]
        for j in some:
            aggregates.append(F.count_if(f"m{j}").alias(f"missing{j}"))
            if not exact:
                aggregates.append(F.approx_count_distinct(F.col(f"v{j}"), 0.01).alias(f"distinct{j}"))
            if f"x{j}" in rows.columns:
                x = F.col(f"x{j}")
                aggregates += [a.alias(f"{n}{j}") for n, a in zip([n for n in figures[3:] if not exact or n != "median"], (F.count(x), F.min(x), F.max(x), F.avg(x), *([] if exact else [F.percentile_approx(x, 0.5, 10_000)]), F.stddev_pop(x)), strict=True)]
        row = rows.agg(*aggregates)
        if exact:
            row = row.withColumns({f"distinct{j}": F.lit(distinct[f"v{j}"]).cast("long") for j in some} | {f"median{j}": F.lit(middle.get(names[j])).cast("double") for j in some})
        each = [F.struct(F.lit(names[j]).alias("column"), F.col("rows"), *[(F.col(f"{n}{j}") if f"{n}{j}" in row.columns else none[n]).alias(n) for n in figures[1:]]) for j in some]
        parts.append(row.select(F.explode(F.array(*each)).alias("p")).select("p.*"))
    return reduce(DataFrame.unionByName, parts).select("column", *figures)


def histogram(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, count): equal widths, the greatest value in the last bin; one bin for a constant."""
    x = cells.number(df, name)
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted = df.select(x.alias("x")).where("x IS NOT NULL").crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "low", "high").agg(F.count("*").alias("count"))  # ends is one row
    return counted.select("bin", (F.col("low") + F.col("bin") * width).alias("low"), F.when(width > 0, F.col("low") + (F.col("bin") + 1) * width).otherwise(F.col("high")).alias("high"), "count")


def top_values(df: DataFrame, names: list[str], k: int = TOP_VALUES) -> DataFrame:
    """(column, value, count, rank) of the k most frequent values of each column; ties by value."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cells.text(df, c).alias("value")) for c in names]))
    counted = df.select(each.alias("v")).select("v.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("count"))
    return ranked(counted, ["column"], [F.desc("count"), F.col("value")], k)


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their rank; Spark cuts each task's groups before it shuffles them."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def exclusions(profiles: DataFrame) -> DataFrame:
    """(column, reason): identifiers, nearly empty and constant columns; the first reason that fits."""
    share = F.col("missing") / F.greatest("rows", F.lit(1))
    present = F.col("rows") - F.col("missing")
    named = F.col("column").rlike(r"(?i)(^|_)(id|key|code|uuid|guid|ref|no|num|number)$|key$|id$")
    is_id = (present > 0) & (F.col("distinct") >= 0.99 * present) & named
    reason = F.when(is_id, "id").when(share >= NEAR_EMPTY, "nearEmpty").when(F.col("distinct") <= 1, "constant")
    return profiles.select("column", reason.alias("reason")).where("reason IS NOT NULL")


def column_types(df: DataFrame) -> DataFrame:
    """(column, type) by the values: text, boolean, id, numeric, date or categorical.

    Columns with a type of their own have it; string columns are read over all
    rows. Distinct texts are counted by their 64-bit hashes.
    """
    strings = [c for c in df.columns if cells.is_string(df, c)]
    typed = [(c, typed_as(df, c)) for c in df.columns if c not in strings]
    spark = df.sparkSession
    found = spark.createDataFrame(typed, "column string, type string") if typed else None
    if strings:
        # A text is trimmed, lowered and parsed once a row, not once for each figure.
        at = {c: i for i, c in enumerate(strings)}
        read = df.select(*[cells.text(df, c).alias(f"t{i}") for c, i in at.items()])
        read = read.select(*[c for i in at.values() for c in (F.col(f"t{i}"), F.lower(f"t{i}").alias(f"l{i}"), cells.parse_number_text(F.col(f"t{i}")).alias(f"x{i}"))])
        figures = per_column(read, strings, {
            "n": lambda d, c: F.count(f"t{at[c]}"),
            "bools": lambda d, c: F.count_if(F.col(f"l{at[c]}").isin(*cells.BOOLEANS)),
            "numbers": lambda d, c: F.count(f"x{at[c]}"),
            "whole": lambda d, c: F.count_if(F.col(f"x{at[c]}") == F.floor(f"x{at[c]}")),
            "dates": lambda d, c: F.count_if(F.col(f"t{at[c]}").rlike(TYPED_DATE)),
            "uuids": lambda d, c: F.count_if(F.col(f"t{at[c]}").rlike(UUID)),
        })
        counts = quantiles.distinct_counts(read.select(*[F.when(F.col(f"l{i}").isNotNull(), F.xxhash64(f"l{i}")).alias(f"h{i}") for i in at.values()]), [f"h{i}" for i in at.values()])
        figures = figures.join(spark.createDataFrame([(c, counts[f"h{i}"]) for c, i in at.items()], "column string, distinct long"), "column")  # a row for each column
        n = F.col("n")
        named = F.col("column").rlike(r"(?i)(^|_)(id|key|code|uuid|guid|ref|no|num|number)$|key$|id$")
        unique = (F.col("distinct") >= 0.99 * n) & named
        kind = (
            F.when(n == 0, "text").when(F.col("bools") == n, "boolean")
            .when(F.col("numbers") >= 0.95 * n, F.when((F.col("whole") == F.col("numbers")) & unique, "id").otherwise("numeric"))
            .when(F.col("dates") >= 0.95 * n, "date").when((F.col("uuids") == n) | unique, "id")
            .when(F.col("distinct") <= F.greatest(F.lit(20.0), 0.05 * n), "categorical").otherwise("text")
        )
        read = figures.select("column", kind.alias("type"))
        found = read if found is None else found.unionByName(read)
    return found


def typed_as(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "id" if ID_NAME.search(name) or re.search(r"(key|id)$", name, re.I) else "numeric"
    return "date" if cells.is_temporal(df, name) else "text"


def determines(df: DataFrame, pairs: list[tuple[str, str]], most_values: int = 50, least_rows: int = 30, per_value: int = 5) -> DataFrame:
    """(a, b, determined): whether each value of a goes with one value of b, over all pairs in one job."""
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), cells.text(df, a).alias("x"), cells.text(df, b).alias("y")) for a, b in pairs]))
    by_value = df.select(each.alias("p")).select("p.*").where("x IS NOT NULL AND y IS NOT NULL").groupBy("a", "b", "x").agg(F.count("*").alias("rows"), F.min("y").alias("low"), F.max("y").alias("high"))
    per_pair = by_value.groupBy("a", "b").agg(F.sum("rows").alias("rows"), F.count("*").alias("values"), F.count_if(F.col("low") != F.col("high")).alias("broken"))
    enough = (F.col("rows") >= least_rows) & F.col("values").between(2, most_values) & (F.col("rows") >= per_value * F.col("values"))
    return per_pair.select("a", "b", (enough & (F.col("broken") == 0)).alias("determined"))


def correlations(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, r) of all pairs of numeric columns over the rows where both are given; r is 0 for constants and fewer than two rows.

    Each task multiplies whole blocks of rows (Gram sums of values and of what is
    given), whatever the number of columns, and sends one row for each pair.
    """
    count = len(names)
    low = df.agg(*[F.min(cells.number(df, c)).alias(f"x{i}") for i, c in enumerate(names)]).first()
    start = np.array([x if x is not None else 0.0 for x in low])  # constants become zeros; large offsets don't cancel digits
    left, right = np.triu_indices(count, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, count, count))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - start
            given = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            square = x * x
            total += [given.T @ given, x.T @ given, given.T @ x, square.T @ given, given.T @ square, x.T @ x]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *[pa.array(m[left, right]) for m in total]], names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    rows = df.select(*[cells.number(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    parts = rows.mapInArrow(sums, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    of = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n, spread = F.col("n"), lambda s, q: F.col(q) - F.col(s) * F.col(s) / F.col("n")
    both = [F.when(spread(s, q) > 1e-13 * F.col(q), spread(s, q)) for s, q in (("x", "xx"), ("y", "yy"))]  # null for constants
    r = F.when(n >= 2, (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(both[0] * both[1]))
    name = lambda i: F.get(F.array(*[F.lit(c) for c in names]), i)
    return of.select(name(F.col("i")).alias("a"), name(F.col("j")).alias("b"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0)))).alias("r"))
