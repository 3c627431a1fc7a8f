"""A small query algebra: seven shapes of questions, each compiled to one DataFrame plan.

An intent says what is asked of one table; ``compile_intent`` turns it into
filters, aggregates and a bounded sort that Catalyst plans as a whole. Filters
follow one rule: a missing cell never matches, whatever the comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.functions.stats import pearson

OPERATIONS = ("count", "mean", "median", "min", "max", "sum", "std")
COMPARISONS = (">", ">=", "<", "<=", "=", "!=")
FAMILIES = ("aggregate", "count", "top", "distribution", "correlation", "missing", "shape")
MOST_GROUPS, MOST_VALUES, MOST_TOP = 12, 8, 50


class IntentError(ValueError):
    """A refusal, named by its code."""


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: float | int | str


@dataclass(frozen=True)
class Intent:
    family: str
    column: str | None = None
    op: str | None = None
    by: str | None = None
    other: str | None = None
    k: int | None = None
    filter: Filter | None = None


def validate(raw: dict[str, Any], columns: list[str]) -> Intent:
    """An intent from its JSON form, column names matched without regard to case; raises on anything odd."""
    known = {c.lower(): c for c in columns}

    def column(key: str, needed: bool) -> str | None:
        value = raw.get(key)
        if value is None and not needed:
            return None
        if not isinstance(value, str) or value.lower() not in known:
            raise IntentError(f"unknown-column:{value}")
        return known[value.lower()]

    family = raw.get("family")
    if family not in FAMILIES:
        raise IntentError(f"unknown-family:{family}")
    op = raw.get("op")
    if op is not None and op not in OPERATIONS or family == "aggregate" and op is None:
        raise IntentError(f"unknown-op:{op}")
    condition = None
    if raw.get("filter") is not None:
        f = raw["filter"]
        if not isinstance(f, dict) or f.get("op") not in COMPARISONS or isinstance(f.get("value"), bool) or not isinstance(f.get("value"), int | float | str):
            raise IntentError("bad-filter")
        if not isinstance(f.get("column"), str) or f["column"].lower() not in known:
            raise IntentError(f"unknown-column:{f.get('column')}")
        condition = Filter(known[f["column"].lower()], f["op"], f["value"])
    k = raw.get("k")
    if family == "top" and (isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= MOST_TOP):
        raise IntentError(f"bad-k:{k}")
    needs_column = family in ("aggregate", "distribution", "correlation")
    by = column("by", family == "top")
    return Intent(family, column("column", needs_column), op, by, column("other", family == "correlation"), k, condition)


def predicate(df: DataFrame, f: Filter) -> Column:
    """The filter as a column; text thresholds are parsed for order, compared without case for equality."""
    if f.column not in df.columns:
        raise IntentError(f"unknown-column:{f.column}")
    numeric = isinstance(f.value, int | float)
    if f.op in (">", ">=", "<", "<="):
        try:
            bound = float(f.value)
        except ValueError as e:
            raise IntentError("filter-not-numeric") from e
        value = cells.number(df, f.column)
        return {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound}[f.op]
    if numeric:
        value = cells.number(df, f.column)
        return value == float(f.value) if f.op == "=" else value != float(f.value)
    value = F.lower(cells.text(df, f.column))
    wanted = str(f.value).strip().lower()
    return value == wanted if f.op == "=" else value != wanted


def measure(op: str, x: Column) -> Column:
    """An operation over parsed numbers; null over none of them, but a count of 0."""
    plan = {"count": F.count, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop}
    return plan[op](x).cast("double")


def filtered(df: DataFrame, f: Filter | None) -> DataFrame:
    return df if f is None else df.where(predicate(df, f))


def compile_intent(df: DataFrame, intent: Intent) -> DataFrame:
    return {
        "aggregate": aggregate, "count": count_rows, "top": top, "distribution": distribution, "correlation": correlation, "missing": missing, "shape": shape,
    }[intent.family](df, intent)


def aggregate(df: DataFrame, q: Intent) -> DataFrame:
    """(value, count) over all rows, or (group, value, count, used) of the 12 greatest groups.

    count is the number of rows; used that of numbers behind the value.
    """
    rows = filtered(df, q.filter)
    x = cells.number(df, q.column)
    if q.by is None:
        return rows.agg(measure(q.op, x).alias("value"), F.count(x).alias("count"))
    grouped = rows.withColumn("group", cells.text(df, q.by)).where("group IS NOT NULL")
    found = grouped.groupBy("group").agg(measure(q.op, x).alias("value"), F.count("*").alias("count"), F.count(x).alias("used"))
    return found.where("value IS NOT NULL").orderBy(F.desc("value"), "group").limit(MOST_GROUPS)


def count_rows(df: DataFrame, q: Intent) -> DataFrame:
    return filtered(df, q.filter).agg(F.count("*").alias("count"))


def top(df: DataFrame, q: Intent) -> DataFrame:
    """The k greatest groups by rows, or by an operation on ``column``."""
    rows = filtered(df, q.filter).withColumn("group", cells.text(df, q.by)).where("group IS NOT NULL")
    value = F.count("*").cast("double") if q.column is None else measure(q.op or "sum", cells.number(df, q.column))
    found = rows.groupBy("group").agg(value.alias("value"), F.count("*").alias("count"))
    return found.where("value IS NOT NULL").orderBy(F.desc("value"), "group").limit(q.k or 5)


def distribution(df: DataFrame, q: Intent) -> DataFrame:
    """The 8 most frequent values of a column; a filter is not applied."""
    values = df.select(cells.text(df, q.column).alias("value")).where("value IS NOT NULL")
    return values.groupBy("value").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(MOST_VALUES)


def correlation(df: DataFrame, q: Intent) -> DataFrame:
    """Pearson's r over pairs of numbers, and how many pairs there are."""
    rows = filtered(df, q.filter)
    x, y = cells.number(df, q.column), cells.number(df, q.other)
    return rows.agg(pearson(x, y).alias("r"), F.count_if(x.isNotNull() & y.isNotNull()).alias("pairs"))


def missing(df: DataFrame, q: Intent) -> DataFrame:
    """(column, missing) of the columns with missing cells, one pass over all columns."""
    names = [q.column] if q.column else df.columns
    counts = df.agg(*[F.count_if(cells.is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing")) for i, c in enumerate(names)]))
    return counts.select(each.alias("m")).select("m.*").where("missing > 0").orderBy(F.desc("missing"), "column")


def shape(df: DataFrame, q: Intent) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))
