"""Cleaning recipes: declarative, replayable, applied in one fixed order."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import quality
from quern.operators.joins import free_names
from quern.operators.profile import exclusions, profile_columns
from quern.operators.quantiles import medians

MISSING_STRATEGIES = ("keep", "drop", "median", "mean", "mode", "constant", "category")
DATE_PARTS = ("year", "month", "weekday")
WEEKDAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")


@dataclass(frozen=True)
class ColumnStep:
    missing: str | None = None
    constant: str | float | None = None
    indicator: bool = False
    clip_outliers: bool = False


@dataclass(frozen=True)
class Recipe:
    """What to do; steps run in the order of ``apply``, whatever the order here."""

    trim: bool = True
    merge_variants: bool = False
    derive_dates: bool = False
    drop_structural: bool = False
    drop_duplicates: bool = False
    clip_outliers: bool = False
    drop_anomalies: bool = False
    missing: str = "keep"
    category_fill: str = "MISSING"
    columns: dict[str, ColumnStep] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Recipe | None:
        """A recipe from its JSON form; unknown keys are dropped, None for anything that isn't one."""
        try:
            raw: Any = json.loads(text)
        except ValueError:
            return None
        if not isinstance(raw, dict):
            return None
        known = {k: v for k, v in raw.items() if k in Recipe.__dataclass_fields__}
        flags = [k for k, f in Recipe.__dataclass_fields__.items() if f.type == "bool"]
        if any(not isinstance(known.get(k, False), bool) for k in flags) or known.get("missing", "keep") not in MISSING_STRATEGIES:
            return None
        steps = known.pop("columns", {})
        if not isinstance(steps, dict) or any(not isinstance(s, dict) or s.get("missing") not in (None, *MISSING_STRATEGIES) for s in steps.values()):
            return None
        return Recipe(**known, columns={c: ColumnStep(**{k: v for k, v in s.items() if k in ColumnStep.__dataclass_fields__}) for c, s in steps.items()})


def trimmed(df: DataFrame) -> DataFrame:
    return df.select(*[(cells.jtrim(df[c]) if cells.is_string(df, c) else df[c]).alias(c) for c in df.columns])


def merged_variants(df: DataFrame, names: list[str]) -> DataFrame:
    """Spellings replaced by their canonical form, one small join a column."""
    groups = quality.variants(df, names)
    for name in names:
        forms = groups.where(F.col("column") == name).select(F.col("key").alias("_key"), F.col("canonical").alias("_to"))
        df = df.join(forms, F.lower(cells.jtrim(df[name])) == F.col("_key"), "left").withColumn(name, F.coalesce("_to", df[name])).drop("_key", "_to")
    return df


def derived_dates(df: DataFrame, names: list[str]) -> DataFrame:
    for name in names:
        at = cells.date(df, name)
        made = (F.year(at), F.lpad(F.month(at).cast("string"), 2, "0"), F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), F.dayofweek(at)))
        for new, part in zip(free_names(df.columns, [f"{name}_{p}" for p in DATE_PARTS]), made, strict=True):
            df = df.withColumn(new, part)
    return df


def first_rows(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """The first by ``order`` of rows that are alike in ``by`` (all other columns)."""
    alike = by or [c for c in df.columns if c not in order]
    w = Window.partitionBy(*alike).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def fill_values(df: DataFrame, wanted: dict[str, str], recipe: Recipe) -> dict[str, Any]:
    """What each column is filled with: one aggregate for means, one for modes, a few passes for all medians."""
    out: dict[str, Any] = {}
    means = [c for c, s in wanted.items() if s == "mean"]
    if means:
        row = df.agg(*[F.avg(cells.number(df, c)).alias(c) for c in means]).first()
        out |= {c: row[c] for c in means if row[c] is not None}
    middle = [c for c, s in wanted.items() if s == "median"]
    if middle:
        out |= {c: x for c, x in medians(df, middle).items() if x is not None}
    modes = [c for c, s in wanted.items() if s == "mode"]
    if modes:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), cells.text(df, c).alias("value")) for c in modes]))
        counted = df.select(each.alias("v")).select("v.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
        best = counted.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
        out |= {r["column"]: r["value"] for r in best.collect()}  # a row for each column
    for c, s in wanted.items():
        if s == "category":
            out[c] = recipe.category_fill
        elif s == "constant" and recipe.columns[c].constant is not None:
            out[c] = recipe.columns[c].constant
    return out


def strategy(df: DataFrame, name: str, recipe: Recipe) -> str:
    own = recipe.columns.get(name, ColumnStep()).missing
    if own:
        return own
    if recipe.missing == "impute":
        return "median" if cells.is_numeric(df, name) else "mode"
    return recipe.missing


def apply(df: DataFrame, recipe: Recipe, order: list[str]) -> DataFrame:
    """Trim, merge variants, derive dates, drop structural columns, drop duplicates, indicate, drop or fill missing, clip, drop anomalies.

    ``order`` names rows: the first of duplicates stays. Fills are computed
    before rows with missing cells are dropped.
    """
    keys = [c for c in order if c in df.columns]
    if recipe.trim:
        df = trimmed(df)
    texts = [c for c in df.columns if cells.is_string(df, c) and c not in keys]
    if recipe.merge_variants and texts:
        df = merged_variants(df, texts)
    if recipe.derive_dates:
        df = derived_dates(df, [c for c in df.columns if cells.is_temporal(df, c)])
    if recipe.drop_structural:
        dropped = {r["column"] for r in exclusions(profile_columns(df)).collect() if r["reason"] != "id"}
        df = df.select(*[c for c in df.columns if c not in dropped])
    if recipe.drop_duplicates:
        df = first_rows(df, keys)
    plan = {c: strategy(df, c, recipe) for c in df.columns if c not in keys}
    fills = fill_values(df, {c: s for c, s in plan.items() if s not in ("keep", "drop")}, recipe)
    flagged = [c for c in df.columns if recipe.columns.get(c, ColumnStep()).indicator]
    flags: dict[str, str] = {}
    if flagged:  # only columns that have gaps get an indicator, under a name that is free
        gaps = df.agg(*[F.count_if(cells.is_missing(df, c)).alias(c) for c in flagged]).first()
        flagged = [c for c in flagged if gaps[c]]
        flags = dict(zip(flagged, free_names(df.columns, [f"{c}_absent" for c in flagged]), strict=True))
    columns: list[Column] = []
    for c in df.columns:
        gap = cells.is_missing(df, c)
        value = F.when(gap, F.lit(fills[c]).cast(df.schema[c].dataType)).otherwise(df[c]) if c in fills else df[c]
        columns.append(value.alias(c))
        if c in flags:
            columns.append(F.when(gap, "1").otherwise("0").alias(flags[c]))
    drops = [c for c, s in plan.items() if s == "drop"]
    if drops:
        whole = ~cells.is_missing(df, drops[0])
        for c in drops[1:]:
            whole = whole & ~cells.is_missing(df, c)
        df = df.where(whole)
    df = df.select(*columns)
    clipped = [c for c in df.columns if cells.is_numeric(df, c) and c not in keys and (recipe.clip_outliers or recipe.columns.get(c, ColumnStep()).clip_outliers)]
    if clipped:
        for r in quality.fences(df, clipped).where("low IS NOT NULL").collect():
            c = r["column"]
            df = df.withColumn(c, F.greatest(F.lit(r["low"]), F.least(F.lit(r["high"]), F.col(c))))
    if recipe.drop_anomalies and keys:
        numeric = [c for c in df.columns if cells.is_numeric(df, c) and c not in keys]
        df = quality.isolation_scores(df, numeric, keys[0]).where(f"anomaly IS NULL OR anomaly <= {quality.ANOMALY}").drop("anomaly")
    return df


def trim_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, changed) cells that trimming changes."""
    row = df.agg(*[F.count_if(df[c] != cells.jtrim(df[c])).alias(c) for c in names])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in names])).alias("r")).select("r.*")


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, column, old, new) of every changed cell, and a row with a null column for each dropped row."""
    shared = [c for c in before.columns if c in after.columns and c not in key]
    old = before.select(*key, *[F.coalesce(before[c].cast("string"), F.lit("")).alias(f"o_{c}") for c in shared])
    new = after.select(*key, *[F.coalesce(after[c].cast("string"), F.lit("")).alias(f"n_{c}") for c in shared], F.lit(True).alias("_kept"))
    both = old.join(new, key, "left")
    each = [F.struct(F.lit(c).alias("column"), F.col(f"o_{c}").alias("old"), F.col(f"n_{c}").alias("new")) for c in shared]
    gone = F.array(F.struct(F.lit(None).cast("string").alias("column"), F.lit("").alias("old"), F.lit("").alias("new")))
    changes = F.when(F.col("_kept").isNull(), gone).otherwise(F.filter(F.array(*each), lambda x: x["old"] != x["new"]))
    return both.select(*key, F.explode(changes).alias("c")).select(*key, "c.*")


def schema_diff(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    return {"added": [c for c in after.columns if c not in before.columns], "removed": [c for c in before.columns if c not in after.columns], "kept": [c for c in before.columns if c in after.columns]}
