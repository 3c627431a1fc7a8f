"""Drift between a reference and a new table, frozen profiles, and data contracts."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.functions.stats import normal_quantile, psi, share_difference
from quern.operators import quality
from quern.operators.profile import column_types, per_column, top_values
from quern.operators.quantiles import quantiles

BINS = 10
TOP_DRIFT, TOP_PROFILE = 10, 12
MODERATE, STRONG = 0.1, 0.25
FALSE_ALERTS = 0.05
SIMULATIONS, MOST_SIMULATED, SEED = 1000, 1000, 6100
OTHER = "__other__"


def decile_edges(df: DataFrame, names: list[str]) -> dict[str, list[float]]:
    """Inner decile edges of each column, repeated ones once; nine numbers a column."""
    found = quantiles(df, {c: [i / BINS for i in range(1, BINS)] for c in names})
    return {c: sorted(set(q)) if q[0] is not None else [] for c, q in found.items()}


def bin_of(x: Column, edges: list[float]) -> Column:
    """The number of edges strictly below a value."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < x)))


def numeric_shares(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(column, bin, share, n) over given edges, one pass for all columns."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), bin_of(cells.number(df, c), e).cast("string").alias("bin")) for c, e in edges.items()]))
    return shares(df.select(each.alias("b")).select("b.*").where("bin IS NOT NULL"))


def category_shares(df: DataFrame, tops: dict[str, list[str]]) -> DataFrame:
    """(column, bin, share, n) over given categories, the rest in one."""
    each = []
    for c, top in tops.items():
        value = cells.text(df, c)
        each.append(F.struct(F.lit(c).alias("column"), F.when(value.isin(*top), value).when(value.isNotNull(), OTHER).alias("bin")))
    return shares(df.select(F.explode(F.array(*each)).alias("b")).select("b.*").where("bin IS NOT NULL"))


def shares(binned: DataFrame) -> DataFrame:
    counted = binned.groupBy("column", "bin").agg(F.count("*").alias("k"))  # a few bins a column from here on
    total = counted.groupBy("column").agg(F.sum("k").alias("n"))
    return counted.join(F.broadcast(total), "column").select("column", "bin", (F.col("k") / F.col("n")).alias("share"), "n")


def stability(reference: DataFrame, current: DataFrame, bins: dict[str, list[str]]) -> DataFrame:
    """(column, psi) from shares on both sides; bins that neither side has count as empty on both."""
    return side_by_side(reference, current, bins).select("column", "psi")


def side_by_side(reference: DataFrame, current: DataFrame, bins: dict[str, list[str]]) -> DataFrame:
    """(column, psi, pooled, reference_rows, rows): ``pooled`` are the shares of both samples put together, a few a column."""
    all_bins = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(b).alias("bin")) for c, bs in bins.items() for b in bs]))
    frame = reference.sparkSession.range(1).select(all_bins.alias("b")).select("b.*")
    left = reference.select("column", "bin", F.col("share").alias("p"), F.col("n").alias("a"))
    right = current.select("column", "bin", F.col("share").alias("q"), F.col("n").alias("b"))
    both = frame.join(left, ["column", "bin"], "left").join(right, ["column", "bin"], "left")
    zero = F.lit(0.0)
    value = psi(F.coalesce("p", zero), F.coalesce("q", zero))
    empty = (F.max("p").isNull()) | (F.max("q").isNull())
    found = both.groupBy("column").agg(
        F.when(empty, 0.0).otherwise(value).alias("psi"), F.coalesce(F.max("a"), F.lit(0)).alias("reference_rows"), F.coalesce(F.max("b"), F.lit(0)).alias("rows"),
        F.array_sort(F.collect_list(F.struct("bin", F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q")))).alias("shares"),
    )
    total = F.greatest(F.col("reference_rows") + F.col("rows"), F.lit(1))
    pooled = F.transform("shares", lambda s: (s["p"] * F.col("reference_rows") + s["q"] * F.col("rows")) / total)
    return found.select("column", "psi", pooled.alias("pooled"), "reference_rows", "rows")


def graded(measured: DataFrame, level: float) -> DataFrame:
    """(column, psi, ceiling, severity): each index against what it stays under when both samples are of one population."""

    @F.arrow_udf("double")
    def ceiling(pooled: pa.Array, reference_rows: pa.Array, rows: pa.Array) -> pa.Array:  # a row for each column
        return pa.array([noise_ceiling(p, a, b, level) for p, a, b in zip(pooled.to_pylist(), reference_rows.to_pylist(), rows.to_pylist(), strict=True)], pa.float64())

    told = measured.withColumn("ceiling", ceiling("pooled", "reference_rows", "rows"))
    grade = F.when((F.col("psi") < MODERATE) | (F.col("psi") <= F.col("ceiling")), "stable").when(F.col("psi") < STRONG, "moderate").otherwise("strong")
    return told.select("column", "psi", "ceiling", grade.alias("severity"))


def top_categories(df: DataFrame, names: list[str], k: int = TOP_DRIFT) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {c: [] for c in names}
    for r in top_values(df, names, k).orderBy("column", "rank").collect():  # k rows a column
        out[r["column"]].append(r["value"])
    return out


def numeric_sides(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    edges = decile_edges(reference, names)
    bins = {c: [str(i) for i in range(len(e) + 1)] for c, e in edges.items()}
    return side_by_side(numeric_shares(reference, edges), numeric_shares(current, edges), bins)


def categorical_sides(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    tops = top_categories(reference, names)
    return side_by_side(category_shares(reference, tops), category_shares(current, tops), {c: [*t, OTHER] for c, t in tops.items()})


def numeric_drift(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    return numeric_sides(reference, current, names).select("column", "psi")


def categorical_drift(reference: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    return categorical_sides(reference, current, names).select("column", "psi")


def changed_categories(reference: DataFrame, current: DataFrame, name: str, most: int = 6) -> DataFrame:
    """The first values of ``current`` that ``reference`` lacks."""
    new = current.select(cells.text(current, name).alias("value")).where("value IS NOT NULL").distinct()
    old = reference.select(cells.text(reference, name).alias("value")).where("value IS NOT NULL").distinct()
    return new.join(old, "value", "left_anti").orderBy("value").limit(most)


def psi_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    p, q = np.maximum(p, 1e-4), np.maximum(q, 1e-4)
    return ((q - p) * np.log(q / p)).sum(axis=-1)


def noise_ceiling(pooled: list[float], reference_rows: int, rows: int, level: float, seed: int = SEED) -> float:
    """What the index stays under at ``level`` when nothing moved: both sides drawn from the pooled shares.

    Draws are of 1000 rows at most, as is fixed for the reports: the ceiling of
    larger tables is that of 1000 rows. Without rows nothing is above it.
    """
    if not (sum(pooled) > 0 and reference_rows >= 1 and rows >= 1):
        return float("inf")
    rng = np.random.default_rng(seed)
    share = np.array(pooled) / sum(pooled)
    a, b = (min(n, MOST_SIMULATED) for n in (reference_rows, rows))
    simulated = psi_of(rng.multinomial(a, share, SIMULATIONS) / a, rng.multinomial(b, share, SIMULATIONS) / b)
    return float(np.quantile(simulated, level))


def severity(value: float, ceiling: float | None) -> str:
    """stable below 0.1 or below the ceiling, else moderate, strong from 0.25."""
    if value < MODERATE or ceiling is not None and value <= ceiling:
        return "stable"
    return "moderate" if value < STRONG else "strong"


@dataclass(frozen=True)
class ColumnProfile:
    column: str
    kind: str
    bins: list[str]
    shares: list[float]
    n: int
    edges: list[float] = field(default_factory=list)


@dataclass(frozen=True)
class Clause:
    column: str
    type: str
    reading: str
    missing: float
    profile: ColumnProfile | None = None


@dataclass(frozen=True)
class Rule:
    rule: str
    columns: list[str]
    failed: int
    tested: int


@dataclass(frozen=True)
class Contract:
    """What a reference table looks like: distributions and rules, never rows."""

    rows: int
    columns: list[Clause]
    rules: list[Rule]

    def to_json(self) -> str:
        return json.dumps({"format": "quern-contract-1", **asdict(self)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Contract | None:
        try:
            raw = json.loads(text)
            if raw.pop("format") != "quern-contract-1":
                return None
            clauses = [Clause(**{**c, "profile": ColumnProfile(**c["profile"]) if c["profile"] else None}) for c in raw["columns"]]
            return Contract(int(raw["rows"]), clauses, [Rule(**r) for r in raw["rules"]])
        except (ValueError, TypeError, KeyError, AttributeError):
            return None


def build_profiles(df: DataFrame, types: dict[str, str]) -> list[ColumnProfile]:
    numeric = [c for c, t in types.items() if t == "numeric"]
    words = [c for c, t in types.items() if t != "numeric"]
    edges = decile_edges(df, numeric) if numeric else {}
    tops = top_categories(df, words, TOP_PROFILE) if words else {}
    rows = (numeric_shares(df, edges).collect() if edges else []) + (category_shares(df, tops).collect() if tops else [])
    by: dict[str, dict[str, tuple[float, int]]] = {}
    for r in rows:
        by.setdefault(r["column"], {})[r["bin"]] = (r["share"], r["n"])
    out = []
    for c in types:
        bins = [str(i) for i in range(len(edges[c]) + 1)] if c in edges else [*tops[c], OTHER]
        found = by.get(c, {})
        out.append(ColumnProfile(c, "numeric" if c in edges else "categorical", bins, [found.get(b, (0.0, 0))[0] for b in bins], max((n for _, n in found.values()), default=0), edges.get(c, [])))
    return out


def compare_to_profiles(df: DataFrame, profiles: list[ColumnProfile]) -> DataFrame:
    """(column, psi, pooled, reference_rows, rows) of a table against frozen profiles."""
    numeric = {p.column: p.edges for p in profiles if p.kind == "numeric"}
    words = {p.column: p.bins[:-1] for p in profiles if p.kind != "numeric"}
    parts = ([numeric_shares(df, numeric)] if numeric else []) + ([category_shares(df, words)] if words else [])
    current = reduce(DataFrame.unionByName, parts)
    frozen = [(p.column, b, float(s), p.n) for p in profiles if p.n for b, s in zip(p.bins, p.shares, strict=True)]
    reference = df.sparkSession.createDataFrame(frozen, "column string, bin string, share double, n long")
    return side_by_side(reference, current, {p.column: p.bins for p in profiles})


def readings(df: DataFrame) -> DataFrame:
    """(column, reading, missing): how each column's values read: empty, number, date or words."""
    figures = per_column(df, df.columns, {
        "rows": lambda d, c: F.count("*"),
        "n": lambda d, c: F.count(cells.text(d, c)),
        "numbers": lambda d, c: F.count(cells.number(d, c)),
        "dates": lambda d, c: F.count(cells.date(d, c)),
    })
    n = F.col("n")
    kind = F.when(n == 0, "empty").when(F.col("numbers") >= 0.8 * n, "number").when(F.col("dates") >= 0.8 * n, "date").otherwise("words")
    return figures.select("column", kind.alias("reading"), (1 - n / F.greatest("rows", F.lit(1))).alias("missing"), "rows")


def build_contract(df: DataFrame) -> Contract:
    types = {r["column"]: r["type"] for r in column_types(df).collect()}
    read = {r["column"]: r for r in readings(df).collect()}
    profiles = {p.column: p for p in build_profiles(df, {c: t for c, t in types.items() if t in ("numeric", "categorical", "boolean")})}
    rules = [Rule(r["rule"], [r["column"]], r["failed"], r["tested"]) for r in quality.validity(df).collect()]
    rules += [Rule(r["rule"], r["columns"].split(","), r["failed"], r["tested"]) for r in quality.consistency(df).collect()]
    rows = max((r["rows"] for r in read.values()), default=0)
    return Contract(rows, [Clause(c, types[c], read[c]["reading"], read[c]["missing"], profiles.get(c)) for c in df.columns], rules)


def check_contract(contract: Contract, df: DataFrame) -> DataFrame:
    """(family, subject, outcome, detail) of each clause: kept, warning or broken."""
    spark = df.sparkSession
    present = [c for c in contract.columns if c.column in df.columns]
    estimates = len(present) + sum(r.failed > 0 for r in contract.rules)
    z = normal_quantile(1 - FALSE_ALERTS / max(1, estimates))
    found = {r["column"]: r for r in readings(df).collect()}
    rows = max((r["rows"] for r in found.values()), default=0)
    told: list[tuple[str, str, str, str]] = [("schema", c.column, "kept" if c in present else "broken", "present") for c in contract.columns]
    for c in present:
        now = found[c.column]["reading"]
        told.append(("schema", c.column, "broken" if "empty" not in (now, c.reading) and now != c.reading else "kept", f"{c.reading}:{now}"))
    measured: list[tuple[str, str, float, int, float, int]] = []
    if rows and contract.rows:
        measured += [("missing", c.column, float(found[c.column]["missing"]), rows, float(c.missing), contract.rows) for c in present]
    tests = [(r, quality.rule_test(df, r.rule, r.columns[0]) if len(r.columns) == 1 else (quality.date_order if r.rule == "dateOrder" else quality.product_mismatch)(df, *r.columns)) for r in contract.rules if all(c in df.columns for c in r.columns)]
    if tests:
        row = df.agg(*[F.count_if(x).alias(f"{k}{i}") for i, (_, pair) in enumerate(tests) for k, x in zip("tf", pair, strict=True)]).first()
        for i, (r, _) in enumerate(tests):
            tested, failed, name = row[f"t{i}"], row[f"f{i}"], f"{r.rule}({','.join(r.columns)})"
            if not tested:
                told.append(("rule", name, "warning", "unreadable"))
            elif not r.failed:
                told.append(("rule", name, "broken" if failed else "kept", f"{failed}/{tested}"))
            else:
                measured.append(("rule", name, failed / tested, tested, r.failed / r.tested, r.tested))
    profiles = [c.profile for c in present if c.profile and c.profile.n]
    if profiles and rows:
        level = 1 - FALSE_ALERTS / len(profiles)
        for r in graded(compare_to_profiles(df, profiles), level).collect():
            told.append(("distribution", r["column"], "kept" if r["severity"] == "stable" else "warning", f"{r['psi']:.4f}"))
    out = spark.createDataFrame(told, "family string, subject string, outcome string, detail string")
    if measured:
        m = spark.createDataFrame(measured, "family string, subject string, a double, n long, b double, m long")
        low, _ = share_difference(F.col("a"), F.col("n"), F.col("b"), F.col("m"), z)
        out = out.unionByName(m.select("family", "subject", F.when(low > 0, "broken").otherwise("kept").alias("outcome"), F.format_string("%.4f", "a").alias("detail")))
    return out
