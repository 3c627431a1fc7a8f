"""Data quality: outliers, spelling variants, duplicates, validity, consistency, the report and its score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import quantiles
from quern.operators.profile import exclusions, per_column, profile_columns

LEAST_FOR_FENCES = 8
APPLICABLE = 0.8
EXAMPLES = 10

# The parts of the score and their weights, and how fast a ratio uses one up.
WEIGHTS = {"missing": 35, "duplicates": 20, "messy": 20, "outliers": 15, "structural": 10, "validity": 5}
SATURATION = 8

# Parts of column names, without accents, that let a rule look at a column.
NAMES = {
    "ageRange": ("age",),
    "percentRange": ("percent", "pourcent", "pct", "taux", "rate"),
    "negativeAmount": ("price", "prix", "montant", "amount", "total", "quantity", "quantite"),
    "futureDate": ("date", "jour", "day"),
    "postcodeShape": ("postcode", "postal", "zip", "cp"),
}
BOUNDS = {"ageRange": (0, 120), "percentRange": (0, 100), "negativeAmount": (0, None)}
CANADIAN_POSTCODE = r"^[A-Za-z]\d[A-Za-z][ -]?\d[A-Za-z]\d$"
FRENCH_POSTCODE = r"^\d{5}$"
STARTS = ("debut", "start", "commande", "order", "creation", "created", "from")
ENDS = ("fin", "end", "livraison", "delivery", "cloture", "closed", "to")
QUANTITIES = ("quantity", "quantite", "qte", "qty", "nombre")
UNIT_PRICES = ("unit_price", "prix_unitaire", "unitprice", "prixunitaire", "pu")
TOTALS = ("total", "montant", "amount", "sum")


def fences(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, low, high): Tukey's fences; null for fewer than 8 numbers or no spread."""
    quarters = quantiles.quantiles(df, {c: [0.25, 0.75] for c in names})
    known = df.sparkSession.createDataFrame([(c, *q) for c, q in quarters.items()], "column string, q1 double, q3 double")  # a row for each column
    quartiles = per_column(df, names, {"n": lambda d, c: F.count(cells.number(d, c))}).join(known, "column")
    q1, q3 = F.col("q1"), F.col("q3")
    fit = (F.col("n") >= LEAST_FOR_FENCES) & (q3 > q1)
    return quartiles.select("column", "n", F.when(fit, q1 - 1.5 * (q3 - q1)).alias("low"), F.when(fit, q3 + 1.5 * (q3 - q1)).alias("high"))


def outliers(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, low, high, count) of values strictly outside the fences."""
    found = {r["column"]: (r["low"], r["high"]) for r in fences(df, names).collect()}  # a row for each column
    known = [c for c in names if found[c][0] is not None]
    if not known:
        return df.sparkSession.createDataFrame([], "column string, low double, high double, count long")
    return per_column(df, known, {
        "low": lambda d, c: F.max(F.lit(found[c][0])),
        "high": lambda d, c: F.max(F.lit(found[c][1])),
        "count": lambda d, c: F.count_if((cells.number(d, c) < found[c][0]) | (cells.number(d, c) > found[c][1])),
    })


def variants(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, key, canonical, variants, cells): spellings that differ in case or outer spaces only.

    The most frequent spelling is canonical, the first by name of equals; cells
    counts the others.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~cells.is_missing(df, c), df[c]).alias("raw")) for c in names]))
    counted = df.select(each.alias("v")).select("v.*").where("raw IS NOT NULL").groupBy("column", F.lower(cells.jtrim(F.col("raw"))).alias("key"), "raw").agg(F.count("*").alias("n"))
    best = F.min_by("raw", F.struct(-F.col("n"), "raw"))
    groups = counted.groupBy("column", "key").agg(best.alias("canonical"), F.count("*").alias("variants"), (F.sum("n") - F.max("n")).alias("cells"))
    return groups.where("variants > 1")


def duplicates(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows): rows that repeat an earlier one in every cell; null and empty differ."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def name_fits(name: str, rule: str) -> bool:
    plain = cells.plain_name(name)
    return any(part in plain for part in NAMES[rule])


def rule_test(df: DataFrame, rule: str, name: str) -> tuple[Column, Column]:
    """(tested, failed) of a cell under a validity rule."""
    if rule == "futureDate":
        at = cells.date(df, name)
        return at.isNotNull(), at > F.current_timestamp()
    if rule == "postcodeShape":
        value = cells.text(df, name)
        return value.isNotNull(), ~(value.rlike(CANADIAN_POSTCODE) | value.rlike(FRENCH_POSTCODE))
    low, high = BOUNDS[rule]
    x = cells.number(df, name)
    bad = x < low if high is None else (x < low) | (x > high)
    return x.isNotNull(), bad


def validity(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(rule, column, tested, failed) of each rule that applies: the name fits and at least 80 % is plausible."""
    wanted = [(rule, c) for c in (names or df.columns) for rule in NAMES if name_fits(c, rule)]
    if not wanted:
        return df.sparkSession.createDataFrame([], "rule string, column string, tested long, failed long")
    aggregates = []
    for i, (rule, c) in enumerate(wanted):
        tested, failed = rule_test(df, rule, c)
        aggregates += [F.count_if(cells.text(df, c).isNotNull()).alias(f"u{i}"), F.count_if(tested).alias(f"t{i}"), F.count_if(failed).alias(f"f{i}")]
    each = []
    for i, (rule, c) in enumerate(wanted):
        used, tested, failed = F.col(f"u{i}"), F.col(f"t{i}"), F.col(f"f{i}")
        readable = tested >= APPLICABLE * used
        plausible = F.lit(True) if rule == "futureDate" else tested - failed >= APPLICABLE * tested
        each.append(F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("column"), tested.alias("tested"), failed.alias("failed"), ((used > 0) & readable & plausible).alias("applies")))
    found = df.agg(*aggregates).select(F.explode(F.array(*each)).alias("r")).select("r.*")
    return found.where("applies").drop("applies")


def failing_rows(df: DataFrame, rule: str, name: str, order: list[str], most: int = EXAMPLES) -> DataFrame:
    """The first rows that fail a rule, a bounded list of examples."""
    return df.where(rule_test(df, rule, name)[1]).orderBy(*order).limit(most)


def pick(names: list[str], hints: tuple[str, ...]) -> str | None:
    return next((n for n in names if any(h in cells.plain_name(n) for h in hints)), None)


@dataclass(frozen=True)
class Consistency:
    rule: str
    columns: tuple[str, ...]


def date_order(df: DataFrame, start: str, end: str) -> tuple[Column, Column]:
    a, b = cells.date(df, start), cells.date(df, end)
    return a.isNotNull() & b.isNotNull(), b < a


def product_mismatch(df: DataFrame, quantity: str, unit: str, total: str) -> tuple[Column, Column]:
    q, u, t = (cells.number(df, c) for c in (quantity, unit, total))
    slack = F.greatest(F.abs(q * u) * 0.01, F.lit(0.01))
    return q.isNotNull() & u.isNotNull() & t.isNotNull(), F.abs(t - q * u) > slack


def consistency(df: DataFrame) -> DataFrame:
    """(rule, columns, tested, failed) of the cross-column rules that the columns' names and values allow."""
    start, end = pick(df.columns, STARTS), pick(df.columns, ENDS)
    product = [pick(df.columns, hints) for hints in (QUANTITIES, UNIT_PRICES, TOTALS)]
    wanted: list[tuple[str, tuple[str, ...]]] = []
    if start and end and start != end:
        wanted.append(("dateOrder", (start, end)))
    if all(product) and product[1] != product[2]:
        wanted.append(("productMismatch", tuple(product)))
    parts = []
    for rule, columns in wanted:
        tested, failed = date_order(df, *columns) if rule == "dateOrder" else product_mismatch(df, *columns)
        read = cells.date if rule == "dateOrder" else cells.number
        present = [F.count(cells.text(df, c)).alias(f"p{i}") for i, c in enumerate(columns)]
        readable = [F.count(read(df, c)).alias(f"r{i}") for i, c in enumerate(columns)]
        row = df.agg(F.count_if(tested).alias("tested"), F.count_if(failed).alias("failed"), *present, *readable)
        fits = reduce(lambda a, b: a & b, [(F.col(f"p{i}") > 0) & (F.col(f"r{i}") >= APPLICABLE * F.col(f"p{i}")) for i in range(len(columns))])
        if rule == "productMismatch":  # most rows disagree: these are other columns
            fits = fits & (F.col("tested") > 0) & (F.col("failed") <= (1 - APPLICABLE) * F.col("tested"))
        parts.append(row.where(fits).select(F.lit(rule).alias("rule"), F.lit(",".join(columns)).alias("columns"), "tested", "failed"))
    if not parts:
        return df.sparkSession.createDataFrame([], "rule string, columns string, tested long, failed long")
    return reduce(DataFrame.unionByName, parts)


def score_parts(counts: DataFrame) -> DataFrame:
    """(part, weight, count, penalty) from one row (rows, columns, missing, duplicates, messy, outliers, structural, validity)."""
    cells_ = F.greatest(F.col("rows") * F.col("columns"), F.lit(1))
    rows = F.greatest("rows", F.lit(1))
    each = []
    for part, weight in WEIGHTS.items():
        count = F.col(part).cast("double")
        total = rows if part == "duplicates" else cells_
        cost = F.least(F.lit(10.0), 2.5 * count) if part == "structural" else weight * F.least(F.lit(1.0), count / total * SATURATION)
        each.append(F.struct(F.lit(part).alias("part"), F.lit(weight).alias("weight"), F.col(part).cast("long").alias("count"), F.round(cost, 1).alias("penalty")))
    return counts.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def score(parts: DataFrame) -> DataFrame:
    return parts.agg(F.greatest(F.lit(0), F.round(100 - F.sum("penalty")).cast("int")).alias("score"))


def report_counts(df: DataFrame) -> DataFrame:
    """The one row that the score is made of, in five jobs whatever the number of columns."""
    numeric = [c for c in df.columns if cells.is_numeric(df, c)]
    texts = [c for c in df.columns if cells.is_string(df, c)]
    profiles = profile_columns(df)
    totals = profiles.agg(F.max("rows").alias("rows"), F.count("*").alias("columns"), F.sum("missing").alias("missing"))
    parts = [
        totals,
        duplicates(df).select(F.col("duplicate_rows").alias("duplicates")),
        (variants(df, texts).agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("messy")) if texts else totals.select(F.lit(0).alias("messy"))),
        (outliers(df, numeric).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("outliers")) if numeric else totals.select(F.lit(0).alias("outliers"))),
        exclusions(profiles).agg(F.count("*").alias("structural")),
        validity(df).agg(F.coalesce(F.sum("failed"), F.lit(0)).alias("validity")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)  # one row each


# Isolation forest

TREES, SUBSAMPLE, ANOMALY = 100, 256, 0.6


def path_scale(n: int) -> float:
    """The mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, depth: int, limit: int, rng: np.random.Generator) -> tuple:
    """A tree as nested (column, cut, left, right), or the size of a leaf."""
    spread = np.nonzero(x.max(axis=0) > x.min(axis=0))[0] if len(x) > 1 else []
    if depth >= limit or not len(spread):
        return (len(x),)
    column = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, column].min(), x[:, column].max()))
    left = x[:, column] < cut
    return (column, cut, grow(x[left], depth + 1, limit, rng), grow(x[~left], depth + 1, limit, rng))


def heap(tree: tuple, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree as (column, cut, depth) of nodes in heap order, leaves repeated down to the last level: every row goes the same number of steps."""
    nodes = 2 ** (limit + 1) - 1
    column, cut, depth = np.zeros(nodes, np.int64), np.zeros(nodes), np.zeros(nodes)

    def fill(t: tuple, node: int, level: int, leaf: float | None) -> None:
        if leaf is None and len(t) == 1:
            leaf = level + path_scale(t[0])
        if leaf is None:
            column[node], cut[node] = t[0], t[1]
        else:
            depth[node] = leaf
        if level < limit:
            for child, side in ((2 * node + 1, 2), (2 * node + 2, 3)):
                fill(t if leaf is not None else t[side], child, level + 1, leaf)

    fill(tree, 0, 0, None)
    return column, cut, depth


def depths(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, limit: int) -> np.ndarray:
    """How deep each row of columns x rows lies in a tree in heap order: a level at a time, all rows at once."""
    column, cut, depth = tree
    n = x.shape[1]
    flat, own, start = x.ravel(), np.arange(n), column * n
    at = np.zeros(n, np.int64)
    for _ in range(limit):
        at = 2 * at + 2 - (flat[start[at] + own] < cut[at])
    return depth[at]


def isolation_scores(df: DataFrame, names: list[str], key: str, seed: int = 42) -> DataFrame:
    """The input with ``anomaly`` in 0..1. Trees are grown on TREES * SUBSAMPLE rows at most, chosen by hash; all rows are scored where they lie."""
    medians = quantiles.medians(df, names)
    filled = [F.coalesce(cells.number(df, c), F.lit(medians[c] if medians[c] is not None else 0.0)) for c in names]
    drawn = df.select(*[c.alias(f"x{i}") for i, c in enumerate(filled)]).orderBy(F.xxhash64(df[key], F.lit(seed)), df[key]).limit(TREES * SUBSAMPLE).collect()
    points = np.array([list(r) for r in drawn], dtype=float).reshape(len(drawn), len(names))
    if len(points) < 16 or len(names) < 2:
        return df.withColumn("anomaly", F.lit(None).cast("double"))
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(points))
    limit = int(np.ceil(np.log2(size)))
    trees = [heap(grow(points[rng.choice(len(points), size, replace=False)], 0, limit, rng), limit) for _ in range(TREES)]

    @F.arrow_udf("double")
    def scored(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])
        total = np.zeros(x.shape[1])
        for t in trees:
            total += depths(t, x, limit)
        return pa.array(2 ** (-(total / len(trees)) / path_scale(size)))

    return df.withColumn("anomaly", scored(*filled))
