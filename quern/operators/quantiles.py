"""Exact order statistics of many columns by distributed selection.

No column is sorted and none meets in one buffer. Sketches of fixed size propose
pivots around each wanted rank; one aggregate counts exactly how many values lie
below and up to each pivot; the pivots next to a rank are its new bounds. A pass
leaves about one value in a thousand between the bounds, until few enough remain
to be counted one by one, as rows by value. That is two passes for up to 65,536
values, three for 10**8 and five for 10**12, for all columns and ranks together;
what reaches the driver are the pivots' counts. A sketch only proposes: where it
is off, the bounds stay wider and another pass follows.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import cells
from quern.operators.ordering import in_ranges
from quern.sources.stored import discard, stored

#: Values between two bounds that are counted one by one.
FEW = 1 << 16
#: Precision of the sketches that propose pivots, and how far around a rank they are asked, in shares.
ACCURACY = 10_000
AROUND = 4 / ACCURACY
#: Expressions in one aggregate: beyond this its generated code is no longer compiled.
MOST_EXPRESSIONS = 200


@dataclass
class Known:
    """What is known of a column: how many values, and for each pivot how many are below it and up to it."""

    n: int = 0
    pivots: dict[float, tuple[int, int]] = field(default_factory=dict)

    def at(self, rank: int) -> float | None:
        """The value of a rank (from 0), if a pivot has it."""
        return next((v for v, (below, upto) in self.pivots.items() if below <= rank < upto), None)

    def bounds(self, rank: int) -> tuple[float | None, float | None, int, int]:
        """(low, high, below, inside): the pivots next to a rank, and how many values lie before and between them."""
        order = sorted(self.pivots)
        i = bisect_right([self.pivots[v][1] for v in order], rank)
        low, high = order[i - 1] if i else None, order[i] if i < len(order) else None
        below = self.pivots[low][1] if i else 0
        return low, high, below, (self.pivots[high][0] if high is not None else self.n) - below


def between(x: Column, low: float | None, high: float | None) -> Column:
    """Whether a value lies strictly between two bounds."""
    inside = x.isNotNull()
    if low is not None:
        inside &= x > low
    return inside & (x < high) if high is not None else inside


def in_batches(rows: DataFrame, wanted: list[Column]) -> list:
    """The values of many aggregates, so many to a job as generated code holds."""
    out = []
    for i in range(0, len(wanted), MOST_EXPRESSIONS):
        out += list(rows.agg(*[c.alias(f"_{j}") for j, c in enumerate(wanted[i : i + MOST_EXPRESSIONS])]).first())
    return out


def counted_one_by_one(rows: DataFrame, few: list[tuple[str, float | None, float | None]]) -> dict[int, list[tuple[float, int, int]]]:
    """For each range of a column its values in order: (value, below, upto), as counted within the range; bounded by FEW distinct values each."""
    inside = [between(F.col(c), low, high) for c, low, high in few]
    each = F.filter(F.array(*[F.when(ok, F.struct(F.lit(i).alias("i"), F.col(c).alias("x"))) for i, (ok, (c, _, _)) in enumerate(zip(inside, few, strict=True))]), lambda s: s.isNotNull())
    counts = rows.where(reduce(Column.__or__, inside)).select(F.explode(each).alias("s")).select("s.*").groupBy("i", "x").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    found: dict[int, list[tuple[float, int, int]]] = {}
    for r in counts.select("i", "x", (upto - F.col("k")).alias("below"), upto.alias("upto")).orderBy("i", "x").toLocalIterator():
        found.setdefault(r["i"], []).append((r["x"], r["below"], r["upto"]))
    return found


def order_statistics(rows: DataFrame, ranks: dict[str, list[int]], known: dict[str, Known], few: int = FEW) -> dict[str, dict[int, float]]:
    """The values of ranks (from 0, among non-null values) of columns of doubles, narrowing what is known of them."""
    while True:
        open_ranks = [(c, r) for c, wanted in ranks.items() for r in wanted if known[c].at(r) is None]
        if not open_ranks:
            return {c: {r: known[c].at(r) for r in wanted} for c, wanted in ranks.items()}
        ranges: dict[tuple[str, float | None, float | None], list[int]] = {}
        for c, r in open_ranks:
            ranges.setdefault((c, *known[c].bounds(r)[:2]), []).append(r)
        small = [k for k, rs in ranges.items() if known[k[0]].bounds(rs[0])[3] <= few]
        if small:
            pick(rows, known, small, ranges)
        large = [k for k in ranges if k not in small]
        if large:
            narrow(rows, known, large, ranges)


def pick(rows: DataFrame, known: dict[str, Known], small: list, ranges: dict) -> None:
    """Finds the ranks of small ranges value by value."""
    values = counted_one_by_one(rows, small)
    for i, key in enumerate(small):
        column = known[key[0]]
        before = column.bounds(ranges[key][0])[2]
        for rank in ranges[key]:
            x, below, upto = next(v for v in values[i] if v[2] > rank - before)
            column.pivots[x] = (before + below, before + upto)


def narrow(rows: DataFrame, known: dict[str, Known], large: list, ranges: dict) -> None:
    """Proposes pivots around the ranks of large ranges and counts what lies below and up to each."""
    sketches = []
    for c, low, high in large:
        _, _, before, inside = known[c].bounds(ranges[c, low, high][0])
        shares = sorted({min(1.0, max(0.0, (r - before) / max(1, inside - 1) + d)) for r in ranges[c, low, high] for d in (-AROUND, 0.0, AROUND)})
        x = F.col(c)
        sketches.append(F.percentile_approx(F.when(between(x, low, high), x), shares, ACCURACY))
    count_pivots(rows, known, {(key[0], p) for key, found in zip(large, in_batches(rows, sketches), strict=True) for p in found})


def count_pivots(rows: DataFrame, known: dict[str, Known], proposed: set[tuple[str, float]]) -> None:
    """Counts exactly, in one pass for all columns, what lies below and up to each pivot."""
    pivots = sorted(proposed)
    if not pivots:
        return
    counts = in_batches(rows, [n for c, p in pivots for n in (F.count_if(F.col(c) < p), F.count_if(F.col(c) <= p))])
    for i, (c, p) in enumerate(pivots):
        known[c].pivots[p] = (counts[2 * i], counts[2 * i + 1])


def quantiles(df: DataFrame, wanted: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between the neighbours at (n - 1) q; None without numbers.

    The table is read a few times; typed columns straight from it, text cells
    are parsed once and stored.
    """
    names = {c: f"_x{i}" for i, c in enumerate(wanted)}
    rows = df.select(*[cells.number(df, c).alias(name) for c, name in names.items()])
    parsed = any(cells.is_string(df, c) for c in wanted)
    if parsed:
        rows = stored(rows, "numbers")
    found = quantiles_of(rows, {names[c]: shares for c, shares in wanted.items()}, few)
    if parsed:
        discard(rows)
    return {c: found[name] for c, name in names.items()}


def quantiles_of(rows: DataFrame, wanted: dict[str, list[float]], few: int = FEW) -> dict[str, list[float | None]]:
    """As ``quantiles``, of columns that are doubles without NaN."""
    known = first_look(rows, wanted, few)
    places = {c: [(known[c].n - 1) * q for q in shares] for c, shares in wanted.items() if known[c].n}
    found = order_statistics(rows, {c: sorted({r for p in at for r in (floor(p), ceil(p))}) for c, at in places.items()}, known, few)

    def interpolated(values: dict[int, float], place: float) -> float:
        low, high = values[floor(place)], values[ceil(place)]
        return low + (high - low) * (place - floor(place))

    return {c: [interpolated(found[c], p) for p in places[c]] if c in places else [None] * len(shares) for c, shares in wanted.items()}


def first_look(rows: DataFrame, wanted: dict[str, list[float]], few: int) -> dict[str, Known]:
    """How many values each column has and, where they aren't few, pivots around the wanted shares, proposed in the same pass."""
    figures = []
    for c, shares in wanted.items():
        around = sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-AROUND, 0.0, AROUND)})
        figures += [F.count(c), F.percentile_approx(c, around, ACCURACY)]
    told = in_batches(rows, figures)
    known = {c: Known(told[2 * i]) for i, c in enumerate(wanted)}
    count_pivots(rows, known, {(c, p) for i, c in enumerate(wanted) if known[c].n > few for p in told[2 * i + 1]})
    return known


def medians(df: DataFrame, names: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in quantiles(df, {c: [0.5] for c in names}).items()}


def group_quantile(df: DataFrame, by: str, value: str, q: float, name: str = "quantile") -> DataFrame:
    """(by, <name>): the interpolated quantile of a column of doubles in each group, however large a group is.

    Rows are dealt into ranges by group and value; a value's rank is its place in
    its range and what earlier ranges hold of its group.
    """
    ordered = in_ranges(df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL"), ["_g", "_v"])
    parts = ordered.groupBy("_g", "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    group = Window.partitionBy("_g")  # a row for each range that the group lies in
    before = F.coalesce(F.sum("n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_g").alias("_h"), F.col("_p").alias("_q"), (before - F.col("first")).alias("_shift"), ((F.sum("n").over(group) - 1) * F.lit(float(q))).alias("_at"))
    ranked = ordered.join(starts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q"))).withColumn("_r", F.col("_i") + F.col("_shift"))
    share = F.col("_at") - F.floor("_at")
    weight = F.when(F.col("_r") == F.floor("_at"), 1 - share).when(F.col("_r") == F.ceil("_at"), share)
    near = ranked.where(F.col("_r").between(F.floor("_at"), F.ceil("_at")))
    return near.groupBy(F.col("_g").alias(by)).agg(F.sum(F.col("_v") * weight).alias(name))


def group_quantiles(df: DataFrame, by: str, value: str, cont: dict[str, float], disc: dict[str, float] | None = None) -> DataFrame:
    """(by, name...): quantiles of a column of doubles in each group, however large one is, all from one order; null in groups without values.

    ``cont`` are interpolated at (n - 1) q, ``disc`` the least values that q of the
    group's values reach. Equal values of a group are counted before they are dealt
    into ranges by group and value; no task holds more of a group than a range.
    """
    disc = disc or {}
    counted = df.select(F.col(by).alias("_g"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL").groupBy("_g", "_v").agg(F.count("*").alias("_k"))
    ordered = in_ranges(counted, ["_g", "_v"])
    parts = ordered.groupBy("_g", "_p").agg(F.sum("_k").alias("n"))
    group = Window.partitionBy("_g")  # a row for each range that the group lies in
    before = F.coalesce(F.sum("n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_g").alias("_h"), F.col("_p").alias("_q"), before.alias("_before"), F.sum("n").over(group).alias("_n"))
    within = F.sum("_k").over(Window.partitionBy("_p", "_g").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ordered.withColumn("_upto", within).join(starts, F.col("_g").eqNullSafe(F.col("_h")) & (F.col("_p") == F.col("_q"))).withColumn("_upto", F.col("_upto") + F.col("_before"))
    n = F.col("_n")
    ranks = {f"_{end}_{name}": of((n - 1) * F.lit(float(q))) for name, q in cont.items() for end, of in (("low", F.floor), ("high", F.ceil))}
    ranks |= {f"_low_{name}": F.greatest(F.ceil(n * F.lit(float(q))) - 1, F.lit(0)) for name, q in disc.items()}
    has = {c: (F.col("_upto") > r) & (F.col("_upto") - F.col("_k") <= r) for c, r in ranks.items()}
    found = ranked.groupBy(F.col("_g").alias("_of")).agg(F.first("_n").alias("_n"), *[F.max(F.when(ok, F.col("_v"))).alias(c) for c, ok in has.items()])
    share = lambda q: (n - 1) * F.lit(float(q)) - F.floor((n - 1) * F.lit(float(q)))
    told = {name: F.col(f"_low_{name}") + (F.col(f"_high_{name}") - F.col(f"_low_{name}")) * share(q) for name, q in cont.items()} | {name: F.col(f"_low_{name}") for name in disc}
    groups = df.select(by).distinct()
    return groups.join(found, groups[by].eqNullSafe(found["_of"]), "left").select(by, *[x.alias(name) for name, x in told.items()])


KINDS = {"long": (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.TimestampType, T.BooleanType), "double": (T.FloatType, T.DoubleType)}


def distinct_counts(rows: DataFrame, names: list[str]) -> dict[str, int]:
    """How many different non-null values each column has, exactly: rows by (column, value), grouped, and counted by column.

    Columns of like types share one grouping, so that a value is one number
    where it can be; no set of values is ever held for a column.
    """

    def kind(name: str) -> str:
        return next((k for k, types in KINDS.items() if isinstance(rows.schema[name].dataType, types)), "string")

    def plain(name: str, to: str) -> Column:
        c = F.col(name)
        if isinstance(rows.schema[name].dataType, T.DateType):
            return F.unix_date(c).cast(to)
        if isinstance(rows.schema[name].dataType, T.TimestampType):
            return F.unix_micros(c)
        return c.cast(to)

    parts = []
    for to in sorted({kind(c) for c in names}):
        each = F.array(*[F.struct(F.lit(i).alias("i"), plain(c, to).alias("x")) for i, c in enumerate(names) if kind(c) == to])
        values = rows.select(F.explode(each).alias("s")).select("s.*").where("x IS NOT NULL")
        parts.append(values.groupBy("i", "x").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count("*").alias("n")))
    found = {r["i"]: r["n"] for p in parts for r in p.collect()}  # a row for each column
    return {c: found.get(i, 0) for i, c in enumerate(names)}
