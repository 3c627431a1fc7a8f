"""Counterfactuals in one and two columns: the nearest observed values that change a prediction, and how plausible they are.

Candidates are values that the training rows hold: up to ``SINGLE`` for a column
alone and ``PAIR`` of these for each of two, evenly chosen among its distinct values
(numbers) or the most frequent ones (categories). A number's distance is its step as
a share of the column's range, a category's is 1. Single changes are tried first;
the worst of a row's ``keep`` nearest bounds what a pair may cost, and pairs beyond
the bound are never scored. A row is tried with a bounded number of candidates,
whatever the size of the training table; candidates are a bounded table, rows
are dealt evenly before they meet it, and only changes that flip go on.

A changed row is plausible if it is no farther from the nearest training row than
95 % of training rows are from their own nearest other one (``nearest``). Equal
vectors are looked up once: copies are 0 away from each other, and a changed row that
equals a training row is 0 away from it. Of the
changes of one set of columns the nearest plausible one is told, or else the nearest,
marked as far.
"""

from __future__ import annotations

from itertools import combinations, product
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import nearest
from quern.operators.boosting import bin_edges
from quern.operators.profile import top_values
from quern.operators.quantiles import FEW, first_look, order_statistics
from quern.sources.stored import discard, stored

SINGLE, PAIR, KEEP = 40, 10, 3
PLAUSIBLE = 0.95
#: Flips of a set of columns that are looked at for a plausible one.
LOOKED_AT = 16
#: Candidates that one task tries, about.
TRIED = 1 << 18
TRY = pa.struct([("s", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.float64()), ("b", pa.float64()), ("u", pa.string()), ("v", pa.string())])


def observed_values(train: DataFrame, columns: list[str], most: int = SINGLE) -> dict[str, list]:
    """The values of each column that are tried: ``most`` at most, as training rows hold them."""
    numbers = [c for c in columns if cells.is_numeric(train, c)]
    edges = bin_edges(train.select(F.array(*[F.col(c).cast("double") for c in numbers]).alias("x")), "x", len(numbers), most) if numbers else []
    found: dict[str, list] = dict(zip(numbers, edges, strict=True))
    words = [c for c in columns if c not in numbers]
    if words:
        found |= {c: [] for c in words}
        for r in top_values(train, words, most).orderBy("column", "rank").collect():
            found[r["column"]].append(r["value"])
    return {c: found[c] for c in columns}


def thin(values: list, most: int) -> list:
    """Some of the values, evenly chosen, the first and the last among them."""
    if len(values) <= most:
        return values
    return [values[round(i * (len(values) - 1) / (most - 1))] for i in range(most)]


class Space:
    """Columns that may change, their candidates, and distances between rows."""

    def __init__(self, train: DataFrame, columns: list[str]):
        self.columns, self.values = columns, observed_values(train, columns)
        self.numeric = {c for c in columns if cells.is_numeric(train, c)}
        self.spread = {c: (max(v) - min(v)) or 1.0 for c, v in self.values.items() if c in self.numeric and v}
        self.kinds = {c: "double" if c in self.numeric else "string" for c in columns}

    def step(self, old: Column, new: Column, c: str) -> Column:
        return F.abs(old - new) / self.spread.get(c, 1.0) if c in self.numeric else (~old.eqNullSafe(new)).cast("double")

    def tries(self, spark: SparkSession, sets: list[tuple[str, ...]], most: int) -> tuple[DataFrame, int]:
        """Every combination of candidates of each set of one or two columns, a bounded table, and their number: (_t: its name, the columns' places, the new values as numbers and as text; _rank: its place among the set's, by the told text)."""
        found = []
        for some in sets:
            at = [self.columns.index(c) for c in some]
            for to in product(*[thin(self.values[c], most) for c in some]):
                numbers = [float(v) if c in self.numeric else None for c, v in zip(some, to, strict=True)]
                found.append(dict(zip("sijabuv", [", ".join(some), *[*at, -1][:2], *[*numbers, None][:2], *[*map(str, to), None][:2]], strict=True)))
        table = spark.createDataFrame(pa.table({"_t": pa.array(found, TRY)}))
        return table.withColumn("_rank", F.row_number().over(Window.partitionBy("_t.s").orderBy(F.to_json(self.told())))), len(found)

    def new(self, c: str, at: str) -> Column:
        """What a try puts into a column as its first (``i``) or second (``j``) one."""
        number, word = ("_t.a", "_t.u") if at == "i" else ("_t.b", "_t.v")
        return F.col(number if c in self.numeric else word)

    def cost(self, at: str) -> Column:
        """The step that a try takes in its first or second column."""
        found = F.lit(0.0)
        for k, c in enumerate(self.columns):
            found = F.when(F.col(f"_t.{at}") == k, self.step(F.col(c), self.new(c, at), c)).otherwise(found)
        return found

    def changed(self, rows: DataFrame) -> DataFrame:
        """The rows with the values of the try ``_t`` in place of their own."""
        return rows.withColumns({c: F.when(F.col("_t.i") == k, self.new(c, "i")).when(F.col("_t.j") == k, self.new(c, "j")).otherwise(F.col(c)) for k, c in enumerate(self.columns)})

    def told(self) -> Column:
        """A try's new values as text by column."""
        name = lambda at: F.get(F.array(*[F.lit(c) for c in self.columns]), F.col(f"_t.{at}"))
        return F.when(F.col("_t.j") < 0, F.create_map(name("i"), F.col("_t.u"))).otherwise(F.create_map(name("i"), F.col("_t.u"), name("j"), F.col("_t.v")))

    def vector(self) -> Column:
        """A row as numbers: shares of each column's range, a place of its own for each candidate category."""
        parts = []
        for c in self.columns:
            if c in self.numeric:
                parts.append(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / self.spread.get(c, 1.0))
            else:
                parts += [F.col(c).eqNullSafe(F.lit(v)).cast("double") for v in self.values[c]]
        return F.array(*parts)


def flips(space: Space, rows: DataFrame, n: int, predict: Column, wanted: Column, sets: list[tuple[str, ...]], most: int, key: str, bound: Column | None = None) -> DataFrame:
    """The changed rows, of ``n``, that have the wanted prediction: (key, _set, _cost, _t, _rank, the columns, predicted)."""
    tries, each = space.tries(rows.sparkSession, sets, most)
    dealt = rows.repartition(max(1, -(-n * each // TRIED)), key)
    tried = dealt.crossJoin(F.broadcast(tries)).withColumns({"_first": space.cost("i"), "_second": space.cost("j")})
    tried = tried.where((F.col("_first") > 0) & ((F.col("_t.j") < 0) | (F.col("_second") > 0))).withColumns({"_set": F.col("_t.s"), "_cost": F.col("_first") + F.col("_second")})
    if bound is not None:
        tried = tried.where(F.col("_cost") <= bound)
    return space.changed(tried).withColumn("predicted", predict).where(wanted).select(key, "_set", "_cost", "_t", "_rank", *space.columns, "predicted")


def search(rows: DataFrame, train: DataFrame, columns: list[str], predict: Column, wanted: Column, key: str, keep: int = KEEP) -> DataFrame:
    """(key, columns, to, cost, far, predicted): for each row the changes in one or two columns that give the wanted prediction, ``keep`` sets of columns at most.

    ``predict`` is an expression over the columns, ``wanted`` one over ``predicted``;
    rows that have the wanted prediction already need no change and give none.
    Plausible changes come before far ones, one column before two, near before far away.
    A stored table; keys are integers.
    """
    space = Space(train, columns)
    plain = rows.withColumns({c: F.col(c).cast(space.kinds[c]) for c in columns})
    unmet = stored(plain.withColumn("predicted", predict).where(~wanted).drop("predicted"), "unmet")
    n = unmet.count()
    singles = stored(flips(space, unmet, n, predict, wanted, [(c,) for c in columns], SINGLE, key), "single-flips")
    best = singles.groupBy(key, "_set").agg(F.min("_cost").alias("c")).groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("_costs"))
    bounded = unmet.join(best, key, "left").withColumn("_bound", F.coalesce(F.get("_costs", F.lit(keep - 1)), F.lit(float("inf"))))
    pairs = flips(space, bounded, n, predict, wanted, list(combinations(columns, 2)), PAIR, key, F.col("_bound")) if len(columns) > 1 else singles.where("false")
    both = singles.unionByName(pairs)
    near = Window.partitionBy(key, "_set").orderBy("_cost", "_rank")
    looked = stored(both.withColumn("_place", F.row_number().over(near)).where(F.col("_place") <= LOOKED_AT).select(key, "_set", "_cost", space.told().alias("_to"), "_place", "predicted", space.vector().alias("_x")), "flips")
    points = distinct_vectors(train.select(space.vector().alias("x")))
    away = distances(points, looked.select(F.col("_x").alias("x")), own_distance(points))
    judged = looked.join(away, F.col("_x") == F.col("x"))
    one = Window.partitionBy(key, "_set").orderBy("far", "_cost", "_place")
    size = F.size("_to")
    chosen = judged.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    ranked = chosen.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("far", size, "_cost", "_set"))).where(F.col("_r") <= keep)
    found = stored(ranked.select(key, F.col("_set").alias("columns"), F.to_json("_to").alias("to"), F.col("_cost").alias("cost"), "far", "predicted"), "counterfactuals")
    discard(unmet, singles, looked, points, away)
    return found


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(x, n, _id): each vector once, with the number of its rows. A stored table."""
    return stored(vectors.groupBy("x").agg(F.count("*").alias("n")).withColumn("_id", F.monotonically_increasing_id()), "points")


def own_distance(points: DataFrame) -> float:
    """What 95 % of training rows are away from the nearest other one at most. points: distinct vectors.

    Copies are 0 away from each other and come first, so that only vectors of a
    single row are looked up, and these only if the wanted rank lies among them.
    """
    copies, alone = points.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)), F.count_if(F.col("n") == 1)).first()
    if copies + alone < 2:
        return float("inf")
    place = (copies + alone - 1) * PLAUSIBLE
    ranks = [floor(place) - copies, ceil(place) - copies]
    if ranks[1] < 0:
        return 0.0
    found = nearest.neighbours(points, points.where("n = 1"), "x", "_id", k=2)
    apart = found.select(F.get("near", F.lit(1))["distance"].alias("d"))
    known = first_look(apart, {"d": [max(0, r) / max(1, alone - 1) for r in ranks]}, FEW)
    at = order_statistics(apart, {"d": sorted({max(0, r) for r in ranks})}, known)["d"]
    discard(found)
    low, high = (at[r] if r >= 0 else 0.0 for r in ranks)
    return low + (high - low) * (place - floor(place))


def distances(points: DataFrame, probes: DataFrame, farthest: float) -> DataFrame:
    """(x, far): each distinct vector of the probes, and whether it is farther than that from every point. A stored table.

    Vectors that points have are not looked for any further; where nothing but these is near enough, no others are.
    """
    known = probes.distinct().join(points.select(F.col("x").alias("_p"), F.lit(0.0).alias("_same")), F.col("x") == F.col("_p"), "left").select("x", "_same")
    if farthest in (0.0, float("inf")):
        return stored(known.select("x", (F.col("_same").isNull() & F.lit(farthest == 0.0)).alias("far")), "distances")
    asked = stored(known.withColumn("_id", F.monotonically_increasing_id()), "asked")
    found = nearest.neighbours(points, asked.where("_same IS NULL"), "x", "_id", k=1)
    away = asked.join(found, "_id", "left").select("x", F.coalesce("_same", F.get("near", F.lit(0))["distance"]).alias("d"))
    judged = stored(away.select("x", F.coalesce(F.col("d") > farthest, F.lit(False)).alias("far")), "distances")
    discard(asked, found)
    return judged


def changes(found: DataFrame, key: str) -> DataFrame:
    """(key, columns, column, value): what was told, a row for each change."""
    return found.select(key, "columns", F.explode(F.from_json("to", "map<string,string>")).alias("column", "value"))


def agreement(found: DataFrame, key: str, of: int) -> DataFrame:
    """(column, rows, share): how many of ``of`` rows a plausible change of the column helps."""
    each = changes(found.where("NOT far"), key).select(key, "column").distinct()
    return each.groupBy("column").agg(F.count("*").alias("rows")).withColumn("share", F.col("rows") / max(1, of))
