"""Histogram gradient boosting over all rows: one aggregate of gradients for every level of every tree.

Features are cut once into at most 32 bins at quantiles of their distinct values.
A row counts by its bin codes alone, so that rows of one code vector (and class) are
stored as one, with their number, weight and mean label, and with their scores. For a
level of a tree every task adds up gradients, hessians and rows by (booster, node, feature, bin); Spark adds up
the tasks' sums; the driver, which sees only those (nodes x features x bins),
takes the split with the highest second-order gain of each node. Where one task has
all stored rows, a pass costs more than what it adds up: there it sums by pairs of bins,
which tell of the next level too, whatever the split, so that a tree takes half as many
passes. Leaves are Newton steps. All one-vs-rest boosters of a classifier grow their trees in the same
passes. Scores are moved on and stored every few rounds, so that a lost executor
costs one pass and no pass walks more than those rounds' trees.

Without randomness: the same rows give the same trees, up to the order in which
sums of gradients are rounded. Nulls count as less than every number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import in_ranges
from quern.operators.trees import Ensemble, Tree, matrix
from quern.sources.stored import discard, stored

#: Rounds after which scores are stored.
STORED_EVERY = 10
#: Stored rows that one task goes through in a pass, if there are so many.
ROWS_A_TASK = 1 << 16
#: Pairs of bins that one pass sums by, over all open nodes; beyond that it sums by bins and serves one level.
PAIRS = 1 << 17
LEAST_HESSIAN = 1e-12
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class Settings:
    rounds: int = 120
    rate: float = 0.1
    depth: int = 4
    least_rows: int = 10
    ridge: float = 1.0
    bins: int = 32


def bin_edges(df: DataFrame, features: str, width: int, bins: int = Settings.bins) -> list[list[float]]:
    """Upper edges of each feature's bins: its distinct values, or so many quantiles of them.

    Distinct values of all features are put in one global order by range; the
    wanted ranks are read off. The driver takes ``bins`` numbers a feature.
    """
    each = F.posexplode(F.col(features)).alias("_f", "_v")
    values = df.select(each).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_f") < width)).distinct()
    ordered = in_ranges(values, ["_f", "_v"])
    parts = ordered.groupBy("_f", "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    feature = Window.partitionBy("_f")  # a row for each range that the feature lies in
    before = F.coalesce(F.sum("n").over(feature.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("_f").alias("_g"), F.col("_p").alias("_q"), (before - F.col("first")).alias("_shift"), F.sum("n").over(feature).alias("_n"))
    rank = F.col("_i") + F.col("_shift")
    ranked = ordered.join(starts, (F.col("_f") == F.col("_g")) & (F.col("_p") == F.col("_q"))).select("_f", "_v", rank.alias("_r"), "_n")
    # The b-th edge has rank floor(b n / bins) - 1; b is the least that reaches a rank.
    wanted = F.expr(f"_n <= {bins} OR _r + 1 = ((((_r + 1) * {bins} + _n - 1) DIV _n) * _n) DIV {bins}")
    found: list[list[float]] = [[] for _ in range(width)]
    for r in ranked.where(wanted).orderBy("_f", "_v").collect():
        found[r["_f"]].append(r["_v"])
    discard(ordered)
    return found


def code(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """rows x features: the first bin whose upper edge isn't below the value, the last one for values beyond; nulls in the first."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        if e:
            out[:, j] = np.minimum(np.searchsorted(e, np.nan_to_num(x[:, j], nan=-np.inf)), len(e) - 1)
    return out


@dataclass
class Growing:
    """A tree under way: nodes are numbered as they come; open ones wait for their split."""

    feature: list[int]
    bin: list[int]
    left: list[int]
    right: list[int]
    value: list[float]
    rows: list[int]
    open: list[int]
    depth: int = 0

    @classmethod
    def begun(cls) -> Growing:
        return cls([-1], [0], [-1], [-1], [0.0], [0], [0])

    def add(self, value: float, rows: int) -> int:
        for column, x in zip((self.feature, self.bin, self.left, self.right, self.value, self.rows), (-1, 0, -1, -1, value, rows), strict=True):
            column.append(x)
        return len(self.feature) - 1

    def tree(self, edges: list[list[float]]) -> Tree:
        cuts = [edges[f][b] if f >= 0 else 0.0 for f, b in zip(self.feature, self.bin, strict=True)]
        return Tree(np.array(self.feature), np.array(cuts), np.array(self.left), np.array(self.right), np.array(self.value)[:, None], np.array(self.rows))

    def on_codes(self) -> Tree:
        """The tree over bin codes instead of values."""
        return Tree(np.array(self.feature), np.array(self.bin, float), np.array(self.left), np.array(self.right), np.array(self.value)[:, None], np.array(self.rows))


def gradients(y: np.ndarray, weight: np.ndarray, score: np.ndarray, booster: int, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss at the scores: squares, or the log loss of one class against the rest."""
    if task == "regression":
        return weight * (score - y), weight
    p = 1 / (1 + np.exp(-score))
    return weight * (p - (y == booster)), weight * np.maximum(p * (1 - p), LEAST_HESSIAN)


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, s: Settings) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node; None if none gains. g, h, n: features x bins; first of equals."""
    left_g, left_h, left_n = (np.cumsum(x, axis=1)[:, :-1] for x in (g, h, n))
    all_g, all_h, all_n = (x[0].sum() for x in (g, h, n))
    gains = 0.5 * (left_g**2 / (left_h + s.ridge) + (all_g - left_g) ** 2 / (all_h - left_h + s.ridge) - all_g**2 / (all_h + s.ridge))
    gains[(left_n < s.least_rows) | (all_n - left_n < s.least_rows)] = -np.inf
    best = None
    for f in range(len(gains)):  # as many as there are features
        top = gains[f].max(initial=-np.inf)
        if top > (best[0] + LEAST_GAIN if best else -1e-9):
            best = (float(top), f, int(np.argmax(gains[f] >= top - LEAST_GAIN)))
    return best


def own(pairs: np.ndarray, width: int) -> np.ndarray:
    """3 x features x bins of a node, from its sums by pairs of bins: each bin with itself."""
    return np.diagonal(pairs, axis1=1, axis2=2).reshape(3, width, -1)


def halves(pairs: np.ndarray, width: int, feature: int, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """3 x features x bins of both children of a node, from its sums by pairs of bins: those with a bin on their side of the split."""
    of = np.split(pairs, width, axis=1)[feature]
    return tuple(part.sum(axis=1).reshape(3, width, -1) for part in (of[:, : cut + 1], of[:, cut + 1 :]))


class Boosters:
    """Boosters of one model, grown side by side over stored codes."""

    def __init__(self, rows: DataFrame, edges: list[list[float]], task: str, bases: list[float], settings: Settings, tasks: int):
        """rows: (y, weight, rows, codes, scores), stored for so many tasks."""
        self.rows, self.tasks = rows, tasks
        self.edges, self.task, self.bases, self.s = edges, task, bases, settings
        self.bins = max(2, max(map(len, edges), default=2))
        self.done: list[list[Growing]] = [[] for _ in bases]
        self.unstored: list[list[Tree]] = [[] for _ in bases]

    def ahead(self, trees: dict[int, Growing]) -> bool:
        """Whether the next pass sums by pairs of bins, for two levels: trees under way are equally deep."""
        nodes, bins = sum(len(t.open) for t in trees.values()), self.bins * len(self.edges)
        return self.tasks == 1 and nodes * bins**2 <= PAIRS and next(iter(trees.values())).depth + 1 < self.s.depth

    def histograms(self, trees: dict[int, Growing], pairs: bool = False) -> dict[tuple[int, int], np.ndarray]:
        """(booster, node) -> 3 x features x bins: sums of gradients, hessians and weightless rows of the open nodes, in one aggregate.

        With ``pairs`` 3 x (features x bins) x (features x bins): the sums of what lies in both bins.
        """
        task, rate, bins, width = self.task, self.s.rate, self.bins, len(self.edges)
        size = (width * bins) ** 2 if pairs else width * bins
        first, second = np.triu_indices(width)
        before = self.unstored
        under_way = {b: (t.on_codes(), t.open) for b, t in trees.items()}

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {b: np.zeros((len(nodes), 3, size)) for b, (_, nodes) in under_way.items()}
            for batch in batches:
                y, weight, many, codes, scores = unpacked(batch, width)
                x = codes.astype(float)
                places = codes.astype(np.int64) + np.arange(width) * bins
                if pairs:
                    places = places[:, first] * (width * bins) + places[:, second]
                for b, (tree, nodes) in under_way.items():
                    score = moved(scores[:, b], x, before[b], rate)
                    g, h = gradients(y, weight, score, b, task)
                    at = tree.leaves(x)
                    for i, node in enumerate(nodes):
                        here = at == node
                        where = places[here].ravel()
                        for k, v in enumerate((g, h, many)):
                            total[b][i, k] += np.bincount(where, np.repeat(v[here], places.shape[1]), size)
            for b, (_, nodes) in under_way.items():
                for i, node in enumerate(nodes):
                    full = np.flatnonzero(total[b][i, 2])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), v), pa.int32()) for v in (b, node)] + [pa.array(full, pa.int32())] + [pa.array(total[b][i, k][full]) for k in range(3)], names=["b", "node", "place", "g", "h", "n"])

        parts = self.rows.mapInArrow(add_up, "b int, node int, place int, g double, h double, n double")
        found = {(b, node): np.zeros((3, size)) for b, (_, nodes) in under_way.items() for node in nodes}
        if self.tasks > 1:  # one task's sums are the sums
            parts = parts.groupBy("b", "node", "place").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        sums = parts.toArrow()  # nodes x features x bins, or PAIRS at most
        b, node, place, *values = (c.to_numpy() for c in sums.columns)
        for key, total in found.items():
            here = (b == key[0]) & (node == key[1])
            for k in range(3):
                total[k, place[here]] = values[k][here]
        if not pairs:
            return {k: v.reshape(3, width, bins) for k, v in found.items()}
        half = {k: v.reshape(3, width * bins, width * bins) for k, v in found.items()}  # each pair once, the lower bin first
        return {k: v + np.triu(v, 1).transpose(0, 2, 1) for k, v in half.items()}

    def grow(self, tree: Growing, sums: dict[int, np.ndarray]) -> None:
        """Splits the open nodes of a tree by their histograms; children stay open down to the last level."""
        children = []
        for node in tree.open:
            g, h, n = sums[node]
            value = lambda a, b: float(-a / (b + self.s.ridge))
            tree.value[node], tree.rows[node] = value(g[0].sum(), h[0].sum()), int(n[0].sum())
            split = best_split(g, h, n, self.s) if tree.rows[node] >= 2 * self.s.least_rows else None
            if split is None:
                continue
            _, f, b = split
            left, right = (tree.add(value(g[f, part].sum(), h[f, part].sum()), int(n[f, part].sum())) for part in (slice(0, b + 1), slice(b + 1, None)))
            tree.feature[node], tree.bin[node], tree.left[node], tree.right[node] = f, b, left, right
            children += [left, right]
        tree.depth += 1
        tree.open = children if tree.depth < self.s.depth else []

    def round(self, active: list[int]) -> list[int]:
        """One tree for each active booster; gives back those that still find something."""
        trees = {b: Growing.begun() for b in active}
        while under_way := {b: t for b, t in trees.items() if t.open}:
            pairs, width = self.ahead(under_way), len(self.edges)
            sums = self.histograms(under_way, pairs)
            for b, t in under_way.items():
                nodes = t.open
                self.grow(t, {node: own(sums[b, node], width) if pairs else sums[b, node] for node in nodes})
                if pairs and t.open:
                    self.grow(t, {child: h for node in nodes if t.feature[node] >= 0 for child, h in zip((t.left[node], t.right[node]), halves(sums[b, node], width, t.feature[node], t.bin[node]), strict=True)})
        left = [b for b in active if len(trees[b].feature) > 1 or abs(trees[b].value[0]) >= 1e-10]
        for b in left:
            self.done[b].append(trees[b])
            self.unstored[b].append(trees[b].on_codes())
        return left

    def store_scores(self) -> None:
        """The rows with scores moved on by the trees since they were stored."""
        before, rate, width = self.unstored, self.s.rate, len(self.edges)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, _, codes, scores = unpacked(batch, width)
                x = codes.astype(float)
                new = np.column_stack([moved(scores[:, b], x, trees, rate) for b, trees in enumerate(before)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in new], pa.binary())], names=["y", "weight", "rows", "codes", "scores"])

        old = self.rows
        self.rows = stored(old.mapInArrow(move, CODED).coalesce(self.tasks), "boosting")
        discard(old)
        self.unstored = [[] for _ in self.bases]

    def fit(self) -> list[Ensemble]:
        active = list(range(len(self.bases))) if self.edges else []  # without features there is nothing to split
        for i in range(self.s.rounds):
            if not (active := self.round(active)):
                break
            if i % STORED_EVERY == STORED_EVERY - 1 and i + 1 < self.s.rounds:
                self.store_scores()
        discard(self.rows)
        return [Ensemble(tuple(t.tree(self.edges) for t in trees), (self.s.rate,) * len(trees), base, "sum") for trees, base in zip(self.done, self.bases, strict=True)]


CODED = "y double, weight double, rows double, codes binary, scores binary"


def unpacked(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, weight, rows, codes, scores) of a batch of coded rows."""
    n = batch.num_rows
    y, weight, many = (batch[i].to_numpy(zero_copy_only=False) for i in range(3))
    codes = np.frombuffer(b"".join(batch[3].to_pylist()), np.uint8).reshape(n, width)
    scores = np.frombuffer(b"".join(batch[4].to_pylist()), np.float64).reshape(n, -1)
    return y, weight, many, codes, scores


def moved(score: np.ndarray, x: np.ndarray, trees: list[Tree], rate: float) -> np.ndarray:
    for t in trees:
        score = score + rate * t.value[t.leaves(x), 0]
    return score


def tasks_for(n: int) -> int:
    """Tasks that share the passes over so many rows, at most: small tables aren't cut finer than a pass is worth."""
    return max(1, -(-n // ROWS_A_TASK))


def coded(df: DataFrame, features: str, label: str, weight: Column, edges: list[list[float]], bases: list[float], task: str) -> tuple[DataFrame, int]:
    """(y, weight, rows, codes, scores), a row for each code vector (and class) of the rows that have a label, and the tasks that it is stored for.

    Squares need of rows that fall into the same bins only their weight and weighted mean.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = code(matrix(batch[2]), edges)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array([r.tobytes() for r in codes], pa.binary())], names=["y", "weight", "codes"])

    rows = df.select(F.col(label).cast("double").alias("y"), weight.cast("double").alias("weight"), F.col(features).alias("x")).where("y IS NOT NULL")
    each = rows.mapInArrow(pack, "y double, weight double, codes binary")
    total = [F.sum("weight").alias("weight"), F.count("*").cast("double").alias("rows")]
    if task == "regression":
        alike = each.groupBy("codes").agg(F.try_divide(F.sum(F.col("weight") * F.col("y")), F.sum("weight")).alias("y"), *total).withColumn("y", F.coalesce("y", F.lit(0.0)))
    else:
        alike = each.groupBy("codes", "y").agg(*total)
    start = F.lit(bytearray(np.array(bases).tobytes()))
    loose = stored(alike.select("y", "weight", "rows", "codes", start.alias("scores")), "boosting-codes")
    tasks = tasks_for(loose.count())
    found = stored(loose.coalesce(tasks), "boosting")
    discard(loose)
    return found, tasks


def width_of(df: DataFrame, features: str) -> int:
    return df.agg(F.max(F.size(features))).first()[0] or 0


def mean_of(df: DataFrame, label: str) -> float:
    return float(df.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0)


def fit_regressor(df: DataFrame, features: str, label: str, settings: Settings = Settings()) -> Ensemble:
    """Squared loss from the mean on. features: a column of arrays of doubles, one length."""
    width = width_of(df, features)
    edges = bin_edges(df, features, width, settings.bins)
    base = mean_of(df, label)
    rows, tasks = coded(df, features, label, F.lit(1.0), edges, [base], "regression")
    return Boosters(rows, edges, "regression", [base], settings, tasks).fit()[0]


@dataclass(frozen=True)
class Classifier:
    """Boosters of each class against the rest (one for two classes); shares are their sigmoids, made to sum to one."""

    boosters: tuple[Ensemble, ...]
    classes: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        p = np.column_stack([1 / (1 + np.exp(-b.scores(x)[:, 0])) for b in self.boosters])
        if self.classes == 2:
            return np.column_stack([1 - p[:, 0], p[:, 0]])
        total = p.sum(axis=1, keepdims=True)
        return p / np.where(total > 0, total, 1)

    def predict(self, features: Column | str) -> Column:
        """The classes' shares of an array of features."""

        @F.arrow_udf("array<double>")
        def told(vectors: pa.Array) -> pa.Array:
            return pa.array(list(self.probability(matrix(vectors))), pa.list_(pa.float64()))

        return told(features)


def fit_classifier(df: DataFrame, features: str, label: str, classes: int, settings: Settings = Settings(), class_weights: dict[int, float] | None = None) -> Classifier:
    """Log loss of each class (0, 1, ...) against the rest from the log odds of its share on. Weights scale gradients and hessians alike."""
    width = width_of(df, features)
    edges = bin_edges(df, features, width, settings.bins)
    weight = F.lit(1.0)
    for k, w in (class_weights or {}).items():
        weight = F.when(F.col(label) == k, float(w)).otherwise(weight)
    shares = {int(r[0]): r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.sum(weight)).collect()}  # a row for each class
    total = sum(shares.values()) or 1.0
    of = [1] if classes == 2 else range(classes)
    prior = [min(1 - 1e-6, max(1e-6, shares.get(k, 0.0) / total)) for k in of]
    bases = [float(np.log(p / (1 - p))) for p in prior]
    # With two classes the one booster is class 1's, which is booster 0: its rows are turned round.
    target = df.withColumn(label, 1 - F.col(label)) if classes == 2 else df
    rows, tasks = coded(target, features, label, weight if classes != 2 else weight_of_turned(label, class_weights), edges, bases, "classification")
    boosters = Boosters(rows, edges, "classification", bases, settings, tasks)
    return Classifier(tuple(boosters.fit()), classes)


def weight_of_turned(label: str, class_weights: dict[int, float] | None) -> Column:
    weight = F.lit(1.0)
    for k, w in (class_weights or {}).items():
        weight = F.when(F.col(label) == 1 - k, float(w)).otherwise(weight)
    return weight


def root_splits(df: DataFrame, features: str, label: str, settings: Settings = Settings()) -> DataFrame:
    """(feature, edge, rows, gain, left, right): every split of the first tree's root in a regression, with both leaves' values."""
    width = width_of(df, features)
    edges = bin_edges(df, features, width, settings.bins)
    base = mean_of(df, label)
    rows, tasks = coded(df, features, label, F.lit(1.0), edges, [base], "regression")
    sums = Boosters(rows, edges, "regression", [base], settings, tasks).histograms({0: Growing.begun()})[0, 0]
    discard(rows)
    g, h, n = sums
    told = []
    for f, e in enumerate(edges):
        for b in range(len(e) - 1):
            (lg, lh, ln), (rg, rh, rn) = ([x[f, part].sum() for x in (g, h, n)] for part in (slice(0, b + 1), slice(b + 1, None)))
            if min(ln, rn) >= settings.least_rows:
                gain = 0.5 * (lg**2 / (lh + settings.ridge) + rg**2 / (rh + settings.ridge) - (lg + rg) ** 2 / (lh + rh + settings.ridge))
                told.append((f, float(e[b]), int(ln), float(gain), float(-lg / (lh + settings.ridge)), float(-rg / (rh + settings.ridge))))
    return df.sparkSession.createDataFrame(told, "feature int, edge double, rows long, gain double, left double, right double")
