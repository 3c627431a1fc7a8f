"""Exact nearest neighbours by pivots: a probe visits only the parts of space that its bound reaches.

Rows go to the nearest of a bounded number of pivots (a Voronoi partition), and
within each partition they are dealt into rings by their distance to the pivot, at
most ``RING`` rows to a ring. By the triangle inequality a ring whose rows are
between ``low`` and ``high`` away from a pivot holds nothing nearer to a probe,
itself ``d`` away from that pivot, than d - high and low - d; and nothing of
another partition is nearer than the half-plane between the two pivots. First each
probe looks into the ring that it would lie in itself; the k-th distance found
there is its bound, and it visits every other ring that the bound reaches. Where
vectors form clusters few are left; where they don't all are, and the result is
the same.

Rings bound the rows of a visit, salts the probes: no group is larger than ``RING``
rows and about ``PROBES`` probes, however dense a cluster is. The driver holds the
pivots and one number a partition, nothing that grows with the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import in_ranges
from quern.sources.stored import discard, stored

#: Rows of a ring, probes that visit it at once, pivots at most.
RING, PROBES, PIVOTS = 2048, 2048, 1024
#: Rings of a partition among which a probe takes its first.
MARKS = 64
#: How much further a bound reaches than it says: distances are rounded.
SLACK = 1e-9
#: Share of squared lengths that rounding may cost a difference of squared distances.
ROUNDING = 1e-12
#: Numbers that a task holds at once of differences between probes and rows.
HELD = 1 << 22
NEAR = "array<struct<distance:double,key:long,value:double>>"


def clean(vector: Column) -> Column:
    return vector.cast("array<double>")


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """Some of the rows, chosen by hash, none twice: a bounded number of vectors."""
    wanted = max(1, min(PIVOTS, int(2 * np.sqrt(n))))
    drawn = rows.select("_x", F.xxhash64("_k", F.lit(17)).alias("h")).orderBy("h").limit(wanted).collect()
    return np.unique(np.array([r["_x"] for r in drawn], dtype=float), axis=0) if drawn else np.zeros((0, 1))


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * q @ x.T))


def unpacked(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an array of lists of one length; missing numbers are NaN."""
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(whole), -1) if len(whole) else np.zeros((0, 0))


def placed(vector: Column, pivots: np.ndarray) -> Column:
    """(part, distance): the nearest pivot and how far it is."""

    @F.arrow_udf("struct<part:int,distance:double>")
    def nearest(vectors: pa.Array) -> pa.Array:
        x = unpacked(vectors)
        part = distances(x, pivots).argmin(1) if len(x) else np.zeros(0, int)
        return pa.StructArray.from_arrays([pa.array(part, pa.int32()), pa.array(np.sqrt(((x - pivots[part]) ** 2).sum(1)) if len(x) else [], pa.float64())], names=["part", "distance"])

    return nearest(vector)


def reached(vector: Column, home: Column, bound: Column, pivots: np.ndarray, farthest: np.ndarray) -> Column:
    """array<(part, distance)> of the partitions that a probe's bound may reach. farthest: the greatest distance from each pivot (below 0 without rows)."""
    apart = distances(pivots, pivots)
    size = 1 + (pivots**2).sum(1).max(initial=0) + max(0.0, farthest.max(initial=0)) ** 2

    @F.arrow_udf("array<struct<part:int,distance:double>>")
    def visits(vectors: pa.Array, homes: pa.Array, bounds: pa.Array) -> pa.Array:
        x, homes, bounds = unpacked(vectors), homes.to_numpy(zero_copy_only=False), bounds.to_numpy(zero_copy_only=False)
        many, parts, away = np.zeros(len(x), np.int64), [], []
        step = max(1, HELD // max(1, pivots.size))
        for i in range(0, len(x), step):
            q, mine, reach = x[i : i + step], homes[i : i + step].astype(np.int64), bounds[i : i + step, None]
            d = np.sqrt(((pivots[None] - q[:, None]) ** 2).sum(2))
            # Rows went to the nearest pivot up to rounding, which counts for more the closer two pivots are.
            own, between = d[np.arange(len(q)), mine][:, None], apart[mine]
            across = (d * d - own**2 - ROUNDING * (size + (q * q).sum(1)[:, None])) / (2 * np.where(between > 0, between, np.inf))
            row, part = np.nonzero((farthest >= 0) & (np.maximum(d - farthest, across) <= reach + SLACK * (1 + d)))
            many[i : i + step] = np.bincount(row, minlength=len(q))
            parts.append(part)
            away.append(d[row, part])
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(parts or [[]]), pa.int32()), pa.array(np.concatenate(away or [[]]), pa.float64())], names=["part", "distance"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), flat)

    return visits(vector, home, bound)


class Index:
    """Training rows by partition and ring, stored: (_part, _ring, _k, _v, _x)."""

    def __init__(self, train: DataFrame, vector: str, key: str, value: str | None):
        own = F.lit(None).cast("double") if value is None else F.col(value).cast("double")
        base = train.select(F.col(key).cast("long").alias("_k"), own.alias("_v"), clean(F.col(vector)).alias("_x")).where("_x IS NOT NULL")
        self.n = base.count()
        self.pivots = pivots_of(base, self.n)
        if not self.n:
            return
        away = stored(base.withColumn("_at", placed(F.col("_x"), self.pivots)).select("_k", "_v", "_x", F.col("_at.part").alias("_part"), F.col("_at.distance").alias("_d")), "pivot-parts")
        ordered = in_ranges(away, ["_part", "_d", "_k"])
        parts = ordered.groupBy("_part", "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
        part = Window.partitionBy("_part")  # a row for each range that the partition lies in
        before = F.coalesce(F.sum("n").over(part.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = parts.select(F.col("_part").alias("_h"), F.col("_p").alias("_q"), (before - F.col("first")).alias("_shift"))
        ringed = ordered.join(starts, (F.col("_part") == F.col("_h")) & (F.col("_p") == F.col("_q"))).withColumn("_ring", F.floor((F.col("_i") + F.col("_shift")) / RING).cast("int"))
        self.rows = stored(ringed.select("_part", "_ring", "_k", "_v", "_x", "_d"), "rings")
        self.rings = stored(self.rows.groupBy("_part", "_ring").agg(F.min("_d").alias("low"), F.max("_d").alias("high"), F.count("*").alias("size")), "ring-bounds")
        self.farthest = np.full(len(self.pivots), -1.0)
        for r in self.rings.groupBy("_part").agg(F.max("high").alias("far")).collect():  # a row for each pivot
            self.farthest[r["_part"]] = r["far"]
        discard(away, ordered)

    def discard(self) -> None:
        if self.n:
            discard(self.rows, self.rings)


def visited(index: Index, visits: DataFrame, k: int) -> DataFrame:
    """(_pk, near): the k nearest rows of each visited ring. visits: (_part, _ring, _pk, _px), stored.

    A ring that many probes visit is copied for every so many of them.
    """
    crowds = visits.groupBy("_part", "_ring").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("_salts"))
    rows = index.rows.join(crowds, ["_part", "_ring"]).select("_part", "_ring", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_k", "_v", "_x")
    asked = visits.join(crowds, ["_part", "_ring"]).select("_part", "_ring", F.pmod(F.xxhash64("_pk"), F.col("_salts")).cast("int").alias("_salt"), "_pk", "_px")

    def search(block: pa.Table, probes: pa.Table) -> pa.Table:
        if not block.num_rows or not probes.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], near_type)], names=["_pk", "near"])
        x, q = unpacked(block["_x"]), unpacked(probes["_px"])
        keys, values = block["_k"].to_numpy(), block["_v"].combine_chunks()
        many, chosen, away = np.zeros(len(q), np.int64), [], []
        step = max(1, HELD // max(1, x.size))
        for i in range(0, len(q), step):
            some = q[i : i + step]
            d = distances(some, x)
            if len(x) > k:
                limit = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + SLACK) + SLACK * (1 + np.abs(some).max(1, initial=0))
                row, at = np.nonzero(d <= limit[:, None])
            else:
                row, at = (v.ravel() for v in np.indices(d.shape))
            exact = np.sqrt(((x[at] - some[row]) ** 2).sum(1))
            order = np.lexsort((keys[at], exact, row))
            row, at, exact = row[order], at[order], exact[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            many[i : i + step] = np.bincount(row[best], minlength=len(some))
            chosen.append(at[best])
            away.append(exact[best])
        picked = np.concatenate(chosen)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(away)), pa.array(keys[picked]), values.take(pa.array(picked))], names=["distance", "key", "value"])
        near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), flat)
        return pa.Table.from_arrays([probes["_pk"].combine_chunks(), near], names=["_pk", "near"])

    near_type = pa.list_(pa.struct([("distance", pa.float64()), ("key", pa.int64()), ("value", pa.float64())]))
    by = ["_part", "_ring", "_salt"]
    return rows.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, f"_pk long, near {NEAR}")


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of what a probe found in all its rings."""
    return found.select("_pk", F.explode("near").alias("n")).groupBy("_pk").agg(F.slice(F.array_sort(F.collect_list("n")), 1, k).alias("near"))


def neighbours(train: DataFrame, probes: DataFrame, vector: str, key: str, value: str | None = None, k: int = 5) -> DataFrame:
    """(key, near: array<struct<distance, key, value>>): each probe's k nearest training rows, exact, ties to the lesser key.

    Keys are integers, a probe's its own; rows without a vector are left out;
    without training rows there is nothing. A stored table.
    """
    index = Index(train, vector, key, value)
    spark = train.sparkSession
    if not index.n:
        return spark.createDataFrame([], f"{key} long, near {NEAR}")
    asked = probes.select(F.col(key).cast("long").alias("_pk"), clean(F.col(vector)).alias("_px")).where("_px IS NOT NULL")
    homes = stored(asked.withColumn("_home", placed(F.col("_px"), index.pivots)).select("_pk", "_px", F.col("_home.part").alias("_part"), F.col("_home.distance").alias("_d")), "probes")
    first = first_rings(index, homes)
    looked = stored(visited(index, first, k), "first-rings")
    bound = F.when(F.size("near") >= k, F.get("near", F.lit(k - 1))["distance"]).otherwise(F.lit(float("inf")))
    bounds = looked.select("_pk", bound.alias("_bound"))
    known = homes.join(bounds, "_pk")
    reach = known.select("_pk", "_px", "_bound", F.explode(reached(F.col("_px"), F.col("_part"), F.col("_bound"), index.pivots, index.farthest)).alias("v"))
    slack = F.col("_bound") + SLACK * (1 + F.col("_away"))
    others = (
        reach.select("_pk", "_px", "_bound", F.col("v.part").alias("_part"), F.col("v.distance").alias("_away"))
        .join(index.rings, "_part").where((F.col("_away") - F.col("high") <= slack) & (F.col("low") - F.col("_away") <= slack))
        .select("_part", "_ring", "_pk", "_px").join(first.select("_part", "_ring", "_pk"), ["_part", "_ring", "_pk"], "left_anti")
    )
    rest = stored(others, "visits")
    found = stored(merged(looked.unionByName(visited(index, rest, k)), k).withColumnRenamed("_pk", key), "neighbours")
    index.discard()
    discard(homes, first, looked, rest)
    return found


def first_rings(index: Index, homes: DataFrame) -> DataFrame:
    """(_part, _ring, _pk, _px): for each probe a ring of its partition about as far from the pivot as it is itself.

    A partition always has rows: its pivot is one of them. Of its rings at most
    ``MARKS`` are told to the probes; whichever a probe takes, its bound is exact.
    """
    stride = F.ceil(F.count("*").over(Window.partitionBy("_part")) / MARKS)
    marks = index.rings.withColumn("_stride", stride).where(F.col("_ring") % F.col("_stride") == 0)
    starts = marks.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct(F.col("low").alias("low"), "_ring"))).alias("_starts"))
    joined = homes.join(starts, "_part")
    last = F.aggregate("_starts", F.lit(0), lambda at, s: F.when(s["low"] <= F.col("_d"), s["_ring"]).otherwise(at))
    return stored(joined.select("_part", last.cast("int").alias("_ring"), "_pk", "_px"), "home-rings")


def nearest_distance(points: DataFrame, probes: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, distance, nearest): how far each probe is from the nearest of the points, and which one it is."""
    near = F.get("near", F.lit(0))
    return neighbours(points, probes, vector, key, k=1).select(key, near["distance"].alias("distance"), near["key"].alias("nearest"))
