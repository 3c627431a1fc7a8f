"""Row numbers, running sums and ranks over orders that no single task can hold.

A window without a partition puts all rows into one task. Here rows are dealt
into ranges (or, for a random order, by the first digits of their hash); numbers
and sums are taken within each part, and what the parts before it hold is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.stored import stored

_WITHIN = (1 << 33) - 1  # where a generated id counts rows of a partition
PREFIX = 3  # hexadecimal digits of a hash: 4096 parts of each class


def in_ranges(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """Rows in a global order with ``_p`` (range) and ``_i`` (place in it).

    Stored: ranges are drawn from a sample, so that another run, or the same
    plan with other columns, could deal rows otherwise.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ordered.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN)).alias("_i")), "in-ranges")


def before_each(parts: DataFrame, sums: list[str]) -> DataFrame:
    """(_p, <sum>...) with what all parts before it add up to; one row for each partition."""
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("_p").alias("_q"), *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in sums])


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_number") -> DataFrame:
    """Rows numbered from 0 in a global order."""
    ordered = in_ranges(df, order)
    counts = before_each(ordered.groupBy("_p").agg(F.count("*").alias("n")), ["n"])
    joined = ordered.join(F.broadcast(counts), F.col("_p") == F.col("_q"))  # a row for each partition
    return joined.withColumn(name, F.col("_before_n") + F.col("_i")).select(*df.columns, name)


def running(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """The rows with running sums up to and including each, in a global order. sums: new name -> column."""
    ordered = in_ranges(df, order)
    w = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    within = ordered.withColumns({name: F.sum(c).over(w) for name, c in sums.items()})
    totals = before_each(ordered.groupBy("_p").agg(*[F.sum(c).alias(name) for name, c in sums.items()]), list(sums))
    joined = within.join(F.broadcast(totals), F.col("_p") == F.col("_q"))  # a row for each partition
    return joined.select(*df.columns, *[(F.col(name) + F.col(f"_before_{name}")).alias(name) for name in sums])


def shifted(df: DataFrame, order: list[str | Column], value: str, by: int, name: str) -> DataFrame:
    """The rows with ``value`` of the row ``by`` places before each, null for the first ones."""
    rows = stored(numbered(df, order, "_n"), "numbered")
    return rows.join(rows.select((F.col("_n") + by).alias("_n"), F.col(value).alias(name)), "_n", "left").select(*df.columns, name)


def ranked_within(df: DataFrame, by: str, digest: Column, key: str, name: str = "_rank") -> DataFrame:
    """Rows with their rank (from 1) by digest, then key, within each value of ``by``.

    A class may hold most rows: each part of it, by the digest's first digits, is
    ranked on its own, and the sizes of the parts before it are added.
    """
    marked = df.withColumns({"_digest": digest, "_part": F.substring(digest, 1, PREFIX)})
    sizes = marked.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_by", "_of", before.alias("_start"))
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy("_digest", key))
    ranked = marked.withColumn(name, within).join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_of")))
    return ranked.select(*df.columns, (F.col(name) + F.col("_start")).alias(name))


def last_seen(line: DataFrame, key: str, time: str, order: list[str], value: str, slices: int = 64) -> DataFrame:
    """The rows with ``value`` replaced by its last given value so far, per key in the given order (``time`` first).

    A hot key is cut into slices of time: the last value of every slice is taken
    first, carried over the slices of its key, and walked on with within each.
    """
    at = F.col(time).cast("timestamp") if dict(line.dtypes)[time] in ("date", "timestamp_ntz") else F.col(time)
    at = at.cast("double")
    low, high = line.agg(F.min(at), F.max(at)).first()
    width = ((high - low) / slices if low is not None else 0) or 1.0
    cut = line.withColumn("_slice", F.coalesce(F.floor((at - F.lit(low or 0.0)) / F.lit(width)), F.lit(-1)))
    place = F.struct(*order)
    ends = cut.groupBy(F.col(key).alias("_of"), F.col("_slice").alias("_s")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("_end"))
    earlier = Window.partitionBy("_of").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    carried = ends.select("_of", "_s", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    past = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_own", F.last(value, ignorenulls=True).over(past))
    joined = own.join(carried, F.col(key).eqNullSafe(F.col("_of")) & (F.col("_slice") == F.col("_s")))
    return joined.select(*[c for c in line.columns if c != value], F.coalesce("_own", "_carried").alias(value))


def all_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
