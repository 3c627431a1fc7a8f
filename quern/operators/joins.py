"""Joins that SQL has no word for: first match with an audit, as-of, by position, on ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators.ordering import last_seen, numbered

#: Rows of one value that meet others as one, about.
BLOCK = 1024
#: Tasks for each core that tell the rows of blocks that meet: even shares, and loops that end before they are stale.
TELLERS = 16


def key_of(df: DataFrame, key: str) -> Column:
    """A join key: trimmed, case kept, null where missing."""
    return cells.text(df, key)


def free_names(taken: list[str], wanted: list[str]) -> list[str]:
    """``wanted`` with _2, _3 ... where a name is taken."""
    used, out = set(taken), []
    for name in wanted:
        n, i = name, 2
        while n in used:
            n, i = f"{name}_{i}", i + 1
        used.add(n)
        out.append(n)
    return out


def first_of_each(right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``; missing keys are left out."""
    rest = [c for c in right.columns if c != key]
    picked = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order))
    return right.withColumn("_key", key_of(right, key)).where("_key IS NOT NULL").groupBy("_key").agg(picked.alias("_row"))


def left_join_first(left: DataFrame, right: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Every left row once, with the columns of the first right row of its key.

    The right side is reduced to one row a key by a partial aggregate before it
    meets the left; missing keys never match; added names get a suffix where the
    left has them.
    """
    rest = [c for c in right.columns if c != key]
    names = free_names(left.columns, rest)
    build = first_of_each(right, key, order).select(F.col("_key").alias("_rk"), *[F.col("_row")[c].alias(n) for c, n in zip(rest, names, strict=True)])
    return left.withColumn("_lk", key_of(left, key)).join(build, F.col("_lk") == F.col("_rk"), "left").select(*left.columns, *names)


def join_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: matched and orphan left rows, the 6 smallest orphan keys, duplicate and unused right keys."""
    l_keys = left.select(key_of(left, key).alias("k")).groupBy("k").agg(F.count("*").alias("l_rows"))
    r_keys = right.select(key_of(right, key).alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("r_rows"))
    both = l_keys.join(r_keys, "k", "full")
    hit = F.col("l_rows").isNotNull() & F.col("r_rows").isNotNull()
    rows = F.coalesce("l_rows", F.lit(0))
    stats = both.agg(
        F.sum(F.when(hit, rows).otherwise(0)).alias("matched"),
        F.sum(F.when(~hit, rows).otherwise(0)).alias("orphans"),
        F.coalesce(F.sum(F.when(F.col("r_rows") > 1, F.col("r_rows") - 1)), F.lit(0)).alias("duplicate_keys"),
        F.count_if(F.col("r_rows").isNotNull() & F.col("l_rows").isNull()).alias("unused_right"),
    )
    smallest = both.where("l_rows IS NOT NULL AND r_rows IS NULL AND k IS NOT NULL").select("k").orderBy("k").limit(6).agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("orphan_keys"))
    return stats.crossJoin(F.broadcast(smallest))  # one row and one row


def asof_join(left: DataFrame, right: DataFrame, on: str, left_time: str, right_time: str, take: list[str], tie: str) -> DataFrame:
    """Each left row with ``take`` of the last right row of its key at or before its time.

    Both sides are laid on one time line per key and a running last value walks
    over it, in slices of time where a key is hot: no range join. ``tie`` orders
    right rows of one time.
    """
    cols = [F.col(c) for c in left.columns]
    l_side = left.select(F.col(on).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*cols).alias("_l"))
    r_row = F.struct(*[F.col(c) for c in take])
    r_side = right.select(F.col(on).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), r_row.alias("_r"))
    line = l_side.unionByName(r_side, allowMissingColumns=True)
    found = last_seen(line, "_k", "_t", ["_t", "_side", "_tie"], "_r").where("_side = 1")
    return found.select("_l.*", *[F.col("_r")[c].alias(c) for c in take])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges [low, high) that hold them: an equality join on bins of ``width``, then the exact test.

    Rows of one value, or of one pair of bounds, meet as blocks of at most ``BLOCK``
    rows: blocks are tested, those that meet are dealt evenly to tasks, and only there
    does what is told become rows. The result may be quadratic; nothing before it is.
    """
    p = in_blocks(points, [point], "_p").withColumn("_bin", F.floor(F.col(point) / width))
    r = in_blocks(ranges, [low, high], "_r").withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    met = p.join(r, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    tasks = TELLERS * points.sparkSession.sparkContext.defaultParallelism
    dealt = met.select(point, low, high, "_p", "_r").repartition(tasks)
    # coalesce moves nothing: it ends the compiled loop, which would hold all rows of two blocks (a million) before it hands on the first
    one = dealt.select(point, low, high, "_r", F.explode("_p").alias("_one")).coalesce(tasks)
    both = one.select(point, low, high, "_one", F.explode("_r").alias("_other"))
    told = {c: F.col(c) if c == point else F.col("_one") if len(points.columns) == 2 else F.col("_one")[c] for c in points.columns}
    told |= {c: F.col(c) if c in (low, high) else F.col("_other") if len(ranges.columns) == 3 else F.col("_other")[c] for c in ranges.columns}
    return both.select(*[x.alias(c) for c, x in told.items()])


def in_blocks(df: DataFrame, same: list[str], name: str) -> DataFrame:
    """(same..., <name>): the rest of the rows of each value of ``same``, as arrays of ``BLOCK`` or so; rows without a value are left out.

    Elements are structs, or where one column is left its values, nulls too, at a third of the size.
    """
    rest = [c for c in df.columns if c not in same]
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in same))
    sizes = known.groupBy(*[F.col(c).alias(f"_{c}") for c in same]).agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    dealt = known.join(sizes, [F.col(c) == F.col(f"_{c}") for c in same]).withColumn("_block", F.pmod(F.xxhash64(*df.columns), F.col("_blocks")))
    rows = F.collect_list(F.struct(*[F.col(c) for c in rest] or [F.lit(0).alias("_")]))  # structs at first: a list of values drops nulls
    return dealt.groupBy(*same, "_block").agg((rows[rest[0]] if len(rest) == 1 else rows).alias(name)).drop("_block")


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows side by side by their number in the given orders; the shorter side is filled with nulls.

    Numbers come from counts per sorted range, not from one window.
    """
    return numbered(left, left_order, "_n").join(numbered(right, right_order, "_n"), "_n", "full").drop("_n")
