"""Visits: runs of a key's rows with no gap between them, and what only their order tells.

A session window knows how many rows a visit has; its first and last kind and how
often the kind changes need the rows in order. On a stream rows come out of order, so
each key holds its rows until the watermark has passed their visit's end
(``transformWithState``: a list and a timer for each key). The batch form, which the
stream must come to, works on ranges of a global order, so that a key may hold most rows.

* A row ``gap`` or more after the one before it starts a new visit.
* Rows of the same time are read in the order of their kinds; a null kind is a kind.
* Rows without a time are in no visit; null values add nothing; a null key is a key.
* On a stream, a row at or before the watermark is late and left out, and a visit is
  told once, when the watermark reaches its last time plus ``gap``: nothing that comes
  later can belong to it. What is held for a key are the rows of its open visits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quern.operators.ordering import in_ranges
from quern.sources.stored import stored

MICROS = 1_000_000
NAMES = ["_start", "_end", "n", "total", "first", "last", "switches"]
TOLD = "_start long, _end long, n long, total double, first string, last string, switches long"
HELD = "at long, kind string, amount double"


def prepared(df: DataFrame, time: str, keys: list[str], kind: str, value: str, late: str) -> DataFrame:
    at = F.col(time).cast("timestamp")
    rows = df.select(*keys, at.alias("_time"), F.unix_micros(at).alias("_at"), F.col(kind).cast("string").alias("_kind"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_amount")).where("_at IS NOT NULL")
    return rows.withWatermark("_time", late) if df.isStreaming else rows


def told(found: DataFrame, keys: list[str]) -> DataFrame:
    return found.select(*keys, F.timestamp_micros("_start").alias("start"), F.timestamp_micros("_end").alias("end"), "n", "total", "first", "last", "switches")


def visits(df: DataFrame, time: str, keys: list[str], kind: str, value: str, gap: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, total, first, last, switches) of each visit; gap in seconds, end is the last row's time.

    A stream needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)
    and append mode.
    """
    rows, width = prepared(df, time, keys, kind, value, late), round(gap * MICROS)
    if width <= 0:
        raise ValueError("a gap must be longer than nothing")
    if not df.isStreaming:
        return told(batch_visits(rows, keys, width), keys)
    # A key goes to Python and back as text, in which nulls and long numbers stay what they are; names there may not begin with a line.
    words = [f"k{i}" for i in range(len(keys))]
    keyed = rows.select(F.to_json(F.struct(*[F.col(k).cast("string").alias(w) for k, w in zip(keys, words, strict=True)])).alias("key"), "_time", F.col("_at").alias("at"), F.col("_kind").alias("kind"), F.col("_amount").alias("amount"))
    found = keyed.withColumnRenamed("_time", "time").groupBy("key").transformWithStateInPandas(OpenVisits(width), f"key string, {TOLD}", "append", "eventTime")
    read = F.from_json("key", ", ".join(f"{w} string" for w in words))
    return told(found.select(*[read[w].cast(rows.schema[k].dataType).alias(k) for k, w in zip(keys, words, strict=True)], *NAMES), keys)


def batch_visits(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Stretches of visits within each range, then those at the ranges' ends put together."""
    ordered = in_ranges(rows, [*keys, "_at", F.coalesce(F.concat(F.lit("1"), "_kind"), F.lit("0"))])
    within = Window.partitionBy("_p").orderBy("_i")
    stretch = F.sum(F.col("_new").cast("long")).over(within.rowsBetween(Window.unboundedPreceding, 0))
    before = F.struct(*keys, "_at", "_kind")
    marked = ordered.withColumn("_before", F.lag(before).over(within)).withColumn("_new", breaks(keys, width, F.col("_at")))
    marked = marked.withColumn("_switch", F.when(~F.col("_new"), ~F.col("_kind").eqNullSafe(F.col("_before._kind"))).otherwise(False)).withColumn("_s", stretch)
    place = F.col("_i")
    stretches = stored(marked.groupBy("_p", "_s", *keys).agg(
        F.min("_at").alias("_start"), F.max("_at").alias("_end"), F.count("*").alias("n"), F.sum("_amount").alias("total"),
        F.min_by(F.struct("_kind"), place)["_kind"].alias("first"), F.max_by(F.struct("_kind"), place)["_kind"].alias("last"), F.count_if("_switch").alias("switches"),
    ), "stretches")
    last = stretches.groupBy(F.col("_p").alias("_q")).agg(F.max("_s").alias("_most"))  # a row for each range
    sided = stretches.join(F.broadcast(last), F.col("_p") == F.col("_q"))
    at_end = (F.col("_s") == 1) | (F.col("_s") == F.col("_most"))
    line = Window.orderBy("_p", "_s")  # two rows at most for each range
    ends = sided.where(at_end).withColumn("_before", F.lag(F.struct(*keys, F.col("_end").alias("_at"), F.col("last").alias("_kind"))).over(line))
    ends = ends.withColumn("_new", breaks(keys, width, F.col("_start"))).withColumn("_visit", F.sum(F.col("_new").cast("long")).over(line))
    order = F.struct("_p", "_s")
    joins = F.count_if(~F.col("_new") & ~F.col("first").eqNullSafe(F.col("_before._kind")))
    whole = ends.groupBy("_visit", *keys).agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.min_by(F.struct("first"), order)["first"].alias("first"), F.max_by(F.struct("last"), order)["last"].alias("last"), (F.sum("switches") + joins).alias("switches"),
    )
    return whole.drop("_visit").unionByName(sided.where(~at_end).select(*whole.drop("_visit").columns))


def breaks(keys: list[str], width: int, at: Column) -> Column:
    """Whether a row doesn't go on with the visit of the row in ``_before``."""
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_before.{k}"))
    return F.col("_before").isNull() | ~same | (at - F.col("_before._at") >= width)


def split_visits(rows: list[tuple], width: int) -> list[list[tuple]]:
    """(time, kind, amount) rows of one key, in order, cut where the gap is."""
    found: list[list[tuple]] = []
    for row in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "")):
        if found and row[0] - found[-1][-1][0] < width:
            found[-1].append(row)
        else:
            found.append([row])
    return found


class OpenVisits(StatefulProcessor):
    """The rows of each key's open visits, and a timer at the earliest end that may come."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def wake(self, last: int) -> None:
        self.handle.registerTimer(-(-(last + self.width) // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = None
        for frame in rows:
            came = [(int(t), None if pd.isna(k) else str(k), float(a)) for t, k, a in zip(frame["at"], frame["kind"], frame["amount"], strict=True) if t > mark]
            if came:
                self.held.appendList(came)
                first = split_visits(came, self.width)[0][-1][0]
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.wake(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        found = split_visits([tuple(r) for r in self.held.get()], self.width)
        done = [v for v in found if v[-1][0] + self.width <= mark]
        rest = found[len(done) :]
        if not done and rest:
            self.wake(rest[0][-1][0])
            return
        if rest:
            self.held.put([row for v in rest for row in v])
            self.wake(rest[0][-1][0])
        else:
            self.held.clear()
        if done:
            yield pd.DataFrame([(*key, *self.summary(v)) for v in done], columns=["key", *NAMES])

    @staticmethod
    def summary(visit: list[tuple]) -> tuple:
        kinds = [k for _, k, _ in visit]
        return visit[0][0], visit[-1][0], len(visit), sum(a for _, _, a in visit), kinds[0], kinds[-1], sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
