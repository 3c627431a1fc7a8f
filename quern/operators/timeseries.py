"""Series, gaps, one-step backtests, smoothing forecasters and the choice among them.

A forecaster's state is a vector, and a point moves it by one affine map, the same
for every point: state' = A state + b y. So what a range of points does is A to the
power of its length, and one vector, and ranges are put together without walking
through them again. Series lie side by side by key in blocks of at most ``BLOCK``
points; what a block holds of a series is a range. All ranges of a block are folded
in one call, short ones a point of each at a time; series that lie in one block are
done with that, of the others a row for each range is carried along the series, and
only then points are looked at whose forecasts are asked for. A long series is as
many blocks as it needs; thousands of short ones share a block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import in_ranges, running, shifted
from quern.sources.stored import discard, stored

# The grids, lengths and quantiles that forecasts are chosen and told by.
LEVELS = (0.2, 0.5, 0.8)
SEASONAL_LEVELS = (0.2, 0.5)
TRENDS = (0.05, 0.2)
SEASONS = (0.05, 0.2)
LEAST_POINTS = 12
LEAST_HELD, MOST_HELD, HELD_SHARE = 8, 60, 0.2
HORIZON, MOST_AHEAD = 12, 28
LOW, HIGH = 0.1, 0.9
#: Points of a block, and how many of a range are walked side by side with other ranges.
BLOCK, SHORT = 1 << 15, 256
#: (most days between points, name, points of a season)
FREQUENCIES = [(1.5, "daily", 7), (10, "weekly", None), (45, "monthly", 12), (135, "quarterly", 4), (550, "yearly", None)]


def build_series(df: DataFrame, time: str, value: str) -> DataFrame:
    """(t, y, n): the mean value at each time; rows without either are dropped."""
    return df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(time).alias("t")).agg(F.avg(value).alias("y"), F.count("*").alias("n"))


def dropped(df: DataFrame, time: str, value: str) -> DataFrame:
    return df.agg(F.count_if(F.col(time).isNull() | F.col(value).isNull()).alias("dropped"))


def seconds(t: Column) -> Column:
    return t.cast("timestamp").cast("double")


def frequency(series: DataFrame) -> DataFrame:
    """(seconds, frequency, period): the upper median of the gaps, its name and the points of a season."""
    times = shifted(series.select(seconds(F.col("t")).alias("at")), ["at"], "at", 1, "before")
    gaps = times.select((F.col("at") - F.col("before")).cast("long").alias("g")).where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("k"))
    total = gaps.agg(F.sum("k").alias("all"))
    middle = running(gaps, ["g"], {"upto": "k"}).crossJoin(F.broadcast(total)).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("g").alias("seconds"))  # total is one row
    return middle.select("seconds", named("frequency").alias("frequency"), named("period").alias("period"))


def named(what: str) -> Column:
    """The name or the season of the gap in the column ``seconds``."""
    found = F.lit("irregular" if what == "frequency" else None).cast("string" if what == "frequency" else "int")
    for days, name, period in reversed(FREQUENCIES):
        found = F.when(F.col("seconds") <= days * 86400, F.lit(name if what == "frequency" else period)).otherwise(found)
    return found


def backtest_lag(series: DataFrame, lag: int = 1) -> DataFrame:
    """(t, y, forecast, error): each point by the one ``lag`` before; the naive and seasonal naive forecasters."""
    found = shifted(series.select("t", "y"), ["t"], "y", lag, "forecast")
    return found.where("forecast IS NOT NULL").withColumn("error", F.abs(F.col("y") - F.col("forecast")))


@dataclass(frozen=True)
class Forecaster:
    """A method with its parameters: where it starts, how a point moves it, what it says of the points to come.

    The state is (level, trend, the parts of the season to come, the next point's
    first). Naive methods keep the last points as the season.
    """

    method: str
    params: dict[str, float]
    least: int
    first: int  # the first point that moves the state

    @property
    def name(self) -> str:
        return f"{self.method}({','.join(f'{k}={v:g}' for k, v in self.params.items())})"

    @property
    def season(self) -> int:
        return int(self.params.get("m", 1))

    @property
    def needed(self) -> int:
        """How many points the start is made of."""
        return {"naive": 1, "ses": 1, "holt": 2, "seasonalNaive": self.season}.get(self.method, 2 * self.season)

    @cached_property
    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """(A, b) of the map by which a point moves the state."""
        m = self.season
        a, b, g = (self.params.get(k, 0.0) for k in ("alpha", "beta", "gamma"))
        unit = np.eye(m + 2)
        rotated = np.roll(unit[2:], -1, axis=0)  # each part of the season moves up, the first to the end
        if self.method in ("naive", "seasonalNaive"):
            rotated[-1] = 0
            return np.vstack([unit[:2], rotated]), unit[-1]
        level, level_y = (1 - a) * (unit[0] + unit[1]) - a * unit[2], a
        trend, trend_y = (b * (level - unit[0]) + (1 - b) * unit[1], b * a) if b else (0 * unit[1], 0.0)
        if g:
            rotated[-1], season_y = -g * level + (1 - g) * unit[2], g - g * level_y
        else:
            rotated, season_y = unit[2:], 0.0
        return np.vstack([level, trend, rotated]), np.concatenate([[level_y, trend_y], np.zeros(m - 1), [season_y]])

    def start(self, head: np.ndarray) -> np.ndarray:
        """The state before point ``first``, from the series' first points."""
        m = self.season
        if self.method in ("naive", "seasonalNaive"):
            return np.concatenate([[0, 0], head[:m]])
        if self.method in ("ses", "holt"):
            return np.array([head[0], head[1] - head[0] if self.method == "holt" else 0.0, 0.0])
        one, two = head[:m].mean(), head[m : 2 * m].mean()
        return np.concatenate([[one, (two - one) / m], head[:m] - one])

    def ahead(self, h: int) -> np.ndarray:
        """What is said of the h-th point to come (from 0) is this, times the state."""
        told = np.zeros(self.season + 2)
        told[0], told[1], told[2 + h % self.season] = 1, h + 1, 1
        return told

    def states(self, ys: np.ndarray, start: np.ndarray) -> np.ndarray:
        """points x state: the state after each point. Blocks are walked side by side from zero, then put together."""
        a, b = self.step
        length = max(1, math.isqrt(len(ys)))
        blocks = len(ys) // length
        y = ys[: blocks * length].reshape(blocks, length)
        ends = np.zeros((blocks, len(b)))
        for i in range(length):
            ends = ends @ a.T + y[:, i, None] * b
        power = np.linalg.matrix_power(a, length)
        at = np.empty((blocks, len(b)))
        for k in range(blocks):
            at[k] = start
            start = power @ start + ends[k]
        out = np.empty((len(ys), len(b)))
        for i in range(length):
            at = at @ a.T + y[:, i, None] * b
            out[i : blocks * length : length] = at
        for i in range(blocks * length, len(ys)):
            start = out[i] = a @ start + b * ys[i]
        return out

    def end(self, ys: np.ndarray) -> np.ndarray:
        """Where the points lead from zero."""
        return self.states(ys, np.zeros(self.season + 2))[-1] if len(ys) else np.zeros(self.season + 2)

    def ends(self, ys: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """ranges x state: where each range of the points leads from zero; short ones are walked side by side."""
        a, b = self.step
        out = np.zeros((len(starts), len(b)))
        sizes = stops - starts
        for i in np.flatnonzero(sizes > SHORT):
            out[i] = self.end(ys[starts[i] : stops[i]])
        short = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
        short = short[np.argsort(-sizes[short], kind="stable")]
        left = len(short)
        for j in range(sizes[short[0]] if left else 0):
            while sizes[short[left - 1]] <= j:
                left -= 1
            some = short[:left]
            out[some] = out[some] @ a.T + ys[starts[some] + j, None] * b
        return out

    def over_each(self, starts: np.ndarray, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """``over`` for many ranges."""
        out = np.empty_like(ends)
        for n in np.unique(points):
            out[points == n] = starts[points == n] @ np.linalg.matrix_power(self.step[0], int(n)).T + ends[points == n]
        return out

    def over(self, start: np.ndarray, points: int, end: np.ndarray) -> np.ndarray:
        """Where as many points lead from a state, if they lead to ``end`` from zero."""
        return np.linalg.matrix_power(self.step[0], points) @ start + end


def forecasters(period: int | None) -> list[Forecaster]:
    found = [Forecaster("naive", {}, 1, 1)]
    found += [Forecaster("ses", {"alpha": a}, 2, 1) for a in LEVELS]
    found += [Forecaster("holt", {"alpha": a, "beta": b}, 3, 1) for a, b in product(LEVELS, TRENDS)]
    if period:
        found.append(Forecaster("seasonalNaive", {"m": period}, period + 1, period))
        found += [Forecaster("holtWinters", {"alpha": a, "beta": b, "gamma": g, "m": period}, 2 * period + 1, 0) for a, b, g in product(SEASONAL_LEVELS, TRENDS, SEASONS)]
    return found


def ses(alpha: float) -> Forecaster:
    return Forecaster("ses", {"alpha": alpha}, 2, 1)


def holt(alpha: float, beta: float) -> Forecaster:
    """Double smoothing; the first trend is the first step."""
    return Forecaster("holt", {"alpha": alpha, "beta": beta}, 3, 1)


def holt_winters(alpha: float, beta: float, gamma: float, m: int) -> Forecaster:
    """Additive, started from the first two seasons and run over all points."""
    return Forecaster("holtWinters", {"alpha": alpha, "beta": beta, "gamma": gamma, "m": m}, 2 * m + 1, 0)


STATES = pa.list_(pa.list_(pa.float64()))
#: A range: its block, its points, its first place in the block's order, the points before it and all of its series.
NAMES = ["_p", "n", "first", "before", "total"]
PLACED = ", ".join(f"{c} long" for c in NAMES)
STATED = f"{PLACED}, states array<array<double>>"


def lists(rows: np.ndarray, known: np.ndarray) -> pa.Array:
    """Rows of numbers as lists, null where they aren't known."""
    places = np.arange(len(rows) + 1) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(rows.ravel()), mask=pa.array(~known))


def beside(columns: list[pa.Array], n: int) -> pa.Array:
    """Lists that hold the n rows' values of several columns side by side."""
    order = np.arange(n * len(columns)).reshape(len(columns), n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(columns), pa.int32()), pa.concat_arrays(columns).take(pa.array(order)))


class Scan:
    """Series by key, cut into ranges, with the states of forecasters at every range's start.

    ``series``: (by..., t, y), one row for each time of a series. Two passes over
    the points; between them a row for each range is carried along its series.
    Rows are grouped by block, never by series, so that a call has work for many.
    """

    def __init__(self, series: DataFrame, models: list[Forecaster], by: list[str] | None = None):
        self.models = models
        self.given, self.by = list(by or []), list(by or ["_all"])
        rows = (series if by else series.withColumn("_all", F.lit(0))).select(*self.by, "t", F.col("y").cast("double").alias("y"))
        self.ordered = in_ranges(rows, [*self.by, "t"])
        block = F.shiftleft(F.col("_p").cast("long"), 32) + F.floor(F.col("_i") / BLOCK)  # in the order of the rows
        self.rows = self.ordered.withColumn("_p", block)
        self.key = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*self.by).schema)
        self.parts = stored(self._parts(), "series-parts")
        folded = stored(self._folded(), "series-folded")
        cut = folded.where("n < total").drop("states").groupBy(*self.by).applyInArrow(self._carry, f"{self.key}, {STATED}")
        self.states = stored(folded.where("n = total").select(*self.by, *NAMES, "states").unionByName(cut), "series-states")
        discard(folded)

    def _parts(self) -> DataFrame:
        """(by, _p, n, first, before, total): the ranges of each series, where they begin in their block's order and where in their series."""
        parts = self.rows.groupBy(*self.by, "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
        series = Window.partitionBy(*self.by)  # a row for each range
        before = F.coalesce(F.sum("n").over(series.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return parts.select(*self.by, "_p", "n", "first", before.alias("before"), F.sum("n").over(series).alias("total"))

    def _with_parts(self, rows: DataFrame, others: DataFrame, fold, schema: str) -> DataFrame:
        """``fold`` of each block: its rows in order, its ranges in order, and where each range starts and stops among the rows."""

        def ordered(rows: pa.Table, parts: pa.Table) -> pa.Table:
            rows, parts = rows.sort_by("_i"), parts.sort_by("first")
            starts = np.searchsorted(rows["_i"].to_numpy(), parts["first"].to_numpy())
            return fold(rows, parts, starts, starts + parts["n"].to_numpy())

        return rows.groupBy("_p").cogroup(others.groupBy("_p")).applyInArrow(ordered, schema)

    def _folded(self) -> DataFrame:
        """(by, _p, n, first, before, total, head, ends, states): where each range leads every forecaster from zero, and the points that starts are made of.

        A series of one range has its states instead: a row at its start, and one at _p = -1 after the last point.
        """
        models, most, by = self.models, max(f.needed for f in self.models), self.by

        def fold(rows: pa.Table, parts: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.Table:
            ys, n, before = rows["y"].to_numpy(), parts["n"].to_numpy(), parts["before"].to_numpy()
            skips = [np.minimum(n, np.maximum(0, f.first - before)) for f in models]
            ends = [f.ends(ys, starts + skip, stops) for f, skip in zip(models, skips, strict=True)]
            whole, cut = np.flatnonzero(n == parts["total"].to_numpy()), np.flatnonzero(n != parts["total"].to_numpy())
            at, last = [], []
            for f, skip, end in zip(models, skips, ends, strict=True):
                fits = n[whole] >= f.needed
                begun = np.full((len(whole), end.shape[1]), np.nan)
                for k in np.flatnonzero(fits):
                    begun[k] = f.start(ys[starts[whole[k]] : starts[whole[k]] + f.needed])
                done = np.full_like(begun, np.nan)
                done[fits] = f.over_each(begun[fits], (n - skip)[whole][fits], end[whole][fits])
                at.append(lists(begun, fits))
                last.append(lists(done, fits))
            heads = [ys[starts[i] : starts[i] + min(n[i], max(0, most - before[i]))] for i in cut]
            out = parts.take(pa.array(np.concatenate([cut, whole, whole])))
            places = np.concatenate([parts["_p"].to_numpy()[np.concatenate([cut, whole])], np.full(len(whole), -1)])
            told = {c: out[c] for c in by} | {"_p": pa.array(places, pa.int64())} | {c: out[c] for c in NAMES[1:]}
            empty = [None] * 2 * len(whole)
            told["head"] = pa.array([*heads, *empty], pa.list_(pa.float64()))
            told["ends"] = pa.array([*([e[i].tolist() for e in ends] for i in cut), *empty], STATES)
            told["states"] = pa.chunked_array([pa.array([None] * len(cut), STATES), beside(at, len(whole)), beside(last, len(whole))])
            return pa.table(told)

        return self._with_parts(self.rows, self.parts, fold, f"{self.key}, {PLACED}, head array<double>, ends array<array<double>>, states array<array<double>>")

    @property
    def _carry(self):
        """Each forecaster's state where a range of a series starts, and at _p = -1 after the last point; null where the series is too short."""
        models, by = self.models, self.by

        def carry(ranges: pa.Table) -> pa.Table:
            ranges = ranges.sort_by("_p")
            head = np.array([y for ys in ranges["head"].to_pylist() for y in ys])
            at = [f.start(head) if len(head) >= f.needed else None for f in models]
            told = []
            for n, before, ends in zip(ranges["n"].to_pylist(), ranges["before"].to_pylist(), ranges["ends"].to_pylist(), strict=True):
                told.append([None if s is None else s.tolist() for s in at])
                at = [None if s is None else f.over(s, max(0, before + n - max(f.first, before)), np.array(end)) for f, s, end in zip(models, at, ends, strict=True)]
            told.append([None if s is None else s.tolist() for s in at])
            out = ranges.take([*range(ranges.num_rows), ranges.num_rows - 1])
            places = pa.array([*ranges["_p"].to_pylist(), -1], pa.int64())
            return pa.table({c: out[c] for c in by} | {"_p": places} | {c: out[c] for c in NAMES[1:]} | {"states": pa.array(told, STATES)})

        return carry

    def last_states(self) -> DataFrame:
        """(by, total, place, level, trend, season): the state of each forecaster after the last point."""
        ended = self.states.where("_p = -1").select(*self.given, "total", F.posexplode("states").alias("place", "s")).where("s IS NOT NULL")
        return ended.select(*self.given, "total", "place", F.get("s", F.lit(0)).alias("level"), F.get("s", F.lit(1)).alias("trend"), F.expr("slice(s, 3, size(s))").alias("season"))

    def every_state(self) -> DataFrame:
        """(by, t, pos, y, level, trend, forecast): the first forecaster after each point, and what it had said of it; from its start on."""
        model, by = self.models[0], self.by

        def walk(rows: pa.Table, parts: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.Table:
            ys, used, found = rows["y"].to_numpy(), [], []
            for start, stop, before, state in zip(starts, stops, parts["before"].to_pylist(), parts["states"].to_pylist(), strict=True):
                if state[0] is None:
                    continue
                n, skip = stop - start, min(stop - start, max(0, model.first - before))
                states = np.tile(np.array(state[0]), (n, 1))
                states[skip:] = model.states(ys[start + skip : stop], states[0])
                forecast = np.vstack([[state[0]], states[:-1]]) @ model.ahead(0)
                forecast[:skip] = np.nan
                used.append(np.arange(start, stop))
                found.append(np.column_stack([before + np.arange(n), states[:, :2], forecast]))
            told = rows.take(pa.array(np.concatenate(used or [[]]), pa.int64()))
            pos, level, trend, forecast = np.concatenate(found or [np.zeros((0, 4))]).T
            values = {"pos": pa.array(pos.astype(np.int64)), "y": told["y"], "level": pa.array(level), "trend": pa.array(trend), "forecast": pa.array(forecast, mask=np.isnan(forecast) & (pos < model.first))}
            return pa.table({c: told[c] for c in [*by, "t"]} | values)

        kind = self.rows.schema["t"].dataType.simpleString()
        told = self._with_parts(self.rows, self.states.where("_p >= 0"), walk, f"{self.key}, t {kind}, pos long, y double, level double, trend double, forecast double")
        return told.select(*self.given, "t", "pos", "y", "level", "trend", "forecast")

    def held_errors(self) -> DataFrame:
        """(by, total, place, errors): the errors of one-step forecasts of the held-out points, in order; only ranges that hold some are read again."""
        models, by = self.models, self.by
        held = self.states.where("_p >= 0").withColumn("start", F.col("total") - held_points(F.col("total"))).where(F.col("before") + F.col("n") > F.col("start"))

        def walk(rows: pa.Table, parts: pa.Table, starts: np.ndarray, stops: np.ndarray) -> pa.Table:
            ys, used, places, found = rows["y"].to_numpy(), [], [], []
            for i, (a, b, before, start, given) in enumerate(zip(starts, stops, *(parts[c].to_pylist() for c in ("before", "start", "states")), strict=True)):
                for place, (f, state) in enumerate(zip(models, given, strict=True)):
                    if state is None:
                        continue
                    skip = max(0, f.first - before)
                    states = np.vstack([[state], f.states(ys[a + skip : b], np.array(state))])[:-1]
                    first = max(0, start - before - skip)
                    used.append(i)
                    places.append(place)
                    found.append((ys[a + skip + first : b] - (states @ f.ahead(0))[first:]).tolist())
            out = parts.take(pa.array(used, pa.int64()))
            return pa.table({c: out[c] for c in [*by, "_p", "total"]} | {"place": pa.array(places, pa.int32()), "errors": pa.array(found, pa.list_(pa.float64()))})

        told = self._with_parts(self.rows.join(held.select("_p").distinct(), "_p", "left_semi"), held, walk, f"{self.key}, _p long, total long, place int, errors array<double>")
        whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "errors"))), lambda e: e["errors"]))  # MOST_HELD of them at most
        return told.groupBy(*self.by, "total", "place").agg(whole.alias("errors")).select(*self.given, "total", "place", "errors")

    def discard(self) -> None:
        discard(self.ordered, self.parts, self.states)


def held_points(n: Column) -> Column:
    """The last fifth, 8 at least and 60 at most."""
    return F.greatest(F.lit(LEAST_HELD), F.least(F.lit(MOST_HELD), F.floor(n * HELD_SHARE)))


def backtests(series: DataFrame, period: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, place, method, model, mae, rmse, errors) of every forecaster that the series is long enough for, in their order.

    The held-out points are the last fifth, 8 at least and 60 at most, each
    forecast from all before it. A stored table.
    """
    scan = Scan(series, forecasters(period), by)
    found = stored(graded(scan), "backtests")
    scan.discard()
    return found


def graded(scan: Scan) -> DataFrame:
    n, held = F.col("total"), held_points(F.col("total"))
    least, method, name = (F.get(F.array(*[F.lit(v) for v in values]), F.col("place")) for values in zip(*[(f.least, f.method, f.name) for f in scan.models], strict=True))
    fits = (n >= LEAST_POINTS) & (least <= F.floor(n * (1 - HELD_SHARE))) & (n - held >= least)
    total = lambda e: F.aggregate("errors", F.lit(0.0), lambda s, x: s + e(x)) / F.size("errors")
    told = scan.held_errors().where(fits)
    return told.select(*scan.given, "place", method.alias("method"), name.alias("model"), total(F.abs).alias("mae"), F.sqrt(total(lambda x: x * x)).alias("rmse"), "errors")


def compare_forecasters(series: DataFrame, period: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, method, model, mae, rmse): the best of each method, the best first; ties to the earlier in the grid."""
    order = F.struct("mae", "place")
    best = backtests(series, period, by).groupBy(*(by or []), "method").agg(F.min_by(F.struct("model", "mae", "rmse", "place"), order).alias("b"))
    return best.select(*(by or []), "method", "b.model", "b.mae", "b.rmse", "b.place").orderBy(*(by or []), "mae", "place").drop("place")


def forecast(series: DataFrame) -> DataFrame:
    """(t, model, forecast, low, high) of the points to come, by the forecaster with the least error on held-out points.

    The season is what the gaps between points say, if there are two of it and
    four points more.
    """
    gap = frequency(series).first()
    n = series.count()
    if gap["seconds"] is None:
        return series.sparkSession.createDataFrame([], "t timestamp, model string, forecast double, low double, high double")
    period = gap["period"] if gap["period"] and n >= 2 * gap["period"] + 4 else None
    return forecast_each(series, gap["seconds"], period)


def forecast_each(series: DataFrame, gap: int, period: int | None, by: list[str] | None = None) -> DataFrame:
    """(by, t, model, forecast, low, high) of the points to come of each series, whose points are ``gap`` seconds apart.

    Each series has the forecaster with the least error on its held-out points.
    The band is what 80 % of the held-out errors lie in. Two seasons ahead, or 12
    points, 28 at most and half of the series at most; no rows for a series of
    fewer than 12 points. Times are timestamps.
    """
    keys = list(by or [])
    models = forecasters(period)
    scan = Scan(series, models, by)
    best = graded(scan).groupBy(*keys).agg(F.min_by(F.struct("place", "model", F.array_sort("errors").alias("errors")), F.struct("mae", "place")).alias("b"))
    ends = scan.rows.groupBy(*scan.by).agg(F.max(seconds(F.col("t"))).alias("end")).select(*keys, "end")
    last = scan.last_states()
    chosen = best.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], "b.*")
    same = lambda other: [other[c].eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    joined = last.join(chosen.withColumnRenamed("place", "_best"), [F.col("place") == F.col("_best"), *same(last)])
    ends = ends.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(keys)], "end")
    joined = joined.join(ends, [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(keys)]) if keys else joined.crossJoin(F.broadcast(ends))  # one row
    steps = F.least(F.lit(min(2 * period if period else HORIZON, MOST_AHEAD)), F.floor(F.col("total") / 2)).cast("int")
    at = lambda q: F.get("errors", F.least(F.size("errors") - 1, F.floor(F.lit(q) * F.size("errors")).cast("int")))
    each = joined.select(*keys, "model", "level", "trend", "season", "end", at(LOW).alias("low"), at(HIGH).alias("high"), F.explode(F.sequence(F.lit(0), steps - 1)).alias("i"))
    told = F.col("level") + (F.col("i") + 1) * F.col("trend") + F.get("season", F.col("i") % F.size("season"))
    rounded = lambda x: F.floor(x * 1000 + 0.5) / 1000
    time = F.timestamp_seconds(F.col("end") + (F.col("i") + 1) * gap)
    found = stored(each.select(*keys, time.alias("t"), "model", rounded(told).alias("forecast"), rounded(told + F.col("low")).alias("low"), rounded(told + F.col("high")).alias("high")), "forecast")
    scan.discard()
    return found
