"""Counterfactuals against every change of the full grid."""

import json
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import counterfactual

COLUMNS = ["x", "y", "g"]


def score(x, y, g):
    return x + 2 * y + (5 if g == "b" else 0)


PREDICT = "x + 2 * y + CASE WHEN g = 'b' THEN 5.0D ELSE 0.0D END"


@pytest.fixture(scope="module")
def people():
    rng = np.random.default_rng(9)
    return [(i, float(rng.integers(0, 9)), float(rng.integers(0, 6)), "abc"[rng.integers(0, 3)]) for i in range(120)]


def brute(people, limit):
    """Every single and paired change, scored one by one."""
    values = {c: sorted({p[i + 1] for p in people}) for i, c in enumerate(COLUMNS)}
    counts = {v: sum(p[3] == v for p in people) for v in values["g"]}
    values["g"] = sorted(counts, key=lambda v: (-counts[v], v))
    spread = {c: max(values[c]) - min(values[c]) for c in "xy"}
    vector = lambda r: np.array([r[0] / spread["x"], r[1] / spread["y"], *[float(r[2] == v) for v in values["g"]]])
    cloud = np.array([vector(p[1:]) for p in people])
    own = [np.sort(np.sqrt(((cloud - v) ** 2).sum(1)))[1] for v in cloud]
    farthest = np.quantile(own, 0.95)
    out = {}
    for key, *row in people:
        if score(*row) > limit:
            continue
        found = {}
        for some in [(c,) for c in COLUMNS] + list(combinations(COLUMNS, 2)):
            grids = [counterfactual.thin(values[c], 40 if len(some) == 1 else 10) for c in some]
            for to in ([(v,) for v in grids[0]] if len(some) == 1 else [(v, w) for v in grids[0] for w in grids[1]]):
                new = [to[some.index(c)] if c in some else old for c, old in zip(COLUMNS, row, strict=True)]
                steps = [float(n != o) if c == "g" else abs(n - o) / spread[c] for c, n, o in zip(COLUMNS, new, row, strict=True) if c in some]
                if min(steps) > 0 and score(*new) > limit:
                    far = bool(np.sqrt(((cloud - vector(new)) ** 2).sum(1)).min() > farthest + 1e-12)
                    found.setdefault(", ".join(some), []).append((far, sum(steps)))
        singles = sorted(min(c for _, c in found[s]) for s in found if "," not in s)
        bound = singles[2] if len(singles) > 2 else float("inf")
        pairs = {s: [f for f in v if f[1] <= bound] if "," in s else v for s, v in found.items()}
        best = sorted((min(v)[0], s.count(","), round(min(v)[1], 9), s) for s, v in pairs.items() if v)
        out[key] = best[:3]
    return out


def test_search_equals_the_full_grid(spark, people):
    df = spark.createDataFrame(people, "k long, x double, y double, g string").repartition(3)
    found = counterfactual.search(df, df, COLUMNS, F.expr(PREDICT), F.col("predicted") > 15, "k").collect()
    got = {}
    for r in found:
        got.setdefault(r["k"], []).append((r["far"], r["columns"].count(","), round(r["cost"], 9), r["columns"]))
        row = dict(zip(COLUMNS, people[r["k"]][1:], strict=True)) | {c: v if c == "g" else float(v) for c, v in json.loads(r["to"]).items()}
        assert r["predicted"] == score(*(row[c] for c in COLUMNS)) > 15 and set(json.loads(r["to"])) == set(r["columns"].split(", "))
    want = {k: v for k, v in brute(people, 15).items() if v}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert any(c for v in got.values() for _, c, *_ in v) and len(got) > 60


def test_candidates_are_observed_values(spark, people):
    df = spark.createDataFrame(people, "k long, x double, y double, g string")
    values = counterfactual.observed_values(df.withColumn("many", F.col("k") * 1.5), ["x", "g", "many"], 10)
    assert values["x"] == sorted({p[1] for p in people}) and set(values["g"]) == set("abc")
    assert len(values["many"]) == 10 and set(values["many"]) <= {i * 1.5 for i in range(120)} and values["many"][-1] == 119 * 1.5
    assert counterfactual.thin(list(range(100)), 10)[0] == 0 and counterfactual.thin(list(range(100)), 10)[-1] == 99


def test_rows_that_need_or_find_no_change(spark, people):
    df = spark.createDataFrame(people, "k long, x double, y double, g string")
    assert counterfactual.search(df, df, COLUMNS, F.expr(PREDICT), F.col("predicted") > -1, "k").count() == 0
    assert counterfactual.search(df, df, ["x"], F.expr(PREDICT), F.col("predicted") > 1000, "k").count() == 0
    assert counterfactual.search(df.where("false"), df, COLUMNS, F.expr(PREDICT), F.col("predicted") > 15, "k").count() == 0
    found = counterfactual.search(df, df, COLUMNS, F.expr(PREDICT), F.col("predicted") > 15, "k")
    each = counterfactual.agreement(found, "k", 120)
    assert set(r["column"] for r in each.collect()) <= set(COLUMNS) and each.agg(F.max("share")).first()[0] <= 1


def test_copies_are_looked_up_once(spark, people, monkeypatch):
    """Where every vector has copies the nearest other row is 0 away: no neighbours are searched, and only observed vectors are plausible."""
    copies = [(i, *people[i % 40][1:]) for i in range(200)]
    df = spark.createDataFrame(copies, "k long, x double, y double, g string").repartition(3)
    monkeypatch.setattr(counterfactual.nearest, "neighbours", lambda *_, **__: pytest.fail("searched"))
    got = {}
    for r in counterfactual.search(df.where("k < 40"), df, COLUMNS, F.expr(PREDICT), F.col("predicted") > 15, "k").collect():
        got.setdefault(r["k"], []).append((r["far"], r["columns"].count(","), round(r["cost"], 9), r["columns"]))
    want = {k: v for k, v in brute(copies, 15).items() if v and k < 40}
    assert {k: sorted(v) for k, v in got.items()} == want
    assert len({far for v in got.values() for far, *_ in v}) == 2


def test_own_distance_of_some_copies(spark, people):
    """A quantile among copies and single rows, and of tables of one row or none."""
    x = np.array([[float(i), 0.0] for i in range(30)] + [[3.0, 0.0]] * 5 + [[99.0, 0.0], [200.0, 7.0]])
    rows = lambda some: spark.createDataFrame([(v.tolist(),) for v in some], "x array<double>")
    own = [np.sort(np.sqrt(((x - v) ** 2).sum(1)))[1] for v in x]
    assert counterfactual.own_distance(counterfactual.distinct_vectors(rows(x))) == pytest.approx(np.quantile(own, 0.95))
    assert counterfactual.own_distance(counterfactual.distinct_vectors(rows(x[:1]))) == float("inf") == counterfactual.own_distance(counterfactual.distinct_vectors(rows(x[:0])))


def test_rows_of_one_file_are_dealt_before_they_are_tried(spark, people, monkeypatch):
    monkeypatch.setattr(counterfactual, "TRIED", 100)
    df = spark.createDataFrame(people, "k long, x double, y double, g string").coalesce(1)
    space = counterfactual.Space(df, COLUMNS)
    found = counterfactual.flips(space, df, len(people), F.expr(PREDICT), F.col("predicted") > 15, [("x",), ("y",)], 40, "k")
    assert found.rdd.getNumPartitions() > 8 and found.count()
