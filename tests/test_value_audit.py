"""Bias and error by group against resamples that are drawn row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate
from quern.operators.resample import weights

SCHEMA = "id long, g string, y double, p double"


def rows_of(n=400):
    rng = random.Random(2)
    out = []
    for i in range(n):
        g = rng.choices(["a", "b", "c", "tiny", None, " "], [10, 5, 5, 0.4, 1, 1])[0]
        y = rng.gauss(0, 1)
        out.append((i, g, None if i % 50 == 0 else y, y + {"b": 1.0, "c": 0.0}.get(g, 0.2) + rng.gauss(0, 0.5)))
    return out


def test_audit_equals_resampling_by_hand(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    got = evaluate.value_audit(df, "g", "id", "y", "p", resamples=200).collect()
    keys = {r["id"]: r["k"] for r in df.select("id", F.xxhash64("id", F.lit(42)).alias("k")).collect()}
    groups = {}
    for i, g, y, p in rows_of():
        if g and g.strip() and y is not None:
            groups.setdefault(g, []).append((keys[i], p - y))
    large = sorted((g for g in groups if len(groups[g]) >= 20), key=lambda g: (-len(groups[g]), g))
    assert [r["group"] for r in got] == large == ["a", *sorted(["b", "c"], key=lambda g: (-len(groups[g]), g))]
    drawn = {}
    for g in large:
        w = weights(np.array([k for k, _ in groups[g]], np.int64), 200)
        e = np.array([x for _, x in groups[g]])
        drawn[g] = {"bias": e @ w / w.sum(axis=0), "mae": np.abs(e) @ w / w.sum(axis=0)}
    for r in got:
        for c in ("bias", "mae"):
            own, gap = drawn[r["group"]][c], drawn[r["group"]][c] - drawn["a"][c]
            for name, values in ((c, own), (f"{c}_gap", gap)):
                assert r[name] == pytest.approx(values[0], abs=1e-9)
                assert (r[f"{name}_low"], r[f"{name}_high"]) == pytest.approx(tuple(np.quantile(values[1:], [0.025, 0.975])), abs=1e-9)
    by = {r["group"]: r for r in got}
    assert by["b"]["bias_decisive"] and not by["a"]["bias_decisive"] and by["b"]["n"] == len(groups["b"])


def test_too_few_groups_give_no_rows(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    assert evaluate.value_audit(df.where("g = 'a'"), "g", "id", "y", "p").count() == 0
    assert evaluate.value_audit(df.where("false"), "g", "id", "y", "p").count() == 0
    assert evaluate.value_audit(df, "g", "id", "y", "p", most=2).count() == 2
