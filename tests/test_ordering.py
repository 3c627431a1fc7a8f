"""Numbers, sums and ranks over global orders, against plain Python; and no window that takes a whole table."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate, joins, metrics, ordering, split


@pytest.fixture(scope="module")
def skewed(spark):
    """9000 rows, two thirds of them of one class, many equal scores."""
    rng = random.Random(4)
    rows = [(i, "big" if i % 3 else f"c{i % 7}", round(rng.random(), 2), rng.randrange(2)) for i in range(9000)]
    return rows, spark.createDataFrame(rows, "id long, label string, score double, y int").repartition(7)


def test_numbers_and_running_sums(skewed):
    rows, df = skewed
    want = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["id"]: (r["n"], r["s"]) for r in ordering.running(ordering.numbered(df, ["score", "id"], "n"), ["score", "id"], {"s": "y"}).collect()}
    total = 0
    for i, r in enumerate(want):
        total += r[3]
        assert got[r[0]] == (i, total)
    down = ordering.numbered(df, [F.desc("score"), F.col("id")], "n").where("n < 3").collect()
    assert sorted((r["n"], r["id"]) for r in down) == list(enumerate(r[0] for r in sorted(rows, key=lambda r: (-r[2], r[0]))[:3]))


def test_the_row_before(skewed):
    rows, df = skewed
    want = sorted(rows, key=lambda r: r[0])
    got = {r["id"]: r["before"] for r in ordering.shifted(df, ["id"], "score", 2, "before").collect()}
    assert got == {r[0]: want[i - 2][2] if i > 1 else None for i, r in enumerate(want)}


def test_ranks_within_a_hot_class(skewed):
    rows, df = skewed
    got = {r["id"]: r["_rank"] for r in ordering.ranked_within(df, "label", split.hash_order("id"), "id").collect()}
    import hashlib

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]))
    assert got == {i: n + 1 for members in by.values() for n, (_, i) in enumerate(sorted(members))}


def test_as_of_join_with_a_hot_key(spark):
    rng = random.Random(9)
    left = [(i, "hot" if i % 5 else f"k{i % 3}", rng.randrange(4000)) for i in range(3000)]
    right = [(i, "hot" if i % 2 else f"k{i % 4}", rng.randrange(4000)) for i in range(900)] + [(1000, "k0", None)]
    l_df, r_df = spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "rid int, k string, at int")
    got = {r["id"]: r["rid"] for r in joins.asof_join(l_df, r_df.where("at IS NOT NULL"), "k", "t", "at", ["rid"], "rid").collect()}
    for i, k, t in left:
        past = [(at, rid) for rid, rk, at in right if rk == k and at is not None and at <= t]
        assert got[i] == (max(past)[1] if past else None)


def test_curves_are_those_of_all_pairs(skewed):
    rows, df = skewed
    pos, neg = ([r[2] for r in rows if r[3] == y] for y in (1, 0))
    won = sum((p > n) + (p == n) / 2 for p in pos[:400] for n in neg[:400])
    part = df.where(F.col("id").isin([r[0] for r in rows if r[3] == 1][:400] + [r[0] for r in rows if r[3] == 0][:400]))
    assert metrics.roc_auc(part, "y", "score").first()["auc"] == pytest.approx(won / 160_000)
    precision, last, area = {}, 0.0, 0.0
    for s in sorted({r[2] for r in rows}, reverse=True):
        tp, fp = sum(p >= s for p in pos), sum(n >= s for n in neg)
        precision[s] = (tp / (tp + fp), tp / len(pos))
        area, last = area + precision[s][0] * (precision[s][1] - last), precision[s][1]
    curve = {r["score"]: (r["precision"], r["recall"]) for r in metrics.pr_curve(df, "y", "score").collect()}
    assert curve.keys() == precision.keys() and all(curve[s] == pytest.approx(precision[s]) for s in curve)
    assert metrics.average_precision(df, "y", "score").first()["average_precision"] == pytest.approx(area)


def test_conformal_quantile_is_the_sorted_one(skewed):
    rows, df = skewed
    scores = sorted(r[2] for r in rows)
    for alpha in (0.05, 0.1, 0.5):
        k = -(-(len(scores) + 1) * round((1 - alpha) * 100) // 100)
        assert evaluate.conformal_quantile(df, "score", alpha).first()["quantile"] == scores[k - 1]
    assert evaluate.conformal_quantile(df.limit(5), "score", 0.05).count() == 0


def test_bootstrap_holds_the_mean(skewed):
    rows, df = skewed
    found = evaluate.bootstrap(df, "id", F.col("y"), resamples=400).first()
    mean = sum(r[3] for r in rows) / len(rows)
    error = (mean * (1 - mean) / len(rows)) ** 0.5
    assert found["estimate"] == pytest.approx(mean)
    assert found["low"] == pytest.approx(mean - 1.96 * error, abs=0.4 * error) and found["high"] == pytest.approx(mean + 1.96 * error, abs=0.4 * error)
