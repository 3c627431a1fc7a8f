"""Preparation, families, rankings, blends, leaks and comparisons on small tables."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quern.operators import cluster, runs, scoring, split


@pytest.fixture(scope="module")
def prepared(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        y = int(rng.random() < 0.3)
        rows.append((i, None if i % 11 == 0 else y * 2 + rng.gauss(0, 1), "ab"[rng.random() < 0.3 + 0.5 * y], None if i % 50 == 0 else y))
    df = spark.createDataFrame(rows, "id long, x double, k string, y int")
    return runs.prepare(df, ["x"], ["k"], "y", "id")


def test_preparation_splits_and_fits_on_train_only(prepared):
    parts = {r["part"]: r["n"] for r in prepared.rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sum(parts.values()) == 294 and parts["test"] in (58, 59) and parts["validation"] in (47, 48)
    train = sorted(r["x"] for r in prepared.rows.where("part = 'train' AND x IS NOT NULL").collect())
    middle = prepared.encoders.stages[0].surrogateDF.first()["x"]
    assert train[len(train) // 2 - 3] <= middle <= train[len(train) // 2 + 3]
    other = prepared.rows.where("part = 'test'").withColumn("k", F.lit("unseen"))
    assert prepared.encoders.transform(other).select("features").first()["features"].toArray()[1:].sum() == 0
    small = runs.prepare(prepared.rows.drop("part").where("id < 40"), ["x"], [], "y", "id")
    assert {r["part"] for r in small.rows.select("part").distinct().collect()} == {"train", "test"}


def test_weights_reach_the_fit(prepared):
    """Rare positives are called more often when classes count alike; families without weights get as many rows of each class."""
    train, held = prepared.part("train"), prepared.part("validation", "test")
    called = lambda family, weighted: runs.predicted(runs.fit(family, train, 2, weighted), held, "id").agg(F.sum("predicted")).first()[0]
    assert called("logistic", True) > called("logistic", False)
    resampled = {r["label"]: r["n"] for r in split.balanced(train, "label", "id").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert resampled[0.0] == resampled[1.0] and runs.fit("mlp", train, 2, True).stages[0].numClasses == 2


def test_records_and_refits_predict(prepared, tmp_path):
    model = runs.fit("tree", prepared.part("train"), 2)
    runs.save(model, str(tmp_path / "tree"))
    rows = prepared.part("test")
    told = lambda m: sorted((r["id"], r["predicted"], tuple(r["probability"])) for r in runs.predicted(m, rows, "id").collect())
    assert told(runs.load(str(tmp_path / "tree"))) == told(model)


def test_refits_fit_their_encoders_anew(prepared):
    """Encoders of a refit come from all rows, those of the run from train alone."""
    model = runs.refit("tree", prepared, 2)
    known = sorted(r["x"] for r in prepared.rows.where("x IS NOT NULL").collect())
    middle = model.stages[0].surrogateDF.first()["x"]
    assert known[len(known) // 2 - 2] <= middle <= known[len(known) // 2 + 2]
    assert middle != prepared.encoders.stages[0].surrogateDF.first()["x"]
    told = runs.predicted(model, prepared.rows.withColumn("label", F.col("y").cast("double")), "id")
    assert told.count() == 294 and runs.measured(told, "classification").first()[0] > 0.7


def test_learning_curve_has_sizes_intervals_and_a_verdict(prepared):
    assert scoring.curve_sizes(1600, 16) == [100, 174, 303, 528, 919, 1600] and scoring.curve_sizes(20, 16) == [20] and scoring.curve_sizes(10, 16) == []
    found = scoring.family_curve(prepared, "tree").collect()
    n = prepared.rows.where("part = 'train'").count()
    assert len(found) >= 3 and found[-1]["rows"] == n and [r["rows"] for r in found] == sorted(r["rows"] for r in found)
    assert all(r["low"] <= r["estimate"] <= r["high"] for r in found) and found[0]["gain"] is None
    for a, b in zip(found, found[1:], strict=False):
        assert b["gain"] == pytest.approx(b["estimate"] - a["estimate"]) and b["gain_low"] <= b["gain_high"]
    assert [r["verdict"] for r in found[:-1]] == [None] * (len(found) - 1)
    assert found[-1]["verdict"] == ("climbing" if found[-1]["gain"] > 0 and found[-1]["gain_low"] > 0 else "plateau")
    whole = runs.fit("tree", prepared.part("train"), 2)
    assert found[-1]["estimate"] == pytest.approx(runs.measured(runs.predicted(whole, prepared.part("test"), "id"), "classification").first()[0])
    small = runs.prepare(prepared.rows.drop("part").where("id < 18"), ["x"], [], "y", "id")
    assert scoring.family_curve(small, "tree").count() == 0


def test_ranking_gap_and_blends(spark, prepared):
    board = runs.leaderboard(prepared, ["logistic", "tree"])
    assert {r["model"] for r in board.collect()} == {"logistic", "tree"} and board.where("test < 0.6").count() == 0
    results = spark.createDataFrame([("baseline", 0.9, 0.1), ("a", 0.8, 0.7), ("b", 0.8, 0.9), ("c", 0.7, 0.6), ("d", None, 0.5), ("e", 0.6, 0.6)], "model string, validation double, test double")
    assert tuple(runs.champion_gap(results.where("model <> 'baseline'"), True).first())[:3] == ("a", 0.8, 0.7)
    assert runs.champion_gap(results.where("model <> 'baseline'"), True).first()["gap"] == pytest.approx(-0.1)
    assert runs.champion_gap(results.where("validation IS NULL"), True).count() == 0
    assert runs.plan_blend(results, True, {"b", "c", "e"}) == runs.Blend(("b", "c", "e"), "probability")
    assert runs.plan_blend(results, True, {"b"}) == runs.Blend(("a", "b", "c"), "vote")
    assert runs.plan_blend(results, False, set(), "regression") == runs.Blend(("e", "c", "a"), "mean")
    assert runs.plan_blend(results.where("model IN ('a', 'baseline')"), True, set()) is None
    votes = spark.createDataFrame([(1, 2, 2), (1, 2, 3), (3, 3, 1)], "a int, b int, c int")
    assert [r[0] for r in votes.select(runs.blended("vote", [F.col("a"), F.col("b"), F.col("c")])).collect()] == [2, 1, 3]
    shares = spark.createDataFrame([([0.6, 0.4], [0.1, 0.9])], "a array<double>, b array<double>")
    assert shares.select(runs.blended("probability", [F.col("a"), F.col("b")])).first()[0] == 1


def test_robust_ranking_deals_every_half_twice(prepared):
    found = runs.robust_rank(prepared, ["tree"], repeats=2).first()
    assert found["model"] == "tree" and found["folds"] == 4 and 0.6 < found["mean"] < 1 and found["sd"] > 0


def test_leaks_are_told(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), i % 2, "xy"[i % 2], "pq"[rng.randrange(2)]) for i in range(200)]
    df = spark.createDataFrame([(i, n, y, None if i % 2 else k, w, float(y * 10 + n)) for i, n, y, k, w in rows], "id long, noise double, y int, k string, w string, giveaway double")
    found = {r["column"] for r in runs.leak_scan(df, ["noise", "k", "w", "giveaway"], "y", F.col("id") % 5 == 0).collect()}
    assert found == {"k", "giveaway"}
    assert runs.leak_scan(df.limit(40), ["k"], "y", F.col("id") % 5 == 0).count() == 0
    scores = {r["column"]: r["score"] for r in runs.leak_scores(df.withColumn("z", F.col("giveaway") * 2), ["giveaway", "w"], "z", F.col("id") % 5 == 0, False).collect()}
    assert scores["giveaway"] > 0.99 and scores["w"] < 0.3


def test_comparisons_and_keys(spark):
    a = spark.createDataFrame([("m", 0.5), ("n", 0.7)], "model string, test double")
    b = spark.createDataFrame([("m", 0.6), ("o", 0.9)], "model string, test double")
    got = [tuple(r) for r in runs.compare_runs(a, b, True).orderBy("place").collect()]
    assert [g[:4] for g in got] == [(1, "o", None, 0.9), (2, "n", 0.7, None), (3, "m", 0.5, 0.6)] and got[2][4] == pytest.approx(0.1)
    assert runs.compare_features(["x", "y"], ["z", "y"]) == {"added": ["z"], "removed": ["x"], "kept": ["y"]}
    assert runs.key_candidates(a, spark.createDataFrame([(1, 2, 3)], "test int, q int, model int")) == ["test", "model"]
    journal = runs.Journal()
    for i in range(30):
        journal.add("fold-failed", "tree", i)
    assert len(journal.notes) == 20


def test_the_number_of_clusters_is_the_one_that_is_there(spark):
    rng = random.Random(8)
    rows = [(i, [10.0 * (i % 3) + rng.gauss(0, 0.3), 5.0 * (i % 3 == 1) + rng.gauss(0, 0.3)], "abc"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, w string")
    found, tried = cluster.choose_kmeans(df, "id", "v")
    scores = {r["k"]: r["silhouette"] for r in tried.collect()}
    assert set(scores) == {2, 3, 4, 5} and max(scores, key=scores.get) == 3
    traits = cluster.categorical_traits(df.join(found, "id"), "cluster", ["w"]).collect()
    assert sorted(r["value"] for r in traits) == ["a", "b", "c"] and all(r["share"] == 1 and r["overall"] == pytest.approx(1 / 3) for r in traits)
    flat = df.select("id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    spread = cluster.project(flat, "id", ["x", "y"]).agg(F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")).first()
    assert spread[0] > spread[1] and spread[2] == pytest.approx(0, abs=1e-6)


def test_robust_ranking_repeats_go_on_at_once(prepared, monkeypatch):
    """Every fit waits for one of the other repeat, and the figures are those of repeats on their own."""
    alone = runs.robust_rank(prepared, ["tree"], repeats=2).first()
    meet, plain = threading.Barrier(2), runs.fit

    def fit(*given, **named):
        meet.wait(60)
        return plain(*given, **named)

    monkeypatch.setattr(runs, "fit", fit)
    found = runs.robust_rank(prepared, ["tree"], repeats=2).first()
    assert found["folds"] == 4 and found["mean"] == pytest.approx(alone["mean"])
