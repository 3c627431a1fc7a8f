"""A training run from a table to a model, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import runs, training

SCHEMA = "id long, day date, shop string, size double, kind string, lot string, note string, fixed string, answer string, price double"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(260):
        yes = rng.random() < 0.4
        note = " ".join(rng.choice("alpha beta gamma delta epsilon zeta theta kappa lambda omega sigma".split()) for _ in range(9)) + (" splendid goods" if yes else " broken goods") + f" case{i}"
        rows.append((i, f"2024-{1 + i // 30 % 12:02d}-{1 + i % 28:02d}", f"s{i % 13}", None if i % 17 == 0 else yes * 1.5 + rng.gauss(0, 1), rng.choice("abc"), f"c{rng.randrange(15)}", note, "same", None if i % 65 == 0 else "yes" if yes else "no", yes * 10 + rng.gauss(0, 1)))
    return spark.createDataFrame(rows, SCHEMA.replace("day date", "day string")).withColumn("day", F.col("day").cast("date"))


def test_a_run_from_table_to_model(table):
    run = training.train(table.drop("price"), "answer", "id", ["logistic", "tree"])
    assert run.task == "classification" and run.classes == ["no", "yes"] and run.champion in ("logistic", "tree")
    assert run.features["numeric"] == ["size"] and "kind" in run.features["words"] and {"shop", "lot"} <= set(run.features["wide"]) and run.features["texts"] == ["note"]
    notes = {(a, b): c for a, b, c in run.journal.notes}
    assert notes[("left-out", "fixed")] == "constant" and notes[("left-out", "day")] == "date" and notes[("unlabelled", "answer")] == "4"
    board = {r["model"]: r for r in run.results.collect()}
    assert set(board) == {"baseline", "logistic", "tree", "blend"} and run.blend.method == "probability"
    assert board[run.champion]["validation"] == max(board[m]["validation"] for m in ("logistic", "tree")) > board["baseline"]["validation"]
    told = run.predict(table)
    assert told.columns == [*table.columns, "predicted"] and told.count() == 260
    assert told.where("answer IS NOT NULL").agg(F.avg((F.col("answer") == F.col("predicted")).cast("int"))).first()[0] > 0.9
    with pytest.raises(ValueError, match="missing-columns:size"):
        run.predict(table.drop("size"))


def test_numbers_are_split_at_random_and_by_mean(table):
    run = training.train(table.drop("answer", "note"), "price", "id", ["tree", "forest"])
    assert run.task == "regression" and run.blend.method == "mean" and run.champion
    board = {r["model"]: r for r in run.results.collect()}
    assert board[run.champion]["validation"] < board["baseline"]["validation"] * 1.1
    assert {r["part"]: r["count"] for r in run.data.rows.groupBy("part").count().collect()} == {"test": 52, "validation": 42, "train": 166}


def test_parts_by_time_and_group(table):
    rows = runs.parted(table, "price", "id", "time", "day")
    ends = {r["part"]: (r["low"], r["high"], r["n"]) for r in rows.groupBy("part").agg(F.min("day").alias("low"), F.max("day").alias("high"), F.count("*").alias("n")).collect()}
    assert ends["train"][1] <= ends["validation"][0] and ends["validation"][1] <= ends["test"][0] and ends["test"][2] == 52
    groups = runs.parted(table, "price", "id", "group", "shop").groupBy("shop").agg(F.count_distinct("part").alias("n"), F.first("part").alias("part")).collect()
    assert all(r["n"] == 1 for r in groups) and {r["part"] for r in groups} == {"train", "validation", "test"}
    for by, told in (("time", "no-column-for:time"), ("elsewhere", "no-split:elsewhere")):
        with pytest.raises(ValueError, match=told):
            runs.parted(table, "price", "id", by)


def test_refusals_and_small_tables(table):
    with pytest.raises(ValueError, match="no-task:note"):
        training.train(table, "note", "id")
    with pytest.raises(ValueError, match="no-features"):
        training.train(table.select("id", "answer", "fixed"), "answer", "id")
    run = training.train(table.where("id < 40").select("id", "size", "kind", "answer"), "answer", "id", ["tree"])
    assert run.champion is None and run.production is None and "no-champion" in {n[0] for n in run.journal.notes}
    with pytest.raises(ValueError, match="no-champion"):
        run.predict(table)
