"""The word model's effects against scoring every text again without the word."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions.cells import tokens
from quern.operators import words

TEXTS = ["good good bread", "bad bread", "fine good wine", "bad bad wine arrived", "", None, "wine", "unknown words only", "good bad bread wine", "bread wine good fine fine"]
MODEL = words.WordModel(("good", "bad", "wine", "bread", "fine"), (1.1, 1.5, 1.2, 1.3, 2.0), (2.0, -3.0, 0.5, 0.0, 0.25), 0.1, True)


def frame(spark, texts, labels=None):
    return spark.createDataFrame([(i, t, (labels or [0] * len(texts))[i]) for i, t in enumerate(texts)], "id long, text string, y int")


def score(model, toks):
    x = [toks.count(t) * i for t, i in zip(model.terms, model.idf, strict=True)]
    norm = math.sqrt(sum(v * v for v in x))
    z = model.bias + (sum(v * w for v, w in zip(x, model.weights, strict=True)) / norm if norm else 0)
    return 1 / (1 + math.exp(-z)) if model.classes else z


@pytest.mark.parametrize("classes", [True, False])
def test_effects_equal_rescoring(spark, classes):
    model = words.WordModel(MODEL.terms, MODEL.idf, MODEL.weights, MODEL.bias, classes)
    df = frame(spark, TEXTS)
    toks = [r[0] for r in df.orderBy("id").select(tokens(F.col("text"))).collect()]
    assert [r["predicted"] for r in model.scored(df, "text").orderBy("id").collect()] == pytest.approx([score(model, t) for t in toks])
    want = {}
    for word in model.terms:
        held = [t for t in toks if word in t]
        if len(held) >= 3:
            want[word] = (len(held), sum(score(model, t) - score(model, [u for u in t if u != word]) for t in held) / len(held))
    got = {r["word"]: (r["rows"], r["effect"]) for r in words.word_effects(df, "text", model, top=None).collect()}
    assert got.keys() == want.keys() and all(got[w] == pytest.approx(want[w]) for w in want)
    told = [r["word"] for r in words.word_effects(df, "text", model, top=2).collect()]
    assert told == sorted(want, key=lambda w: (-abs(want[w][1]), w))[:2]


def test_fit_finds_the_words_that_matter(spark):
    texts = [f"{'good' if i % 2 else 'bad'} bread number{i % 5} wine" for i in range(200)]
    df = frame(spark, texts, [i % 2 for i in range(200)])
    model = words.fit_words(df, "text", "y")
    told = {r["word"]: r["effect"] for r in words.word_effects(df, "text", model).collect()}
    assert told["good"] > 0.2 and told["bad"] < -0.2 and all(abs(v) < 0.1 for w, v in told.items() if w not in ("good", "bad"))
    right = model.scored(df, "text").agg(F.avg(((F.col("predicted") > 0.5).cast("int") == F.col("y")).cast("int"))).first()[0]
    assert right == 1.0
    value = words.fit_words(df.withColumn("v", F.col("y") * 10.0), "text", "v", classes=False)
    assert {r["word"]: r["effect"] > 0 for r in words.word_effects(df, "text", value, top=2).collect()} == {"good": True, "bad": False}


def test_models_without_words_or_with_one_class(spark):
    df = frame(spark, ["a b", "", None], [1, 1, 1])
    model = words.fit_words(df, "text", "y")
    assert model.terms == () and 0.8 < model.scored(df, "text").first()["predicted"] < 1
    assert words.word_effects(df, "text", model).count() == 0 and not words.saturated(df, "text", model)
    with pytest.raises(ValueError, match="not-two-classes"):
        words.fit_words(frame(spark, ["a", "b"], [1, 2]), "text", "y")
    with pytest.raises(ValueError, match="no-label"):
        words.fit_words(df.where("false"), "text", "y")


def test_saturated_models_are_told(spark):
    df = frame(spark, TEXTS)
    stuck = words.WordModel(MODEL.terms, MODEL.idf, (0.0,) * 5, 800.0, True)
    assert words.saturated(df, "text", stuck) and words.word_effects(df, "text", stuck).count() == 0
    assert not words.saturated(df, "text", MODEL)
