"""A linear model on the words of a text, and what each word does to its answers.

Texts become unit vectors of term counts times inverse document frequency over a
vocabulary of bounded size; the fit is MLlib's, with an L1 share that leaves out most
words. A word's effect is measured, not read off its weight: the text is scored again
without it. Taking a word out takes its part from the score and from the length of
the vector, so that each row holds all that is needed and only sums for each word
are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import encode

# How many words are tried, in how many rows one must stand, how many are told.
CANDIDATES, LEAST_ROWS, TOP = 40, 3, 12
PENALTY, SPARSE = 0.001, 0.5


@dataclass(frozen=True)
class WordModel:
    """score = bias + the weights of a text's unit vector; with ``classes``, its logistic. A text without known words scores the bias."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    classes: bool

    def __post_init__(self):
        if not len(self.terms) == len(self.idf) == len(self.weights):
            raise ValueError("a term needs its frequency and its weight")

    def parts(self, df: DataFrame, text: str) -> DataFrame:
        """The rows with ``_parts``, for each known word of a text: (word, x: count times idf, wx: weight times that)."""
        held = F.array().cast("array<struct<word:string,x:double,wx:double>>")
        if self.terms:
            df = CountVectorizerModel.from_vocabulary(list(self.terms), "_tokens", "_counts").transform(df.withColumn("_tokens", cells.tokens(F.col(text))))
            terms, idf, weights = (F.array(*[F.lit(v) for v in values]) for values in (self.terms, map(float, self.idf), map(float, self.weights)))

            def part(count: Column, i: Column) -> Column:
                x = count * F.get(idf, i)
                return F.struct(F.get(terms, i).alias("word"), x.alias("x"), (x * F.get(weights, i)).alias("wx"))

            held = F.filter(F.transform(vector_to_array("_counts"), part), lambda p: p["x"] > 0)
        return df.withColumn("_parts", held).drop("_tokens", "_counts")

    def answer(self, score: Column) -> Column:
        return 1 / (1 + F.exp(-score)) if self.classes else score

    def raw(self, sums: Column, squares: Column) -> Column:
        return F.lit(float(self.bias)) + F.when(squares > 0, sums / F.sqrt(squares)).otherwise(0.0)

    def scored(self, df: DataFrame, text: str, name: str = "predicted") -> DataFrame:
        """The rows with the share of class 1, or the value."""
        return self.parts(df, text).withColumn(name, self.answer(self.raw(summed("wx"), summed("x", squared=True)))).drop("_parts")


def summed(field: str, squared: bool = False) -> Column:
    return F.aggregate("_parts", F.lit(0.0), lambda a, p: a + (p[field] * p[field] if squared else p[field]))


def fit_words(df: DataFrame, text: str, label: str, classes: bool = True, most: int = encode.MOST_TERMS, penalty: float = PENALTY, sparse: float = SPARSE) -> WordModel:
    """A model of a 0/1 label, or of a number. Rows without a label are left out; one class or no word gives the bias alone."""
    known = df.select(F.col(text).alias("_text"), F.col(label).cast("double").alias("label")).where("label IS NOT NULL")
    if classes and known.where(~F.col("label").isin(0.0, 1.0)).limit(1).count():
        raise ValueError(f"not-two-classes:{label}")
    vocabulary = encode.tfidf_vocabulary(known, "_text", most).orderBy(F.desc("df"), "term").collect()  # ``most`` rows at most
    mean, low, high = known.agg(F.avg("label"), F.min("label"), F.max("label")).first()
    if mean is None:
        raise ValueError(f"no-label:{label}")
    terms, idf = tuple(r["term"] for r in vocabulary), tuple(float(r["idf"]) for r in vocabulary)
    if not terms or low == high:
        # A share of 0 or 1 has no finite score; half a row stands in for the class that isn't there.
        n = known.count()
        share = min(max(mean, 0.5 / n), 1 - 0.5 / n) if classes else mean
        return WordModel((), (), (), math.log(share / (1 - share)) if classes else float(mean), classes)
    counts = CountVectorizerModel.from_vocabulary(list(terms), "_tokens", "_counts")
    rows = known.select("label", cells.tokens(F.col("_text")).alias("_tokens"))
    for stage in (counts, ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_counts", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)):
        rows = stage.transform(rows)
    family = LogisticRegression if classes else LinearRegression
    model = family(regParam=penalty, elasticNetParam=sparse, standardization=False, maxIter=100).fit(rows.select("features", "label"))
    return WordModel(terms, idf, tuple(float(w) for w in model.coefficients), float(model.intercept), classes)


def word_effects(df: DataFrame, text: str, model: WordModel, candidates: int = CANDIDATES, least: int = LEAST_ROWS, top: int | None = TOP) -> DataFrame:
    """(word, rows, effect): how much higher the answer is with a word than without it, on average over the rows that hold it.

    Tried are the words in most rows; told are those that move the answer most.
    ``saturated`` says whether words were tried and none of them moved it.
    """
    if not model.terms:
        return df.sparkSession.createDataFrame([], "word string, rows long, effect double")
    sums = model.parts(df.select(text), text).where(F.size("_parts") > 0).select("_parts", summed("wx").alias("_s"), summed("x", squared=True).alias("_q"))
    each = sums.select("_s", "_q", F.size("_parts").alias("_n"), F.explode("_parts").alias("p"))
    # The only known word leaves nothing, whatever the rounding of the difference says.
    rest = F.when(F.col("_n") > 1, F.col("_q") - F.col("p.x") * F.col("p.x")).otherwise(0.0)
    shift = model.answer(model.raw(F.col("_s"), F.col("_q"))) - model.answer(model.raw(F.col("_s") - F.col("p.wx"), rest))
    found = each.groupBy(F.col("p.word").alias("word")).agg(F.count("*").alias("rows"), F.avg(shift).alias("effect"))
    tried = found.where(F.col("rows") >= least).orderBy(F.desc("rows"), "word").limit(candidates)
    return tried.where("effect <> 0").orderBy(F.desc(F.abs("effect")), "word").limit(top) if top else tried


def saturated(df: DataFrame, text: str, model: WordModel, candidates: int = CANDIDATES, least: int = LEAST_ROWS) -> bool:
    """Whether words were tried and not one of them moved the answer: such a model can't say which words matter."""
    row = word_effects(df, text, model, candidates, least, None).agg(F.count("*").alias("n"), F.count_if(F.col("effect") != 0).alias("moved")).first()
    return row["n"] > 0 and row["moved"] == 0
