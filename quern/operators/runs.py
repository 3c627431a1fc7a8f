"""Training runs: data preparation, families with class weights, refits, records, rankings and what can be told of them.

A run's tables (results, scores) have a row for each model or each prediction;
fits are MLlib's, on all rows that they are given.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, Normalizer, OneHotEncoder, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quern.functions import cells
from quern.operators import metrics, models, split
from quern.operators.encode import MOST_TERMS
from quern.operators.ordering import all_of
from quern.sources.stored import stored

# When there is a validation part, when a column tells too much, how many models a blend has, how often halves are dealt.
LEAST_FOR_VALIDATION, TEST_SHARE, VALIDATION_SHARE = 60, 0.2, 0.2
LEAK_SCORE, LEAK_ROWS, LEAK_BINS = 0.99, 20, 32
BLEND_LEAST, BLEND_SIZE = 2, 3
ROBUST_REPEATS = 5
#: Repeats whose fits go on at the same time; each holds one dealing of the rows.
AT_ONCE = 4
NOTES = 20
#: Families whose loss takes a weight for each row; the others are given resampled rows.
WEIGHTED = ("logistic", "tree", "forest")


@dataclass(frozen=True)
class Prepared:
    """Rows with ``part``, the encoders fitted on the training part alone, and what fits them on other rows."""

    rows: DataFrame
    encoders: PipelineModel
    label: str
    key: str
    recipe: Pipeline

    def part(self, *names: str) -> DataFrame:
        """(key, features, label) of some parts."""
        told = self.encoders.transform(self.rows.where(F.col("part").isin(*names)))
        return told.select(self.key, "features", F.col(self.label).cast("double").alias("label"))


def parted(df: DataFrame, label: str, key: str, by: str = "class", column: str | None = None, seed: int = 42) -> DataFrame:
    """Labelled rows with ``part``: test 20 %, and validation 20 % of the rest from 60 rows on.

    by: ``class`` (each class in proportion), ``random``, ``time`` (the last rows by
    ``column`` are the test, those before them the validation; rows without a time are
    left out), or ``group`` (all rows of a value of ``column`` in one part).
    """
    if by in ("time", "group") and not column:
        raise ValueError(f"no-column-for:{by}")
    known = df.where(F.col(label).isNotNull())
    enough = known.count() >= LEAST_FOR_VALIDATION
    if by == "group":
        return split.grouped(known, column, key, TEST_SHARE, VALIDATION_SHARE * (1 - TEST_SHARE) if enough else 0.0, seed)
    if by == "time":
        cut = lambda rows, share, seed: split.chronological(rows, column, key, share)
    elif by == "class":
        cut = lambda rows, share, seed: split.stratified(rows, label, key, share, seed)
    elif by == "random":
        cut = lambda rows, share, seed: split.stratified(rows.withColumn("_all", F.lit(0)), "_all", key, share, seed).drop("_all")
    else:
        raise ValueError(f"no-split:{by}")
    marked = cut(known, TEST_SHARE, seed)
    if enough:
        rest = cut(marked.where("part = 'train'").drop("part"), VALIDATION_SHARE, seed + 1)
        rest = rest.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise("train"))
        marked = rest.unionByName(marked.where("part = 'test'"))
    return marked


def typed(df: DataFrame, numeric: list[str], words: list[str]) -> dict[str, Column]:
    """What the encoders read of each column: numbers as such, all else as text."""
    return {c: F.col(c).cast("double") for c in numeric} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in words}


def prepare(df: DataFrame, numeric: list[str], words: list[str], label: str, key: str, seed: int = 42, by: str = "class", column: str | None = None, wide: list[str] | None = None, texts: list[str] | None = None) -> Prepared:
    """Splits labelled rows (see ``parted``) and fits the encoders on the training part alone.

    Numbers are imputed by the training median and scaled; words are indexed by
    frequency and made one-hot, those unseen in training as none of them; ``wide``
    ones, of many values, are their scaled rank by frequency; ``texts`` are unit
    vectors of their most frequent terms. Columns that may not be used are left out
    by name before.
    """
    wide, texts = wide or [], texts or []
    if clash := {key, label} & {*numeric, *words, *wide, *texts}:
        raise ValueError(f"not-a-feature:{','.join(sorted(clash))}")
    cast = typed(df, numeric, [*words, *wide, *texts])
    marked = parted(df, label, key, by, column, seed)
    rows = stored(marked.select(key, label, "part", *[c.alias(name) for name, c in cast.items()]), "prepared")  # every fit and every part reads the same rows, dealt once
    stages, blocks = [], []
    if numeric:
        stages.append(Imputer(inputCols=numeric, outputCols=[f"_n_{c}" for c in numeric], strategy="median"))
    if words or wide:
        stages.append(StringIndexer(inputCols=[*words, *wide], outputCols=[f"_i_{c}" for c in [*words, *wide]], handleInvalid="keep"))
    if numeric or wide:
        stages += [VectorAssembler(inputCols=[*[f"_n_{c}" for c in numeric], *[f"_i_{c}" for c in wide]], outputCol="_numbers"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True)]
        blocks.append("_scaled")
    if words:
        stages.append(OneHotEncoder(inputCols=[f"_i_{c}" for c in words], outputCols=[f"_h_{c}" for c in words]))
        blocks += [f"_h_{c}" for c in words]
    for c in texts:
        stages += [RegexTokenizer(inputCol=c, outputCol=f"_t_{c}", pattern="[^a-z0-9]+", minTokenLength=3), CountVectorizer(inputCol=f"_t_{c}", outputCol=f"_c_{c}", vocabSize=MOST_TERMS), IDF(inputCol=f"_c_{c}", outputCol=f"_f_{c}"), Normalizer(inputCol=f"_f_{c}", outputCol=f"_u_{c}")]
        blocks.append(f"_u_{c}")
    stages.append(VectorAssembler(inputCols=blocks, outputCol="features"))
    recipe = Pipeline(stages=stages)
    return Prepared(rows, recipe.fit(rows.where("part = 'train'")), label, key, recipe)


def fit(family: str, train: DataFrame, classes: int, weighted: bool = False, seed: int = 42, task: str = "classification") -> PipelineModel:
    """A family on (key, features, label). Weighted classes count alike: by the loss, or by repeated rows."""
    if task == "regression":
        return Pipeline(stages=[models.REGRESSORS[family](seed)]).fit(train)
    width = len(train.first()["features"])
    estimator = models.CLASSIFIERS[family](seed, [width, 16, classes])
    if weighted and family in WEIGHTED:
        train = train.join(split.class_weights(train, "label").select("label", "weight"), "label")
        estimator = estimator.setWeightCol("weight")
    elif weighted:
        train = split.balanced(train, "label", train.columns[0], seed)
    return Pipeline(stages=[estimator]).fit(train)


def predicted(model: PipelineModel, rows: DataFrame, key: str) -> DataFrame:
    """(key, label, predicted[, probability])."""
    told = model.transform(rows)
    extra = [vector_to_array("probability").alias("probability")] if "probability" in told.columns else []
    return told.select(key, "label", F.col("prediction").alias("predicted"), *extra)


def measured(told: DataFrame, task: str) -> DataFrame:
    """(primary): accuracy, or RMSE."""
    return metrics.regression(told, "label", "predicted").select(F.col("rmse").alias("primary")) if task == "regression" else metrics.accuracy(told, "label", "predicted").select(F.col("accuracy").alias("primary"))


def refit(family: str, data: Prepared, classes: int, weighted: bool = False, seed: int = 42, task: str = "classification") -> PipelineModel:
    """The family and its encoders, fitted anew on all labelled rows: what goes into production, on rows as ``prepare`` stored them."""
    encoders = data.recipe.fit(data.rows)
    rows = encoders.transform(data.rows).select(data.key, "features", F.col(data.label).cast("double").alias("label"))
    return PipelineModel([*encoders.stages, *fit(family, rows, classes, weighted, seed, task).stages])


def save(model: PipelineModel, path: str) -> None:
    """A record of a fitted family or of encoders, which ``load`` rebuilds."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def leaderboard(data: Prepared, families: list[str], classes: int = 2, seed: int = 42, task: str = "classification") -> DataFrame:
    """(model, validation, test): each family fitted on train; validation ranks, test reports."""
    held = {"validation": data.part("validation"), "test": data.part("test")}
    parts = []
    for family in families:
        model = fit(family, data.part("train"), classes, seed=seed, task=task)
        scores = [measured(predicted(model, rows, data.key), task).withColumnRenamed("primary", name) for name, rows in held.items()]
        parts.append(scores[0].crossJoin(F.broadcast(scores[1])).select(F.lit(family).alias("model"), "validation", "test"))  # one row each
    return all_of(parts)


def champion_gap(results: DataFrame, higher_is_better: bool) -> DataFrame:
    """(model, validation, test, gap): the model that validation picks, and what the test says of the pick. No row without validation."""
    order = F.struct((-F.col("validation") if higher_is_better else F.col("validation")).alias("v"), "model")
    best = results.where("validation IS NOT NULL").agg(F.min_by(F.struct("model", "validation", "test"), order).alias("b")).where("b IS NOT NULL")
    return best.select("b.*", (F.col("b.test") - F.col("b.validation")).alias("gap"))


@dataclass(frozen=True)
class Blend:
    members: tuple[str, ...]
    method: str


def plan_blend(results: DataFrame, higher_is_better: bool, probabilistic: set[str], task: str = "classification") -> Blend | None:
    """The best three models but the baseline, and how they go together; none where there are fewer than two."""
    order = F.desc("validation") if higher_is_better else F.asc("validation")
    names = [r["model"] for r in results.where("model <> 'baseline' AND validation IS NOT NULL").orderBy(order, "model").select("model").collect()]  # a row for each model
    if len(names) < BLEND_LEAST:
        return None
    if task == "regression":
        return Blend(tuple(names[:BLEND_SIZE]), "mean")
    with_scores = [n for n in names if n in probabilistic]
    return Blend(tuple(with_scores[:BLEND_SIZE]), "probability") if len(with_scores) >= BLEND_LEAST else Blend(tuple(names[:BLEND_SIZE]), "vote")


def blended(method: str, members: list[Column]) -> Column:
    """One prediction of several, the leader's first: a mean, the class of the mean probabilities, or a vote with ties to the leader."""
    if method == "mean":
        return sum(members[1:], members[0]) / len(members)
    if method == "probability":
        total = members[0]
        for m in members[1:]:
            total = F.zip_with(total, m, lambda a, b: a + b)
        return metrics.argmax(total)
    votes = F.array(*members)
    count = lambda x: F.size(F.filter(votes, lambda v: v == x))
    most = F.array_max(F.transform(votes, count))
    return F.when(count(members[0]) == most, members[0]).otherwise(F.get(F.filter(votes, lambda v: count(v) == most), F.lit(0)))


def robust_rank(data: Prepared, families: list[str], classes: int = 2, repeats: int = ROBUST_REPEATS, seed: int = 42, task: str = "classification") -> DataFrame:
    """(model, mean, sd, folds): the families on halves of train and validation, both ways, dealt anew each time.

    Encoders are fitted on each half alone; the test part is never read. Fits are
    many short jobs that don't wait for each other: some repeats go on at once.
    """
    pool = data.rows.where("part <> 'test'").drop("part")

    def dealt(repeat: int) -> list[tuple[str, float]]:
        halves = split.stratified(pool, data.label, data.key, 0.5, seed + 101 + repeat).persist()
        told = []
        for one, other in (("train", "test"), ("test", "train")):
            encoders = data.recipe.fit(halves.where(F.col("part") == one))
            sides = {p: encoders.transform(halves.where(F.col("part") == p)).select(data.key, "features", F.col(data.label).cast("double").alias("label")) for p in (one, other)}
            for family in families:
                model = fit(family, sides[one], classes, seed=seed, task=task)
                told.append((family, measured(predicted(model, sides[other], data.key), task).first()["primary"]))
        halves.unpersist()
        return told

    spark = data.rows.sparkSession
    with ThreadPool(min(AT_ONCE, repeats)) as threads:
        told = [t for each in threads.map(inheritable_thread_target(spark)(dealt), range(repeats), 1) for t in each]
    found = spark.createDataFrame(told, "model string, a double").groupBy("model")
    mean = F.avg("a")
    return found.agg(mean.alias("mean"), F.stddev_samp("a").alias("sd"), F.count("a").alias("folds")).orderBy(F.asc("mean") if task == "regression" else F.desc("mean"), "model")


def leak_scores(df: DataFrame, features: list[str], label: str, held: Column, classification: bool = True) -> DataFrame:
    """(column, score, rows): what each column alone says of the label on held-out rows, by the majority or mean of its values in training.

    Numbers are cut into 32 bins of equal size (their edges to one rank in ten
    thousand); missing cells are a value of their own; values that training
    lacks get the whole training part's answer. All columns in one job.
    """
    marked = df.where(F.col(label).isNotNull()).withColumn("_held", held)
    numeric = [c for c in features if cells.is_numeric(df, c)]
    edges = {}
    if numeric:
        known = marked.where(~F.col("_held"))
        sizes = known.agg(*[F.count(cells.number(df, c)).alias(c) for c in numeric]).first()
        shares = {c: [(min(sizes[c] - 1, b * sizes[c] // LEAK_BINS) + 0.5) / max(1, sizes[c]) for b in range(1, LEAK_BINS)] for c in numeric}
        row = known.agg(*[F.percentile_approx(cells.number(df, c), shares[c] if sizes[c] else [0.5], 10_000).alias(c) for c in numeric]).first()
        edges = {c: sorted(set(row[c] or [])) for c in numeric}

    def bucket(c: str) -> Column:
        if c not in edges:
            return F.coalesce(cells.text(df, c), F.lit("\0"))
        x = cells.number(df, c)
        below = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges[c]]), lambda e: e < x)) if edges[c] else F.lit(0)
        return F.coalesce(F.when(x.isNotNull(), below.cast("string")), F.lit("\0"))

    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), bucket(c).alias("bucket")) for c in features]))
    rows = marked.select(F.col(label).alias("y"), "_held", each.alias("f")).select("y", "_held", "f.*")
    train, told = rows.where(~F.col("_held")), rows.where(F.col("_held"))
    if classification:
        counts = train.groupBy("column", "bucket", "y").agg(F.count("*").alias("n"))
        first = F.struct(-F.col("n"), "y")
        guess = counts.groupBy("column", "bucket").agg(F.min_by("y", first).alias("guess"))
        whole = counts.groupBy("column", "y").agg(F.sum("n").alias("n")).groupBy("column").agg(F.min_by("y", first).alias("whole"))
    else:
        guess = train.groupBy("column", "bucket").agg(F.avg("y").alias("guess"))
        whole = train.groupBy("column").agg(F.avg("y").alias("whole"))
    both = told.join(guess, ["column", "bucket"], "left").join(whole, "column").withColumn("p", F.coalesce("guess", "whole"))
    if classification:
        return both.groupBy("column").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("score"), F.count("*").alias("rows"))
    spread = F.var_pop("y")
    r2 = F.when(spread > 0, 1 - F.avg(F.pow(F.col("y") - F.col("p"), 2.0)) / F.when(spread > 0, spread))
    return both.groupBy("column").agg(r2.alias("score"), F.count("*").alias("rows"))


def leak_scan(df: DataFrame, features: list[str], label: str, held: Column, classification: bool = True) -> DataFrame:
    """(column, score) of the columns that alone give the label away."""
    return leak_scores(df, features, label, held, classification).where((F.col("score") >= LEAK_SCORE) & (F.col("rows") >= LEAK_ROWS)).select("column", "score")


def key_candidates(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns that both tables have, in the order of the right one."""
    return [c for c in right.columns if c in left.columns]


@dataclass
class Journal:
    """What a run fell back to; the first twenty notes."""

    notes: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, what: str, subject: str, detail: object) -> None:
        if len(self.notes) < NOTES:
            self.notes.append((what, subject, str(detail)))


def compare_features(a: list[str], b: list[str]) -> dict[str, list[str]]:
    return {"added": sorted(set(b) - set(a)), "removed": sorted(set(a) - set(b)), "kept": sorted(set(a) & set(b))}


def compare_runs(a: DataFrame, b: DataFrame, higher_is_better: bool) -> DataFrame:
    """(place, model, a, b, delta) of two runs' results (model, test), the best of the second run first."""
    both = a.select("model", F.col("test").alias("a")).join(b.select("model", F.col("test").alias("b")), "model", "full")
    value = F.coalesce("b", "a")
    order = -value if higher_is_better else value
    placed = both.select("model", "a", "b", (F.col("b") - F.col("a")).alias("delta"), F.struct(order.alias("o"), "model").alias("_o"))
    every = placed.agg(F.array_sort(F.collect_list("_o")).alias("_all"))  # a row for each model
    return placed.crossJoin(F.broadcast(every)).select(F.array_position("_all", F.col("_o")).cast("int").alias("place"), "model", "a", "b", "delta")
