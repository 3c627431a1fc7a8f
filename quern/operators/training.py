"""One training run from a table to a model for production.

Columns are chosen by what they hold, rows split by class, chance, time or group,
every family fitted on the training part, the winner picked by validation and told by
the test, the best ones blended, and the winner fitted anew on all labelled rows.
What was left out or fallen back on stands in the run's journal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import encode, profile, runs

#: Up to how many values a column is made one-hot; more, and it is its rank by frequency.
ONE_HOT_MOST = 12
#: Families of each kind of task, as in ``models``.
FAMILIES = {"classification": ("logistic", "tree", "forest", "mlp"), "regression": ("tree", "forest", "boosting")}
LABEL = "_label"
RESULTS = "model string, validation double, test double"


@dataclass(frozen=True)
class Run:
    """results: (model, validation, test), the baseline and the blend among them; classes: the target's values in the order of their labels."""

    data: runs.Prepared
    task: str
    features: dict[str, list[str]]
    classes: list[str]
    results: DataFrame
    champion: str | None
    blend: runs.Blend | None
    production: PipelineModel | None
    journal: runs.Journal

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """The rows with the winner's class, or value; missing columns are refused by name."""
        if self.production is None:
            raise ValueError("no-champion")
        words = [c for kind in ("words", "wide", "texts") for c in self.features[kind]]
        if gone := [c for c in [*self.features["numeric"], *words] if c not in df.columns]:
            raise ValueError(f"missing-columns:{','.join(gone)}")
        whole = df.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in runs.typed(df, self.features["numeric"], words).items()])
        told = F.col("prediction") if self.task == "regression" else F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int"))
        return self.production.transform(whole).select("_row.*", told.alias(name))


def choose(df: DataFrame, kept_out: set[str], journal: runs.Journal) -> dict[str, list[str]]:
    """Columns by how they are encoded. Identifiers, dates, constant and nearly empty columns are left out and noted."""
    asked = df.select(*[c for c in df.columns if c not in kept_out])
    figures = profile.profile_columns(asked)
    reasons = {r["column"]: r["reason"] for r in profile.exclusions(figures).collect()}  # a row for each column
    distinct = {r["column"]: r["distinct"] for r in figures.select("column", "distinct").collect()}
    kinds = {r["column"]: r["type"] for r in profile.column_types(asked).collect()}
    found: dict[str, list[str]] = {"numeric": [], "words": [], "wide": [], "texts": []}
    for c in asked.columns:
        kind = kinds.get(c)
        if c in reasons or kind in ("id", "date", None):
            journal.add("left-out", c, reasons.get(c) or kind or "unreadable")
        elif kind == "numeric" and cells.is_numeric(df, c):
            found["numeric"].append(c)
        elif kind == "text":
            found["texts"].append(c)
        else:
            found["words" if distinct[c] <= ONE_HOT_MOST else "wide"].append(c)
    return found


def with_baseline(data: runs.Prepared, task: str) -> DataFrame:
    """(baseline, validation, test): the most frequent class of the training part, the least of equals, or its mean."""
    train = data.rows.where("part = 'train'")
    label = F.col(data.label).cast("double")
    if task == "regression":
        says = train.agg(F.avg(label)).first()[0]
    else:
        row = train.groupBy(label.alias("y")).agg(F.count("*").alias("n")).agg(F.min_by("y", F.struct(-F.col("n"), "y"))).first()
        says = row[0]
    told = data.rows.select("part", label.alias("label"), F.lit(says).cast("double").alias("predicted"))
    scores = [runs.measured(told.where(F.col("part") == p), task).select(F.col("primary").alias(p)) for p in ("validation", "test")]
    return scores[0].crossJoin(F.broadcast(scores[1])).select(F.lit("baseline").alias("model"), "validation", "test")  # one row each


def train(df: DataFrame, target: str, key: str, families: list[str] | None = None, by: str = "class", column: str | None = None, leave_out: list[str] | None = None, seed: int = 42) -> Run:
    """A run on all labelled rows. Where the target is neither classes nor a number it is refused by name."""
    journal = runs.Journal()
    found = encode.task_of(df, target).first()["task"]
    if found == "none":
        raise ValueError(f"no-task:{target}")
    task = "regression" if found == "regression" else "classification"
    classes: list[str] = []
    if task == "regression":
        label = cells.number(df, target)
        by = "random" if by == "class" else by
    else:
        value = cells.text(df, target)
        classes = sorted(r[0] for r in df.select(value.alias("v")).where("v IS NOT NULL").distinct().collect())  # twenty at most
        label = F.array_position(F.array(*[F.lit(c) for c in classes]), value) - 1
    rows = df.withColumn(LABEL, label.cast("double"))
    lost = rows.agg(F.count_if(F.col(LABEL).isNull())).first()[0]
    if lost:
        journal.add("unlabelled", target, lost)
    features = choose(df, {target, key, *(leave_out or []), *([column] if column else [])}, journal)
    if not any(features.values()):
        raise ValueError("no-features")
    data = runs.prepare(rows, features["numeric"], features["words"], LABEL, key, seed, by, column, features["wide"], features["texts"])
    parts = {r["part"] for r in data.rows.select("part").distinct().collect()}
    journal.add("split", by, "+".join(sorted(parts)))
    results, models = [tuple(with_baseline(data, task).first())], {}
    held = {p: data.part(p) for p in ("validation", "test")}
    for family in families or FAMILIES[task]:
        model = runs.fit(family, data.part("train"), max(2, len(classes)), seed=seed, task=task)
        told = {p: runs.predicted(model, some, key) for p, some in held.items()}
        results.append((family, *[runs.measured(told[p], task).first()["primary"] for p in ("validation", "test")]))
        models[family] = (model, "probability" in told["test"].columns)
    spark = df.sparkSession
    table = spark.createDataFrame(results, RESULTS)
    higher = task == "classification"
    blend = runs.plan_blend(table, higher, {f for f, (_, shares) in models.items() if shares}, task)
    if blend:
        results.append(("blend", *[blended_score(blend, models, held[p], key, task) for p in ("validation", "test")]))
        table = spark.createDataFrame(results, RESULTS)
    else:
        journal.add("no-blend", "", "fewer than two models have a validation score")
    best = runs.champion_gap(table.where("model NOT IN ('baseline', 'blend')"), higher).first()
    if best is None:
        journal.add("no-champion", "", "too few rows for a validation part")
        return Run(data, task, features, classes, table, None, blend, None, journal)
    base = results[0][1]
    if (best["validation"] <= base) if higher else (best["validation"] >= base):
        journal.add("no-better-than-baseline", best["model"], base)
    production = runs.refit(best["model"], data, max(2, len(classes)), seed=seed, task=task)
    return Run(data, task, features, classes, table, best["model"], blend, production, journal)


def blended_score(blend: runs.Blend, models: dict[str, tuple[PipelineModel, bool]], rows: DataFrame, key: str, task: str) -> float | None:
    """The primary figure of the members' common answer; each adds a column to the same rows."""
    told, members = rows, []
    for i, name in enumerate(blend.members):
        model = models[name][0]
        column: Column = runs.vector_to_array("probability") if blend.method == "probability" else F.col("prediction")
        told = model.transform(told).withColumn(f"_m{i}", column).select(*told.columns, f"_m{i}")
        members.append(F.col(f"_m{i}"))
    answer = runs.blended(blend.method, members).cast("double")
    return runs.measured(told.select(key, "label", answer.alias("predicted")), task).first()["primary"]
