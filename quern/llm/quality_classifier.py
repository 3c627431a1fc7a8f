"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on labelled documents; every path from a root becomes a
conjunctive rule over statistics (``ratio <= x AND ...``); a logistic regression
with an L1 penalty weighs the rules and drops most of them; what is left is
compiled into one Spark column expression.

The fit uses at most about ``sample`` labelled documents, chosen by a hash of
their id (all of them where there are fewer); scoring covers every whole text.
Only statistics of the text are inputs of a score.

Defined results: null and empty texts have all statistics zero and are scored
by the same rules; repeated rows each give their own row; documents labelled
twice count once, as good if any of their labels says so; null labels and ids
are not learnt from; with labels of one kind or none the score is their mean, or
0.5; a very long text is read whole, in one task; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import stored

FEATURES = (
    "words", "word_length", "longest_word", "symbols", "capitals", "digits", "marks", "distinct", "echoes",
    "top_word", "pairs_repeated", "words_per_line", "lines_repeated", "pipes", "marked_words", "shouted_words",
)
STATS = f"struct<{','.join(f'{name}:double' for name in FEATURES)}>"
THRESHOLD = 0.3
FIT_FILES = 4


def stats(text: str | None) -> tuple[float, ...]:
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    size = sum(map(len, words))
    count = lambda chars: size_without(data, chars)
    times = Counter(words)
    pairs = list(zip(words, words[1:]))  # noqa: B905
    lines = [x for x in data.split(b"\n") if x.strip()]
    symbols = count(b"#*$%&|<>@~^_=+{}[]\\")
    return (
        float(n),
        size / n,
        float(max(map(len, words))),
        symbols / n,
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        count(b"0123456789") / size,
        count(b".,;:!?") / n,
        len(times) / n,
        sum(a == b for a, b in pairs) / n,
        max(times.values()) / n,
        1 - len(set(pairs)) / len(pairs) if pairs else 0.0,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        times[b"|"] / n,
        sum(w[-1] in b"#*$%&|<>" for w in words) / n,
        sum(w[-1] == 33 for w in words) / n,
    )


def size_without(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def stats_of(texts: pa.Array) -> pa.Array:
    rows = [stats(t) for t in texts.to_pylist()]
    columns = zip(*rows) if rows else [[]] * len(FEATURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], names=list(FEATURES))


def text_stats(text: Column | str) -> Column:
    return F.arrow_udf(stats_of, STATS)(text)


@dataclass(frozen=True)
class Rule:
    """Bounds by feature: above low (exclusive), at most high."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self, at: str) -> Column:
        held = F.lit(True)
        for name, low, high in self.bounds:
            if low is not None:
                held = held & (F.col(f"{at}.{name}") > low)
            if high is not None:
                held = held & (F.col(f"{at}.{name}") <= high)
        return held

    def __str__(self) -> str:
        parts = [f"{name} > {low:g}" for name, low, _ in self.bounds if low is not None] + [f"{name} <= {high:g}" for name, _, high in self.bounds if high is not None]
        return " and ".join(parts)


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, at: str) -> Column:
        """The probability of label 1 as an expression over the struct column ``at``."""
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(at), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def paths(tree_text: str) -> list[Rule]:
    """The distinct rules on all root paths of the trees that Spark prints."""
    found: dict[Rule, None] = {}
    held: list[tuple[int, str, float, bool]] = []
    for line in tree_text.splitlines():
        m = re.match(r"(\s*)(If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        held = [h for h in held if h[0] < depth] + [(depth, FEATURES[int(m[3])], float(m[5]), m[4] == ">")]
        bounds: dict[str, list[float | None]] = {}
        for _, name, value, above in held:
            b = bounds.setdefault(name, [None, None])
            if above:
                b[0] = value if b[0] is None else max(b[0], value)
            else:
                b[1] = value if b[1] is None else min(b[1], value)
        found[Rule(tuple((name, low, high) for name, (low, high) in sorted(bounds.items())))] = None
    return list(found)


def labelled_stats(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(s, label) of about ``sample`` labelled documents at most."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    count = known.count()
    share = min(1.0, sample / max(1, count))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 62)) < int(share * (1 << 62)) if share < 1 else F.lit(True)
    chosen = known.where(drawn)  # about `sample` rows of 16 bytes: small enough to broadcast, whatever the corpus
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", text_stats("text").alias("s"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 42) -> RuleEnsemble:
    # A bounded sample: a few files, or each of the fit's jobs is mostly scheduling.
    rows = stored(labelled_stats(docs, labels, sample).orderBy("doc_id").coalesce(FIT_FILES), "labelled-stats")
    kinds, mean = rows.agg(F.count_distinct("label"), F.avg("label")).first()
    if kinds < 2:
        share = min(max(0.5 if mean is None else mean, 0.001), 0.999)
        return RuleEnsemble(math.log(share / (1 - share)), ())
    vector = array_to_vector(F.array(*[F.col(f"s.{name}") for name in FEATURES]))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=10, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=seed)
    rules = paths(forest.fit(rows.select(vector.alias("features"), "label")).toDebugString)
    if not rules:
        return RuleEnsemble(math.log(mean / (1 - mean)), ())
    held = array_to_vector(F.array(*[r.column("s").cast("double") for r in rules]))
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False)
    model = lasso.fit(rows.select(held.alias("features"), "label"))
    weights = model.coefficients.toArray().tolist()
    return RuleEnsemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def scored(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The input with ``score``; one pass, no shuffle."""
    return docs.withColumn("__q_s", text_stats("text")).withColumn("score", model.score("__q_s")).drop("__q_s")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't rejected, in the input's columns."""
    model = fit(docs, labels.where(~held_out()))
    return docs.withColumn("__q_s", text_stats("text")).where(model.score("__q_s") >= threshold).select(*docs.columns)


def op5_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.where(~held_out()))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
