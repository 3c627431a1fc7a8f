"""Quality rules with risk-controlled thresholds.

Base rules are fixed (too few words, too much repetition). Beyond them, each
ratio of ``RATIOS`` may reject from some cutoff on, and the cutoffs aren't chosen
by hand. All ratios are tightened together, along a path that is fixed before
any label is seen: ``LEVELS`` nested sets of cutoffs, from loose to tight.
Labelled good documents are the holdout, equal texts counted once, and per
stratum the tightest level is taken whose false rejection rate, by all ratios
together, is at most ``risk`` by an exact binomial test (the one behind
Clopper-Pearson bounds). The path is tested from loose to tight and stops at the
first level that isn't proven (a fixed sequence, which spends its level once);
``delta`` is divided by the number of strata that are tested (Bonferroni). Which
strata are tested depends on how many labels they have, not on what these say:
those that could prove a level without any false rejection. The others get no
cutoffs: nothing is rejected there on the method's account. So with probability
1 - delta no stratum loses more than ``risk`` of its good documents.

Defined results: a null text has no words and fails the base rules; repeated
rows each give their own row; a null stratum is a stratum of its own; documents
labelled twice count once, as good if any of their labels says so; without
labels only the base rules act; a very long text is counted whole, in one task;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import BLANKS, stored

STATS = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
BLANK_BYTES = BLANKS.encode()

#: Of each ratio the side that is rejected and the cutoffs of the first and the last level.
RATIOS = {
    "symbols_per_word": (">", 3.0, 0.1),
    "repeat_share": (">", 0.5, 0.2),
    "dup_lines_per_100_words": (">", 20.0, 2.0),
    "long_words": (">", 20.0, 8.0),
    "short_words": ("<", 1.5, 3.0),
}
LEVELS = 60


def path(name: str) -> list[float]:
    """The cutoffs of a ratio, level by level, in equal proportions."""
    _, loose, tight = RATIOS[name]
    return [round(loose * (tight / loose) ** (i / (LEVELS - 1)), 6) for i in range(LEVELS)]


def repeated(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:]))  # noqa: B905
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    total = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + 3 - max(i, end)
            end = i + 3
    return total


def stats_of(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        data = (text or "").encode()
        words = data.split()  # bytes split at space and \t \n \v \f \r only
        points = len(text or "") - sum(map(data.count, (BLANK_BYTES[i : i + 1] for i in range(6))))
        symbols = len(data) - len(data.translate(None, SYMBOLS.encode()))
        lines = [x for x in data.split(b"\n") if x.strip(BLANK_BYTES)]
        rows.append((len(words), points, symbols, len(lines) - len(set(lines)), repeated(words)))
    columns = zip(*rows) if rows else [[]] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))


def text_stats(text: Column | str) -> Column:
    return F.arrow_udf(stats_of, STATS)(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratios(df: DataFrame) -> dict[str, Column]:
    n = F.greatest(df["n_words"], F.lit(1)).cast("double")
    return {
        "symbols_per_word": df["n_symbols"] / n,
        "repeat_share": df["n_repeat_words"] / n,
        "dup_lines_per_100_words": 100 * df["n_dup_lines"] / n,
        "long_words": df["word_chars"] / n,
        "short_words": df["word_chars"] / n,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n trials of probability p, summed from the largest term until terms vanish."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    if k > n * p:  # the upper tail is the short one
        total, term, i = 0.0, math.exp(log(k + 1)), k + 1
        while i <= n and term > total * 1e-17:
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        return max(0.0, 1.0 - total)
    total, term, i = 0.0, math.exp(log(k)), k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, total)


def exact_upper_bound(k: int, n: int, level: float) -> float:
    """The Clopper-Pearson upper bound of a share of k in n, by bisection of the exact tail."""
    low, high = k / n if n else 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and binomial_tail(k, n, mid) > level else (low, mid)
    return high


def labels_needed(risk: float, level: float) -> int:
    """So many good documents, none of them rejected, prove the risk at the level."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def least_tested(sizes: list[tuple[int, int]], risk: float, delta: float) -> tuple[int, int]:
    """(labels that a tested stratum has at least, tested strata). ``sizes``: (labels, strata that have so many)."""
    best, tested = (0, 0), 0
    for n, strata in sorted(sizes, reverse=True):
        tested += strata
        if n >= labels_needed(risk, delta / tested):
            best = (n, tested)
    return best


def cutoffs(holdout: DataFrame, risk: float, delta: float) -> DataFrame:
    """(stratum, <ratio>...): the cutoffs of each tested stratum, null where no level is proven.

    ``holdout``: (stratum, ratios) of the labelled good documents. They are
    counted per stratum and level before anything is shuffled; only counts
    reach the tests.
    """
    fails = []
    for name, (side, _, _) in RATIOS.items():
        edges = F.array(*[F.lit(x) for x in path(name)])
        failed = F.filter(edges, lambda e: F.col(name) > e) if side == ">" else F.filter(edges, lambda e: F.col(name) < e)  # noqa: B023
        fails.append(F.lit(LEVELS) - F.size(failed))  # levels are nested: the first that rejects says all
    counted = holdout.select("stratum", F.least(*fails).alias("first")).groupBy("stratum", "first").agg(F.count("*").alias("k"))
    # At most one entry for each level.
    strata = stored(counted.groupBy("stratum").agg(F.sum("k").alias("n"), F.collect_list(F.struct("first", "k")).alias("at")), "strata")
    enough = strata.where(F.col("n") >= labels_needed(risk, delta)).groupBy("n").agg(F.count("*").alias("strata"))
    least, tested = least_tested([(r["n"], r["strata"]) for r in enough.collect()], risk, delta)

    @F.arrow_udf("int")
    def tightest(at: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for counts, size in zip(at.to_pylist(), n.to_pylist(), strict=True):
            failed, best, by_first = 0, None, {x["first"]: x["k"] for x in counts}
            for i in range(LEVELS):
                failed += by_first.get(i, 0)
                if binomial_tail(failed, size, risk) > delta / tested:
                    break  # the sequence ends here: tighter levels aren't tested
                best = i
            out.append(best)
        return pa.array(out, pa.int32())

    proven = strata.where(F.col("n") >= least if tested else F.lit(False)).select("stratum", tightest("at", "n").alias("level"))
    return proven.select("stratum", *[F.get(F.array(*[F.lit(x) for x in path(name)]), F.col("level")).alias(name) for name in RATIOS])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(doc_id, counts, base_failed, kept), one row for each input row.

    Texts are read once and only by the counting function; what is stored,
    joined and shuffled are counts.
    """
    counted = docs.select("doc_id", F.col(stratum).alias("stratum"), F.xxhash64("text").alias("same"), text_stats("text").alias("s")).select("doc_id", "stratum", "same", "s.*")
    counted = stored(counted, "quality-counts")
    counted = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    scored = counted.select("doc_id", "stratum", "same", "base_failed", *[c.alias(k) for k, c in ratios(counted).items()])
    holdout = scored.where(~F.col("base_failed")).join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "same"])
    rules = stored(cutoffs(holdout, risk, delta).withColumnRenamed("stratum", "of"), "quality-cutoffs")
    measured = counted.join(rules, F.col("stratum").eqNullSafe(F.col("of")), "left")
    values = ratios(counted)
    rejects = [F.coalesce((values[name] > measured[name]) if side == ">" else (values[name] < measured[name]), F.lit(False)) for name, (side, _, _) in RATIOS.items()]
    rejected = rejects[0]
    for r in rejects[1:]:
        rejected = rejected | r
    return measured.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))


def op10_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs, labels)
