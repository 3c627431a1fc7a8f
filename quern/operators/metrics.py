"""Metrics and curves over tables of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.ordering import running

CLIP = 1e-15


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n) of the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def macro_prf(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row (precision, recall, f1): means over the classes in truth or prediction; 0 where undefined."""
    pairs = confusion(df, truth, predicted)  # classes squared at most from here on
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    each = F.explode(F.array(F.struct(F.col("truth").alias("c"), F.lit(1).alias("t")), F.struct(F.col("predicted").alias("c"), F.lit(0).alias("t"))))
    classes = pairs.select("n", hit.alias("hit"), each.alias("s")).groupBy("s.c").agg(
        F.sum(F.when(F.col("s.t") == 1, F.col("hit"))).alias("tp"), F.sum(F.when(F.col("s.t") == 1, F.col("n"))).alias("actual"), F.sum(F.when(F.col("s.t") == 0, F.col("n"))).alias("called")
    )
    tp = F.coalesce("tp", F.lit(0))
    p, r = F.coalesce(F.try_divide(tp, F.col("called")), F.lit(0.0)), F.coalesce(F.try_divide(tp, F.col("actual")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return classes.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def log_loss(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Binary log-loss of the probability of class 1."""
    p = F.least(F.greatest(F.col(score), F.lit(CLIP)), F.lit(1 - CLIP))
    return df.agg((-F.avg(F.when(F.col(truth) == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"))


def by_score(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, pos, neg): counts per distinct score, taken per task first; what curves run over."""
    hit = F.col(truth) == 1
    return df.groupBy(F.col(score).alias("score")).agg(F.count_if(hit).alias("pos"), F.count_if(~hit).alias("neg"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Ties count half; null where a class is absent."""
    s = running(by_score(df, truth, score), ["score"], {"upto": "neg"})
    won = F.col("pos") * (F.col("upto") - F.col("neg") / 2)
    return s.agg(F.try_divide(F.sum(won), F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def cumulative(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, hits, tp, fp, pos, neg) at each distinct score, from the highest; ``hits`` are those at the score itself."""
    s = by_score(df, truth, score)
    whole = s.agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    run = running(s, [F.desc("score")], {"tp": "pos", "fp": "neg"})
    return run.crossJoin(F.broadcast(whole)).select("score", F.col("pos").alias("hits"), "tp", "fp", F.col("_pos").alias("pos"), F.col("_neg").alias("neg"))  # whole is one row


def pr_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    return cumulative(df, truth, score).select("score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.col("tp"), F.col("pos")).alias("recall"))


def average_precision(df: DataFrame, truth: str, score: str) -> DataFrame:
    precision, step = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide(F.col("hits"), F.col("pos"))
    return cumulative(df, truth, score).agg(F.sum(precision * step).alias("average_precision"))


def best_threshold(df: DataFrame, truth: str, score: str, miss: float = 5.0, alarm: float = 1.0) -> DataFrame:
    """(threshold, cost): the cut with the least cost of misses and false alarms, the highest of equals."""
    cost = (F.col("pos") - F.col("tp")) * miss + F.col("fp") * alarm
    found = cumulative(df, truth, score).select(F.col("score").alias("threshold"), cost.alias("cost"))
    return found.orderBy("cost", F.desc("threshold")).limit(1)


def calibration(df: DataFrame, truth: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, share): equal bins of the score."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg((F.col(truth) == 1).cast("double")).alias("share"))


def brier(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - (F.col(truth) == 1).cast("double"), 2.0)).alias("brier"))


def regression(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(rmse, mae, r2); r2 of a constant truth is 1 for a perfect prediction, else 0."""
    e = F.col(truth) - F.col(predicted)
    sums = df.agg(F.avg(e * e).alias("m"), F.avg(F.abs(e)).alias("mae"), F.var_pop(truth).alias("v"))
    r2 = F.when(F.col("v") > 0, 1 - F.col("m") / F.when(F.col("v") > 0, F.col("v"))).otherwise(F.when(F.col("m") == 0, 1.0).otherwise(0.0))
    return sums.select(F.sqrt("m").alias("rmse"), "mae", r2.alias("r2"))


def residuals(df: DataFrame, truth: str, predicted: str, bins: int = 12) -> DataFrame:
    from quern.operators.profile import histogram

    return histogram(df.select((F.col(truth) - F.col(predicted)).alias("residual")), "residual", bins)


def rank_models(results: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """Results with ``place``: the validation metric ranks; names break ties."""
    order = F.desc(metric) if higher_is_better else F.asc(metric)
    return results.withColumn("place", F.row_number().over(Window.orderBy(order, "model")))  # a row for each model


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    raised = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def argmax(values: Column) -> Column:
    """The place of the greatest, from 0, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
