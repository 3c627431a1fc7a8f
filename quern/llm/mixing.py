"""Mixing sources to target weights: temperature mixing in budgeted block permutations.

1. A source's share p of all tokens becomes the weight p^a, normalised. The
   exponent a lies between 0 (all sources alike) and 1 (as they are).
2. a is bisected: to the largest whose entropy is at least ``target_entropy``
   (as a share of the greatest possible), or to the least (flattest) at which no
   source is repeated more than ``repetition_limit`` times.
3. The weights become token budgets. Without a given budget it is the least one
   that shows every document once.
4. A source's documents are permuted by the MD5 of (seed, doc_id) and read
   round after round until the budget is used up. A document's place in its
   source's reading, as a share of the budget, is its place in the mix; equal
   slices of that are blocks, so that every block holds all sources by weight.
   Within a block, ``place`` orders the copies by another MD5.

A source may hold most of the corpus: its running token sum is taken per MD5
bucket (4096 of them) and the buckets' sums are added up first, so that no
window spans a source. The bisection makes one job of four halvings; it reads
one row for each source. Built-in functions only.

Defined results: a null source counts as the source of empty name; null and
empty texts have no tokens: they take no budget and come along where they fall;
a source without tokens has weight 0 and is left out; rows of one id are ordered
by a hash of their text, repeated rows are used as often as they are there; null ids are
one id; an empty table gives an empty mix; a very long text is split whole, in
one task. Other columns are carried along, but those that are named like an added
one (``prefix`` sets the added ones apart).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored, words_of

HALVINGS, AT_ONCE = 40, 4


def source_name() -> Column:
    return F.coalesce("source", F.lit(""))


def token_count() -> Column:
    return F.size(words_of(F.col("text"))).cast("long")


def exponent(shares: DataFrame, target_entropy: float | None, repetition_limit: float | None, budget_ratio: float | None) -> float:
    """The bisected exponent. ``shares``: (p > 0); budget_ratio: budget over corpus tokens, None for the least full one."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give a target entropy or a repetition limit")
    n, p = F.count("*"), F.col("p")

    def steep_enough(a: float) -> Column:
        """Whether a is on the side of the bisection that keeps the condition."""
        z = F.sum(F.pow(p, F.lit(a)))
        if target_entropy is not None:
            entropy = F.log(z) - a * F.sum(F.pow(p, F.lit(a)) * F.log(p)) / z
            return entropy < target_entropy * F.log(n.cast("double"))
        most = F.max(F.pow(p, F.lit(a - 1)))
        repeats = most * F.max(F.pow(p, F.lit(1 - a))) if budget_ratio is None else budget_ratio * most / z
        return repeats <= repetition_limit

    low, high = 0.0, 1.0
    for _ in range(HALVINGS // AT_ONCE):
        step = (high - low) / 2**AT_ONCE
        points = [low + i * step for i in range(1, 2**AT_ONCE)]
        told = shares.agg(*[steep_enough(a).alias(f"a{i}") for i, a in enumerate(points)]).first()
        first = next((i for i in range(len(points)) if told[i]), len(points))
        low, high = low + first * step, low + (first + 1) * step
    return low if target_entropy is not None else high


def mixed(
    docs: DataFrame,
    target_entropy: float | None = None,
    repetition_limit: float | None = 2.0,
    budget: int | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 42,
    prefix: str = "",
) -> DataFrame:
    """The input's rows once for each copy in the mix, with n_tokens, epoch, block and place (their names behind ``prefix``)."""
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    marked = docs.withColumns({"__q_source": source_name(), "__q_tokens": token_count(), "__q_order": order}).withColumn("__q_bucket", F.substring("__q_order", 1, 3))
    buckets = marked.groupBy(F.col("__q_source").alias("s"), F.col("__q_bucket").alias("b")).agg(F.sum("__q_tokens").alias("tokens"))
    buckets = stored(buckets, "mix-buckets")
    sources = stored(buckets.groupBy("s").agg(F.sum("tokens").alias("total")).where("total > 0"), "mix-sources")
    corpus = sources.agg(F.sum("total")).first()[0]
    if not corpus:
        nothing = {"n_tokens": F.lit(0).cast("long"), "epoch": F.lit(0).cast("long"), "block": F.lit(0).cast("long"), "place": F.lit("")}
        return docs.where("false").withColumns({prefix + c: x for c, x in nothing.items()})

    shares = sources.withColumn("p", F.col("total") / F.lit(float(corpus)))
    a = exponent(shares, target_entropy, repetition_limit, None if budget is None else budget / corpus)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max(F.pow("p", F.lit(1 - a)))).first()
    whole = float(budget) if budget is not None else corpus * z * most
    plan = shares.select("s", "total", F.round(F.pow("p", F.lit(a)) / F.lit(z) * F.lit(whole)).cast("long").alias("budget"))
    before = F.sum("tokens").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    starts = buckets.withColumn("start", F.coalesce(before, F.lit(0))).join(plan, "s")
    starts = starts.select(F.col("s").alias("__q_source"), F.col("b").alias("__q_bucket"), *[F.col(c).alias(f"__q_{c}") for c in ("start", "total", "budget")])
    starts = stored(starts, "mix-starts").hint("merge")  # the rows lie by source and bucket already

    within = F.sum("__q_tokens").over(Window.partitionBy("__q_source", "__q_bucket").orderBy("__q_order", "doc_id", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1))
    placed = marked.withColumn("__q_within", F.coalesce(within, F.lit(0))).join(starts, ["__q_source", "__q_bucket"])
    placed = placed.withColumn("__q_at", F.col("__q_start") + F.col("__q_within"))
    copies = F.expr("greatest(__q_budget - __q_at + __q_total - 1, 0L) div __q_total")
    n_blocks = max(1, math.ceil(whole / block_tokens))
    read = placed.where(copies > 0).withColumn("__q_epoch", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    share = (F.col("__q_epoch") * F.col("__q_total") + F.col("__q_at")).cast("double") / F.col("__q_budget").cast("double")
    block = F.least(F.floor(share * F.lit(float(n_blocks))), F.lit(n_blocks - 1)).cast("long")
    read = read.withColumn("__q_block", block)
    added = {"n_tokens": F.col("__q_tokens"), "epoch": F.col("__q_epoch"), "block": F.col("__q_block"), "place": F.md5(F.concat_ws(":", "__q_order", "__q_epoch", "__q_block"))}
    return read.select(*[c for c in docs.columns if c not in {prefix + a for a in added}], *[x.alias(prefix + c) for c, x in added.items()])


def op6_mixing(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "epoch", "block", "place")


ORACLE_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, text, coalesce(source, '') AS s, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o,
  CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n FROM documents),
src AS (SELECT s, CAST(sum(n) AS BIGINT) AS total FROM d GROUP BY s HAVING sum(n) > 0),
sh AS (SELECT s, total, total / CAST((SELECT sum(total) FROM src) AS DOUBLE) AS p FROM src),
ps AS (SELECT list(p) AS l, CAST(sum(total) AS DOUBLE) AS corpus FROM sh),
bis(i, lo, hi) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM
  (SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_max(list_transform(l, lambda x: pow(x, (lo + hi) / 2 - 1))) * list_max(list_transform(l, lambda x: pow(x, 1 - (lo + hi) / 2))) <= 2 AS ok FROM bis, ps WHERE i < 40)),
e AS (SELECT hi AS a FROM bis WHERE i = 40),
t AS (SELECT a, corpus * list_sum(list_transform(l, lambda x: pow(x, a))) * list_max(list_transform(l, lambda x: pow(x, 1 - a))) AS whole, list_sum(list_transform(l, lambda x: pow(x, a))) AS z FROM e, ps),
plan AS (SELECT s, total, CAST(round(pow(p, a) / z * whole) AS BIGINT) AS budget, ceil(whole / 1000000) AS blocks FROM sh, t),
pl AS (SELECT d.*, total, budget, blocks, coalesce(sum(n) OVER (PARTITION BY s ORDER BY o, doc_id, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN plan USING (s)),
c AS (SELECT *, unnest(range(0, CAST(greatest(budget - start + total - 1, 0) // total AS BIGINT))) AS epoch FROM pl),
r AS (SELECT *, CAST(least(floor(CAST(epoch * total + start AS DOUBLE) / budget * blocks), blocks - 1) AS BIGINT) AS block FROM c)
SELECT doc_id, source, n AS n_tokens, epoch, block, md5(o || ':' || epoch || ':' || block) AS place FROM r
"""
