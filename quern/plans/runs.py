"""Training runs: preparation, rankings, blends, leaks and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import cluster, runs, scoring, training
from quern.plans.modelling import _DIMS, _SCORED, labelled, scored, vectors
from quern.plans.registry import Tables, query

_MODELS = {"early": "s >= 0.3", "middle": "s >= 0.5", "late": "s >= 0.7", "given": "c = 1"}
_RESULTS = "res AS (" + " UNION ALL ".join(f"SELECT '{name}' AS model, avg(CAST((y = 1) = ({told}) AS DOUBLE)) FILTER (doc_id % 2 = 0) AS validation, avg(CAST((y = 1) = ({told}) AS DOUBLE)) FILTER (doc_id % 2 = 1) AS test FROM p" for name, told in _MODELS.items()) + ")"


def results(t: Tables) -> DataFrame:
    df = scored(t)
    right = lambda told, odd: F.avg(F.when(F.col("doc_id") % 2 == odd, ((F.col("y") == 1) == F.expr(told)).cast("double")))
    parts = [df.agg(right(told, 0).alias("validation"), right(told, 1).alias("test")).select(F.lit(name).alias("model"), "validation", "test") for name, told in _MODELS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("run_champion_gap", f"WITH {_SCORED}, {_RESULTS} SELECT model, round(validation, 6) AS validation, round(test, 6) AS test, round(test - validation, 6) AS gap FROM res ORDER BY validation DESC, model LIMIT 1")
def run_champion_gap(t: Tables):
    return runs.champion_gap(results(t), True)


@query(
    "run_compare",
    f"""WITH {_SCORED}, {_RESULTS}, a AS (SELECT model, test FROM res WHERE model <> 'late'), b AS (SELECT model, validation AS test FROM res WHERE model <> 'early'),
    m AS (SELECT model, a.test AS a, b.test AS b, coalesce(b.test, a.test) AS v FROM a FULL JOIN b USING (model))
    SELECT CAST(row_number() OVER (ORDER BY v DESC, model) AS INTEGER) AS place, model, round(a, 6) AS a, round(b, 6) AS b, round(b - a, 6) AS delta FROM m""",
)
def run_compare(t: Tables):
    r = results(t)
    return runs.compare_runs(r.where("model <> 'late'"), r.where("model <> 'early'").select("model", F.col("validation").alias("test")), True)


@query(
    "ml_vote",
    f"""WITH {_SCORED}, v AS (SELECT doc_id, CAST(c AS INTEGER) AS a, CAST(s >= 0.3 AS INTEGER) AS b, CAST(CASE WHEN s >= 0.7 THEN 2 ELSE s >= 0.5 END AS INTEGER) AS d FROM p)
    SELECT doc_id, CASE WHEN b = d THEN b ELSE a END AS predicted FROM v""",
)
def ml_vote(t: Tables):
    df = scored(t)
    third = F.when(F.col("s") >= 0.7, 2).otherwise((F.col("s") >= 0.5).cast("int"))
    return df.select("doc_id", runs.blended("vote", [F.col("c").cast("int"), (F.col("s") >= 0.3).cast("int"), third]).alias("predicted"))


_LEAK = f"""WITH {_SCORED}, r AS (SELECT p.*, 'k' || quality AS told, source, doc_id % 5 = 0 AS held FROM p JOIN documents USING (doc_id) JOIN labels USING (doc_id)),
 e AS (SELECT 'source' AS "column", coalesce(source, chr(0)) AS b, y, held FROM r UNION ALL SELECT 'told', told, y, held FROM r),
 n AS (SELECT "column", b, y, count(*) AS n FROM e WHERE NOT held GROUP BY ALL), g AS (SELECT "column", b, arg_min(y, (-n, y)) AS g FROM n GROUP BY ALL), w AS (SELECT "column", arg_min(y, (-n, y)) AS w FROM (SELECT "column", y, sum(n) AS n FROM n GROUP BY ALL) GROUP BY 1),
 s AS (SELECT "column", avg(CAST(y = coalesce(g, w) AS DOUBLE)) AS score, count(*) AS rows FROM e LEFT JOIN g USING ("column", b) JOIN w USING ("column") WHERE held GROUP BY 1)"""


def leaking(t: Tables) -> DataFrame:
    return labelled(t).withColumn("told", F.concat(F.lit("k"), F.col("quality").cast("string")))


@query("leak_scores", f'{_LEAK} SELECT "column", round(score, 6) AS score, rows FROM s')
def leak_scores(t: Tables):
    return runs.leak_scores(leaking(t), ["source", "told"], "quality", F.col("doc_id") % 5 == 0)


@query("leak_scan", f'{_LEAK} SELECT "column", round(score, 6) AS score FROM s WHERE score >= 0.99 AND rows >= 20')
def leak_scan(t: Tables):
    return runs.leak_scan(leaking(t), ["source", "told"], "quality", F.col("doc_id") % 5 == 0)


@query(
    "cluster_traits_words",
    """WITH o AS (SELECT o_orderstatus AS k, o_orderpriority, strftime(o_orderdate, '%m') AS month FROM orders), e AS (SELECT k, 'o_orderpriority' AS "column", o_orderpriority AS value FROM o UNION ALL SELECT k, 'month', month FROM o),
    c AS (SELECT k, "column", value, count(*) AS n FROM e GROUP BY ALL), w AS (SELECT "column", value, sum(n) AS n FROM c GROUP BY ALL), t AS (SELECT k, "column", sum(n) AS n FROM c GROUP BY ALL), a AS (SELECT "column", sum(n) AS n FROM t GROUP BY 1),
    s AS (SELECT k, "column", value, c.n / t.n AS share, w.n / a.n AS overall FROM c JOIN t USING (k, "column") JOIN w USING ("column", value) JOIN a USING ("column")),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY k, "column" ORDER BY abs(share - overall) DESC, value) = 1)
    SELECT k AS o_orderstatus, "column", value, round(share, 6) AS share, round(overall, 6) AS overall, CAST(row_number() OVER (PARTITION BY k ORDER BY abs(share - overall) DESC, "column") AS INTEGER) AS rank FROM b""",
)
def cluster_traits_words(t: Tables):
    return cluster.categorical_traits(t.orders.withColumn("month", F.date_format("o_orderdate", "MM")), "o_orderstatus", ["o_orderpriority", "month"])


@query("cluster_choose")
def cluster_choose(t: Tables):
    """k-means has no SQL; tests hold the choice against clusters that are there."""
    return cluster.choose_kmeans(t.embeddings, "vec_id", "embedding")[1]


@query("pca_project")
def pca_project(t: Tables):
    return cluster.project(vectors(t), "vec_id", [f"x{i}" for i in range(_DIMS)])


def prepared(t: Tables) -> runs.Prepared:
    df = t.part.withColumn("dear", (F.col("p_retailprice") > 950).cast("int"))
    return runs.prepare(df.withColumn("shelf", F.col("p_partkey") % 97), ["p_size", "shelf"], ["p_brand"], "dear", "p_partkey")


@query("run_prepare")
def run_prepare(t: Tables):
    """Rows of each part and class: the split is SQL's too (``split_stratified``), the encoders aren't."""
    return prepared(t).rows.groupBy("part", "dear").agg(F.count("*").alias("n"))


@query("run_leaderboard")
def run_leaderboard(t: Tables):
    return runs.leaderboard(prepared(t), ["logistic", "tree"])


@query("run_robust_rank")
def run_robust_rank(t: Tables):
    return runs.robust_rank(prepared(t), ["logistic", "tree"])


@query("run_learning_curve")
def run_learning_curve(t: Tables):
    """Six sizes of the training part, each with its interval, and whether the last step still gained."""
    return scoring.family_curve(prepared(t), "tree")


@query("run_train")
def run_train(t: Tables):
    """Whether an order is urgent, from its own columns and its customer's, split by time: every family, the baseline and the blend."""
    df = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal"), "o_custkey").withColumn("urgent", F.col("o_orderpriority").startswith("1").cast("int"))
    return training.train(df.drop("o_orderpriority", "o_custkey"), "urgent", "o_orderkey", ["logistic", "tree"], "time", "o_orderdate").results


@query(
    "split_parts_time",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders), c AS (SELECT *, n - round(n * 0.2) AS rest FROM r)
    SELECT o_orderkey, CASE WHEN k > rest THEN 'test' WHEN k > rest - round(rest * 0.2) THEN 'validation' ELSE 'train' END AS part FROM c""",
)
def split_parts_time(t: Tables):
    return runs.parted(t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", "o_orderkey", "time", "o_orderdate").select("o_orderkey", "part")
