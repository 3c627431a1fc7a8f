"""Batch scoring, production checks and explanations."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from quern.operators import encode, models, scoring
from quern.plans.cleaning import _EDGES, _SIDES, halves
from quern.plans.modelling import _DIMS, _SCORED, scored, vectors
from quern.plans.registry import Tables, query

FEATURES = ["l_quantity", "l_discount", "l_tax"]
MODEL = models.Linear(tuple(FEATURES), (1000.0, -5.0, 2.5), 10.0)


@query("score_predict", "SELECT l_orderkey, l_linenumber, round(10 + 1000 * l_quantity - 5 * l_discount + 2.5 * l_tax, 6) AS predicted FROM lineitem")
def score_predict(t: Tables):
    return scoring.predict_batch(t.lineitem, FEATURES, scoring.linear_predictor(MODEL)).select("l_orderkey", "l_linenumber", "predicted")


@query("score_batch", f"WITH {_SCORED} SELECT count(*) AS rows, count(*) FILTER (doc_id % 7 <> 0) AS labelled, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 11 = 0) AS unknown, round(avg(CAST(y = c AS DOUBLE)) FILTER (doc_id % 7 <> 0 AND doc_id % 11 <> 0), 6) AS accuracy FROM p")
def score_batch(t: Tables):
    truth = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 11 == 0, 9).otherwise(F.col("y"))
    return scoring.score_batch(scored(t).withColumn("t", truth), "t", "c", [0, 1])


@query("score_what_if", "SELECT l_orderkey, l_linenumber, round(10 + 1000 * l_quantity - 5 * l_discount + 2.5 * l_tax, 6) AS predicted, round(10 + 1000 * 7 - 5 * l_discount + 2.5 * l_tax, 6) AS changed FROM lineitem")
def score_what_if(t: Tables):
    return scoring.what_if(t.lineitem, FEATURES, scoring.linear_predictor(MODEL), {"l_quantity": 7}).select("l_orderkey", "l_linenumber", "predicted", "changed")


@query(
    "explain_shapley",
    """WITH r AS (SELECT p_size, p_retailprice FROM part ORDER BY md5('42:' || p_partkey), p_partkey LIMIT 24), m AS (SELECT avg(p_size) AS a, avg(p_retailprice) AS b FROM r)
    SELECT p_partkey, 'p_size' AS feature, round(3 * (p_size - a), 6) AS share FROM part, m UNION ALL SELECT p_partkey, 'p_retailprice', round(0.5 * (p_retailprice - b), 6) FROM part, m""",
)
def explain_shapley(t: Tables):
    model = models.Linear(("p_size", "p_retailprice"), (3.0, 0.5), 1.0)
    return scoring.shapley(t.part, "p_partkey", ["p_size", "p_retailprice"], scoring.linear_predictor(model))


@query(
    "explain_words",
    "WITH k AS (SELECT list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: len(w) >= 3) AS w FROM part), v AS (SELECT unnest(list_distinct(w)) AS term, w FROM k), t AS (SELECT term FROM v GROUP BY term ORDER BY count(*) DESC, term LIMIT 3) SELECT term AS word, count(*) AS rows, round(avg(-CAST(len(list_filter(w, lambda x: x = term)) AS DOUBLE)), 6) AS shift FROM v JOIN t USING (term) GROUP BY term",
)
def explain_words(t: Tables):
    from quern.functions.cells import tokens
    from quern.plans.modelling import part_texts

    df = part_texts(t)
    top = [r["term"] for r in encode.tfidf_vocabulary(df, "words", 3).collect()]
    return scoring.word_effects(df.select(tokens(F.col("words")).alias("w")), "w", top, lambda w: F.size(w).cast("double"))


def _measured() -> str:
    """(column, kind, psi) of the price, the month, the status and the priority, in SQL."""
    psi = "round(sum((greatest(coalesce(q, 0), 1e-4) - greatest(coalesce(p, 0), 1e-4)) * ln(greatest(coalesce(q, 0), 1e-4) / greatest(coalesce(p, 0), 1e-4))), 6)"
    side = lambda x, of, name: f"(SELECT {x} AS bin, count(*) / (SELECT count(*) FROM {of}) AS {name} FROM {of}, e GROUP BY 1)"
    found = {"o_totalprice": ("numeric", "CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS VARCHAR)")}
    for c, x in {"month": "strftime(o_orderdate, '%m')", "o_orderstatus": "o_orderstatus", "o_orderpriority": "o_orderpriority"}.items():
        top = f"(SELECT v FROM (SELECT {x} AS v, count(*) AS k FROM r GROUP BY 1 ORDER BY k DESC, 1 LIMIT 10))"
        found[c] = ("categorical", f"CASE WHEN {x} IN {top} THEN {x} ELSE '__other__' END")
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", '{kind}' AS kind, {psi} AS psi FROM {side(x, 'r', 'p')} FULL JOIN {side(x, 'n', 'q')} USING (bin)""" for c, (kind, x) in found.items())


#: The ceiling of samples of 1000 rows and more is below 0.1, so that it decides nothing on these tables.
_GRADE = "CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'strong' END"


@query(
    "monitor_production",
    f"""WITH {_SIDES}, {_EDGES}, m AS ({_measured()}) SELECT 'drift' AS signal, "column" AS subject, psi AS value, CASE WHEN {_GRADE} = 'stable' THEN 'stable' ELSE 'watch' END AS verdict FROM m WHERE "column" <> 'o_orderpriority'""",
)
def monitor_production(t: Tables):
    return scoring.check_production(*halves(t), ["o_totalprice"], ["month", "o_orderstatus"])


@query(
    "drift_report",
    f"""WITH {_SIDES}, {_EDGES}, m AS ({_measured()}) SELECT "column", kind, psi, {_GRADE} AS severity FROM m WHERE "column" <> 'o_orderstatus'
    UNION ALL SELECT unnest(['o_custkey', 'extra']), 'added', NULL, 'moderate'""",
)
def drift_report(t: Tables):
    reference, current = halves(t)
    return scoring.drift_report(reference.drop("o_custkey"), current.withColumn("extra", F.lit(1)), ["o_totalprice"], ["month", "o_orderpriority"])


@query("eval_learning_curve")
def eval_learning_curve(t: Tables):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_partkey") % 2).alias("half"))
    return scoring.learning_curve(df.where("p_partkey % 5 <> 0"), df.where("p_partkey % 5 = 0"), ["p_size"], "p_retailprice", "half", "p_partkey")


@query("ml_random_search")
def ml_random_search(t: Tables):
    rows = models.assembled(vectors(t), [f"x{i}" for i in range(_DIMS)], "label", ["vec_id"])
    return scoring.random_search(rows, "vec_id", lambda c: DecisionTreeClassifier(seed=1, **c), {"maxDepth": [2, 4], "minInstancesPerNode": [1, 5]}, configs=2, folds=2)
