"""Cleaning recipes, diffs, drift and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import clean, drift
from quern.operators.clean import ColumnStep, Recipe
from quern.plans.intents import DIRTY_ORDERS, dirty_orders
from quern.plans.quality import CHECKED, REPEATED, SPELT, checked
from quern.plans.registry import Tables, query

KEPT = f"WITH d AS ({DIRTY_ORDERS}), c AS (SELECT o_orderkey, CASE WHEN trim(priority) = 'n/a' THEN NULL ELSE trim(priority) END AS priority, price, trim(status) AS status FROM d)"


def orders(t: Tables):
    return dirty_orders(t).select("o_orderkey", "priority", "price", "status")


@query("clean_trim", f"WITH d AS ({DIRTY_ORDERS}) SELECT 'priority' AS \"column\", count(*) FILTER (priority <> trim(priority)) AS changed FROM d UNION ALL SELECT 'status', count(*) FILTER (status <> trim(status)) FROM d")
def clean_trim(t: Tables):
    return clean.trim_counts(orders(t), ["priority", "status"])


@query(
    "clean_merge_variants",
    f"""WITH d AS ({SPELT}), t AS (SELECT c_custkey, trim(segment) AS segment FROM d), c AS (SELECT lower(segment) AS key, segment, count(*) AS n FROM t GROUP BY 1, 2), b AS (SELECT key, arg_min(segment, (-n, segment)) AS best FROM c GROUP BY key)
    SELECT c_custkey, best AS segment FROM t JOIN b ON lower(t.segment) = b.key""",
)
def clean_merge_variants(t: Tables):
    t.customer.createOrReplaceTempView("customer")
    return clean.apply(t.spark.sql(SPELT), Recipe(merge_variants=True), ["c_custkey"])


@query("clean_derive_dates", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') AS o_orderdate_month, lower(left(dayname(o_orderdate), 3)) AS o_orderdate_weekday FROM orders")
def clean_derive_dates(t: Tables):
    return clean.apply(t.orders.select("o_orderkey", "o_orderdate"), Recipe(derive_dates=True), ["o_orderkey"]).drop("o_orderdate")


@query("clean_dedupe", f"SELECT DISTINCT l_orderkey, l_quantity, flag FROM ({REPEATED})")
def clean_dedupe(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    df = t.spark.sql(REPEATED).withColumn("row", F.monotonically_increasing_id())
    return clean.apply(df, Recipe(drop_duplicates=True), ["row"]).drop("row")


@query("clean_indicator", f"{KEPT} SELECT o_orderkey, CASE WHEN price IS NULL THEN '1' ELSE '0' END AS price_absent FROM c")
def clean_indicator(t: Tables):
    return clean.apply(orders(t), Recipe(columns={"price": ColumnStep(indicator=True)}), ["o_orderkey"]).select("o_orderkey", "price_absent")


@query("clean_drop_missing", f"{KEPT} SELECT o_orderkey, round(price, 6) AS price FROM c WHERE price IS NOT NULL AND priority IS NOT NULL")
def clean_drop_missing(t: Tables):
    return clean.apply(orders(t), Recipe(columns={"price": ColumnStep("drop"), "priority": ColumnStep("drop")}), ["o_orderkey"]).select("o_orderkey", "price")


def _impute(strategy: str, sql: str) -> None:
    @query(f"clean_impute_{strategy}", f"{KEPT} SELECT o_orderkey, {sql} FROM c")
    def impute(t: Tables):
        column = "priority" if strategy in ("mode", "category") else "price"
        step = ColumnStep(strategy, constant=-1.0 if strategy == "constant" else None)
        return clean.apply(orders(t), Recipe(columns={column: step}), ["o_orderkey"]).select("o_orderkey", column)


_impute("median", "round(coalesce(price, (SELECT median(price) FROM c)), 6) AS price")
_impute("mean", "round(coalesce(price, (SELECT avg(price) FROM c)), 6) AS price")
_impute("constant", "coalesce(round(price, 6), -1) AS price")
_impute("mode", "coalesce(priority, (SELECT priority FROM c WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS priority")
_impute("category", "coalesce(priority, 'MISSING') AS priority")


@query(
    "clean_clip",
    """WITH d AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * 40 ELSE l_extendedprice END AS price FROM lineitem), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM d)
    SELECT l_orderkey, l_linenumber, round(greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), price)), 6) AS price FROM d, q""",
)
def clean_clip(t: Tables):
    price = F.when(F.col("l_orderkey") % 101 == 0, F.col("l_extendedprice") * 40).otherwise(F.col("l_extendedprice"))
    return clean.apply(t.lineitem.select("l_orderkey", "l_linenumber", price.alias("price")), Recipe(columns={"price": ColumnStep(clip_outliers=True)}), ["l_orderkey", "l_linenumber"])


@query(
    "clean_diff",
    f"""WITH d AS ({DIRTY_ORDERS}) SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL WHEN priority = ' n/a ' THEN 'priority' END AS "column", CASE WHEN price IS NULL THEN '' ELSE coalesce(priority, '') END AS old, CASE WHEN price IS NULL THEN '' ELSE trim(priority) END AS new FROM d WHERE price IS NULL OR priority = ' n/a '
    UNION ALL SELECT o_orderkey, 'status', status, trim(status) FROM d WHERE price IS NOT NULL AND status <> trim(status)""",
)
def clean_diff(t: Tables):
    before = orders(t)
    after = clean.apply(before, Recipe(columns={"price": ColumnStep("drop")}), ["o_orderkey"])
    return clean.diff(before, after, ["o_orderkey"])


def halves(t: Tables):
    orders = t.orders.withColumn("month", F.date_format("o_orderdate", "MM"))
    return orders.where("o_orderdate < timestamp_ntz '1998-01-01'"), orders.where("o_orderdate >= timestamp_ntz '1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") * 1.2)


_EDGES = "e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM r)"
_SIDES = "r AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), n AS (SELECT * REPLACE (o_totalprice * 1.2 AS o_totalprice) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


@query(
    "drift_bins",
    f"WITH {_SIDES}, {_EDGES} SELECT CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS VARCHAR) AS bin, round(count(*) / (SELECT count(*) FROM n), 6) AS share FROM n, e GROUP BY 1",
)
def drift_bins(t: Tables):
    reference, current = halves(t)
    return drift.numeric_shares(current, drift.decile_edges(reference, ["o_totalprice"])).select("bin", "share")


@query(
    "drift_psi_numeric",
    f"""WITH {_SIDES}, {_EDGES}, p AS (SELECT len(list_filter(e, lambda x: x < o_totalprice)) AS bin, count(*) / (SELECT count(*) FROM r) AS p FROM r, e GROUP BY 1), q AS (SELECT len(list_filter(e, lambda x: x < o_totalprice)) AS bin, count(*) / (SELECT count(*) FROM n) AS q FROM n, e GROUP BY 1)
    SELECT 'o_totalprice' AS "column", round(sum((greatest(coalesce(q, 0), 1e-4) - greatest(coalesce(p, 0), 1e-4)) * ln(greatest(coalesce(q, 0), 1e-4) / greatest(coalesce(p, 0), 1e-4))), 6) AS psi FROM p FULL JOIN q USING (bin)""",
)
def drift_psi_numeric(t: Tables):
    return drift.numeric_drift(*halves(t), ["o_totalprice"])


_TOP = "top AS (SELECT month FROM (SELECT strftime(o_orderdate, '%m') AS month, count(*) AS k FROM r GROUP BY 1 ORDER BY k DESC, 1 LIMIT 10))"


def _cat(side: str) -> str:
    return f"(SELECT CASE WHEN strftime(o_orderdate, '%m') IN (SELECT month FROM top) THEN strftime(o_orderdate, '%m') ELSE '__other__' END AS bin, count(*) / (SELECT count(*) FROM {side}) AS s FROM {side} GROUP BY 1)"


@query("drift_category_shares", f"WITH {_SIDES}, {_TOP} SELECT bin, round(s, 6) AS share FROM {_cat('n')}")
def drift_category_shares(t: Tables):
    reference, current = halves(t)
    return drift.category_shares(current, drift.top_categories(reference, ["month"])).select("bin", "share")


@query(
    "drift_psi_categorical",
    f"""WITH {_SIDES}, {_TOP} SELECT 'month' AS "column", round(sum((greatest(coalesce(q.s, 0), 1e-4) - greatest(coalesce(p.s, 0), 1e-4)) * ln(greatest(coalesce(q.s, 0), 1e-4) / greatest(coalesce(p.s, 0), 1e-4))), 6) AS psi FROM {_cat('r')} p FULL JOIN {_cat('n')} q USING (bin)""",
)
def drift_psi_categorical(t: Tables):
    return drift.categorical_drift(*halves(t), ["month"])


@query("set_new_categories", "SELECT DISTINCT source AS value FROM documents WHERE doc_id >= 8 AND source NOT IN (SELECT source FROM documents WHERE doc_id < 8) ORDER BY 1 LIMIT 6")
def set_new_categories(t: Tables):
    return drift.changed_categories(t.documents.where("doc_id < 8"), t.documents.where("doc_id >= 8"), "source")


@query("set_gone_categories", "SELECT DISTINCT source AS value FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 8) ORDER BY 1 LIMIT 6")
def set_gone_categories(t: Tables):
    return drift.changed_categories(t.documents.where("doc_id < 8"), t.documents, "source")


@query("drift_ceiling")
def drift_ceiling(t: Tables):
    """The simulated noise ceiling of a uniform split at four sizes."""
    rows = [(n, drift.noise_ceiling([0.1] * 10, n, n, 0.95)) for n in (100, 400, 1000, 10000)]
    return t.spark.createDataFrame(rows, "rows long, ceiling double")


@query("profile_numeric_bins", f"WITH {_SIDES}, {_EDGES} SELECT CAST(len(list_filter(e, lambda x: x < o_totalprice)) AS VARCHAR) AS bin, round(count(*) / (SELECT count(*) FROM r), 6) AS share FROM r, e GROUP BY 1")
def profile_numeric_bins(t: Tables):
    reference, _ = halves(t)
    p = drift.build_profiles(reference, {"o_totalprice": "numeric"})[0]
    return t.spark.createDataFrame(list(zip(p.bins, map(float, p.shares), strict=True)), "bin string, share double")


@query("contract_reading", "SELECT * FROM (VALUES ('o_orderkey', 'number'), ('age', 'number'), ('price', 'number'), ('rate', 'number'), ('zip', 'number'), ('day', 'date')) t(\"column\", reading)")
def contract_reading(t: Tables):
    return drift.readings(checked(t)).select("column", "reading")


def _changed(t: Tables):
    base = checked(t)
    contract = drift.build_contract(base.where("o_orderkey % 2 = 0").select("age", "price"))
    return contract, base.where("o_orderkey % 2 = 1").select("age", F.when(F.col("o_orderkey") % 5 != 0, F.col("price")).alias("price"))


@query(
    "contract_missing_clause",
    f"""WITH d AS ({CHECKED.replace("STRING", "VARCHAR")}) SELECT 'missing' AS family, 'age' AS subject, 'kept' AS outcome, '0.0000' AS detail
    UNION ALL SELECT 'missing', 'price', 'broken', printf('%.4f', count(*) FILTER (o_orderkey % 5 = 0) / count(*)) FROM d WHERE o_orderkey % 2 = 1""",
)
def contract_missing_clause(t: Tables):
    contract, new = _changed(t)
    return drift.check_contract(contract, new).where("family = 'missing'")


@query("contract_rule_clause", "SELECT 'rule' AS family, 'ageRange(age)' AS subject, 'kept' AS outcome UNION ALL SELECT 'rule', 'negativeAmount(price)', 'kept'")
def contract_rule_clause(t: Tables):
    contract, new = _changed(t)
    return drift.check_contract(contract, new).where("family = 'rule'").select("family", "subject", "outcome")
