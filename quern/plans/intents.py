"""Queries through the intent compiler."""

from __future__ import annotations

from quern.operators.intent import Filter, Intent, compile_intent
from quern.plans.registry import Tables, query

PRICE, QTY = "l_extendedprice", "l_quantity"


@query(
    "nlq_agg_grouped",
    """SELECT l_returnflag AS "group", round(avg(l_extendedprice), 6) AS value, count(*) AS count, count(l_extendedprice) AS used
    FROM lineitem WHERE l_quantity > 20 GROUP BY l_returnflag ORDER BY value DESC, 1 LIMIT 12""",
)
def nlq_agg_grouped(t: Tables):
    return compile_intent(t.lineitem, Intent("aggregate", PRICE, "mean", by="l_returnflag", filter=Filter(QTY, ">", 20)))


SCALARS = {"count": "CAST(count(o_totalprice) AS DOUBLE)", "mean": "avg(o_totalprice)", "median": "median(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "sum": "sum(o_totalprice)", "std": "stddev_pop(o_totalprice)"}


def _scalar(op: str, expression: str) -> None:
    @query(f"nlq_agg_scalar_{op}", f"SELECT round({expression}, 6) AS value, count(o_totalprice) AS count FROM orders")
    def scalar(t: Tables):
        return compile_intent(t.orders, Intent("aggregate", "o_totalprice", op))


for _op, _expression in SCALARS.items():
    _scalar(_op, _expression)


@query(
    "nlq_agg_median_by",
    """SELECT o_orderpriority AS "group", round(median(o_totalprice), 6) AS value, count(*) AS count, count(o_totalprice) AS used
    FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
)
def nlq_agg_median_by(t: Tables):
    return compile_intent(t.orders, Intent("aggregate", "o_totalprice", "median", by="o_orderpriority"))


@query("nlq_count", "SELECT count(*) AS count FROM lineitem WHERE l_discount >= 0.05")
def nlq_count(t: Tables):
    return compile_intent(t.lineitem, Intent("count", filter=Filter("l_discount", ">=", 0.05)))


@query("nlq_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def nlq_shape(t: Tables):
    return compile_intent(t.lineitem, Intent("shape"))


DIRTY_ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' n/a ' ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 7 = 0 THEN upper(o_orderstatus) || ' ' ELSE lower(o_orderstatus) END AS status, o_custkey, o_orderdate FROM orders"""


def dirty_orders(t: Tables):
    """Orders with dirt that both engines make alike."""
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(DIRTY_ORDERS)


@query(
    "nlq_missing",
    f"""WITH d AS ({DIRTY_ORDERS}) SELECT * FROM (
    SELECT 'priority' AS "column", count(*) FILTER (priority IS NULL OR lower(trim(priority)) = 'n/a') AS missing FROM d
    UNION ALL SELECT 'price', count(*) FILTER (price IS NULL) FROM d) WHERE missing > 0""",
)
def nlq_missing(t: Tables):
    return compile_intent(dirty_orders(t), Intent("missing"))


@query("nlq_distribution", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def nlq_distribution(t: Tables):
    return compile_intent(t.part, Intent("distribution", "p_brand"))


@query("nlq_correlation", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS pairs FROM lineitem WHERE l_returnflag = 'A'")
def nlq_correlation(t: Tables):
    return compile_intent(t.lineitem, Intent("correlation", QTY, other=PRICE, filter=Filter("l_returnflag", "=", "a")))


@query("nlq_topk_count", 'SELECT event_type AS "group", CAST(count(*) AS DOUBLE) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3')
def nlq_topk_count(t: Tables):
    return compile_intent(t.events, Intent("top", by="event_type", k=3))


@query("nlq_topk_metric", 'SELECT CAST(o_custkey AS VARCHAR) AS "group", round(sum(o_totalprice), 6) AS value, count(*) AS count FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10')
def nlq_topk_metric(t: Tables):
    return compile_intent(t.orders, Intent("top", "o_totalprice", "sum", by="o_custkey", k=10))


@query("nlq_filter_range", "SELECT round(max(l_extendedprice), 6) AS value, count(*) AS count FROM lineitem WHERE l_quantity <= 3")
def nlq_filter_range(t: Tables):
    return compile_intent(t.lineitem, Intent("aggregate", PRICE, "max", filter=Filter(QTY, "<=", "3")))


@query("nlq_filter_ne", f"WITH d AS ({DIRTY_ORDERS}) SELECT count(*) AS count FROM d WHERE price IS NOT NULL AND price <> 1000")
def nlq_filter_ne(t: Tables):
    return compile_intent(dirty_orders(t), Intent("count", filter=Filter("price", "!=", 1000)))


@query("nlq_filter_text", f"WITH d AS ({DIRTY_ORDERS}) SELECT count(*) AS count FROM d WHERE priority IS NOT NULL AND lower(trim(priority)) <> 'n/a' AND lower(trim(priority)) <> '1-urgent'")
def nlq_filter_text(t: Tables):
    return compile_intent(dirty_orders(t), Intent("count", filter=Filter("priority", "!=", "1-Urgent")))


@query("nlq_filter_text_eq", f"WITH d AS ({DIRTY_ORDERS}) SELECT round(sum(price), 6) AS value, count(price) AS count FROM d WHERE lower(trim(status)) = 'f'")
def nlq_filter_text_eq(t: Tables):
    return compile_intent(dirty_orders(t), Intent("aggregate", "price", "sum", filter=Filter("status", "=", "F")))
