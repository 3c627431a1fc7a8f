"""Sources, sinks, questions and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.question import ask
from quern.plans.registry import Tables, query
from quern.sources import ingest, sinks
from quern.streaming import windows
from quern.streaming.visits import visits


@query("src_decimal_locale", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, CAST(o_orderkey AS VARCHAR) || '.5' AS plain FROM orders")
def src_decimal_locale(t: Tables):
    """Prices written with a decimal comma are found and rewritten; plain ones are left."""
    price = F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(","))
    df = t.orders.select("o_orderkey", price.alias("price"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")).alias("plain"))
    return ingest.normal_decimals(df, ingest.decimal_columns(df))


@query(
    "sink_formula_guard",
    "WITH c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN '-5' WHEN 2 THEN '@x' WHEN 3 THEN '+a' ELSE c_name END AS v FROM customer) SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 2, 3) THEN '''' || v ELSE v END AS v FROM c",
)
def sink_formula_guard(t: Tables):
    m = F.col("c_custkey") % 5
    v = F.when(m == 0, "=1+1").when(m == 1, "-5").when(m == 2, "@x").when(m == 3, "+a").otherwise(F.col("c_name"))
    return sinks.guard_formulas(t.customer.select("c_custkey", v.alias("v")))


@query("out_submission", "SELECT count(*) AS asked, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS repeated FROM documents")
def out_submission(t: Tables):
    return sinks.submission_checks(t.labels.select("doc_id", "quality"), t.documents, "doc_id", "quality")


@query("sink_display", "SELECT r_name AS \"name\", '{\"k\":' || r_regionkey || '}' AS nested, 'NULL' AS nothing FROM region")
def sink_display(t: Tables):
    return sinks.display(t.region.select(F.col("r_name").alias("name"), F.struct(F.col("r_regionkey").alias("k")).alias("nested"), F.lit(None).cast("string").alias("nothing")))


def _question(name: str, table: str, text: str, sql: str, lang: str = "en") -> None:
    @query(name, sql)
    def asked(t: Tables):
        found = ask(getattr(t, table), text, lang)
        if found is None:
            raise ValueError(f"refused: {text}")
        return found


_question("ask_average_by", "orders", "what is the average o_totalprice by o_orderpriority?", 'SELECT o_orderpriority AS "group", round(avg(o_totalprice), 6) AS value, count(*) AS count, count(o_totalprice) AS used FROM orders GROUP BY 1')
_question("ask_count_value", "customer", "how many customers where c_mktsegment is building?", "SELECT count(*) AS count FROM customer WHERE c_mktsegment = 'BUILDING'")
_question("ask_top", "events", "top 2 event_type", 'SELECT event_type AS "group", CAST(count(*) AS DOUBLE) AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2')
_question("ask_french", "lineitem", "quelle est la moyenne de l_quantity pour l_discount superieur a 0.05 ?", "SELECT round(avg(l_quantity), 6) AS value, count(*) AS count FROM lineitem WHERE l_discount > 0.05", "fr")
_question("ask_correlation", "lineitem", "correlation between l_quantity and l_extendedprice", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS pairs FROM lineitem")


def _text(df):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query(
    "stream_tumbling",
    "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, n, total FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)",
)
def stream_tumbling(t: Tables):
    return _text(windows.tumbling(t.events, "ts", ["event_type"], "value"))


@query(
    "stream_sliding",
    "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL (15 * k) MINUTE AS s, event_type, value FROM events, range(4) r(k)) GROUP BY s, event_type",
)
def stream_sliding(t: Tables):
    return _text(windows.sliding(t.events, "ts", ["event_type"], "value"))


@query(
    "stream_session",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", user_id, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
)
def stream_session(t: Tables):
    return _text(windows.sessions(t.events, "ts", ["user_id"], "value"))


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(t: Tables):
    return windows.first_seen(t.events, "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query(
    "stream_visits",
    """WITH o AS (SELECT user_id, ts, event_type, value, lag(ts) OVER w AS t, lag(event_type) OVER w AS e FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type NULLS FIRST)), g AS (SELECT *, CASE WHEN t IS NULL OR ts >= t + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM o),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_type NULLS FIRST ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(coalesce(value, 0)), 6) AS total, min_by(event_type, ts) AS first, max_by(event_type, ts) AS last, CAST(count(*) FILTER (new = 0 AND event_type IS DISTINCT FROM e) AS BIGINT) AS switches FROM s WHERE ts IS NOT NULL GROUP BY user_id, k""",
)
def stream_visits(t: Tables):
    return _text(visits(t.events, "ts", ["user_id"], "event_type", "value", 6 * 3600.0))
