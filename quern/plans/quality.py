"""Profiles, data quality, cleaning, drift and contracts over tables with dirt that both engines make alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import cells
from quern.functions.stats import wilson
from quern.operators import profile, quality
from quern.plans.intents import DIRTY_ORDERS, dirty_orders
from quern.plans.registry import Tables, determines_sql, exclusions_sql, query

CUSTOMER_NUMBERS = ["c_custkey", "c_nationkey", "c_acctbal"]


@query(
    "profile_numeric",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", count({c}) AS numbers, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 6) AS mean, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(stddev_pop({c}), 6) AS std FROM customer"
        for c in CUSTOMER_NUMBERS
    ),
)
def profile_numeric(t: Tables):
    return profile.profile_columns(t.customer, CUSTOMER_NUMBERS)


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_OTHERS = ("l_returnflag", "l_linestatus", "l_shipdate")


@query(
    "profile_lineitem",
    " UNION ALL ".join(
        [f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", count({c}) AS numbers, round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, round(avg({c}), 4) AS mean, round(CAST(median({c}) AS DOUBLE), 6) AS median, round(stddev_pop({c}), 4) AS std FROM lineitem" for c in _NUMBERS]
        + [f"SELECT '{c}', count(*), count(*) - count({c}), count(DISTINCT {c}), 0, NULL, NULL, NULL, NULL, NULL FROM lineitem" for c in _OTHERS]
    ),
)
def profile_lineitem(t: Tables):
    """The whole profile of the widest table in one job: the counterpart of a million-row profile."""
    return profile.profile_columns(t.lineitem).withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "profile_histogram",
    """WITH e AS (SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders), b AS (SELECT CAST(least(floor((o_totalprice - low) / ((high - low) / 12)), 11) AS INTEGER) AS bin, low, high FROM orders, e)
    SELECT bin, round(low + bin * ((high - low) / 12), 6) AS low, round(low + (bin + 1) * ((high - low) / 12), 6) AS high, count(*) AS count FROM b GROUP BY bin, b.low, b.high""",
)
def profile_histogram(t: Tables):
    return profile.histogram(t.orders, "o_totalprice")


@query(
    "profile_column",
    f"""WITH d AS ({DIRTY_ORDERS}), v AS (SELECT 'priority' AS "column", CASE WHEN lower(trim(priority)) <> 'n/a' THEN trim(priority) END AS value FROM d UNION ALL SELECT 'status', trim(status) FROM d),
    c AS (SELECT "column", value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY 1, 2) SELECT "column", value, count, CAST(row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS INTEGER) AS rank FROM c QUALIFY rank <= 8""",
)
def profile_column(t: Tables):
    return profile.top_values(dirty_orders(t), ["priority", "status"])


@query(
    "profile_exclusions",
    exclusions_sql("part", {c: c for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")} | {"nothing": "CASE WHEN p_partkey % 50 = 0 THEN p_name END", "always": "'x'"}),
)
def profile_exclusions(t: Tables):
    df = t.part.withColumns({"nothing": F.when(F.col("p_partkey") % 50 == 0, F.col("p_name")), "always": F.lit("x")})
    return profile.exclusions(profile.profile_columns(df))


@query(
    "profile_redundancy",
    determines_sql("(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)", [("n_name", "n_regionkey"), ("r_name", "n_regionkey"), ("n_regionkey", "n_name")]),
)
def profile_redundancy(t: Tables):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return profile.determines(df, [("n_name", "n_regionkey"), ("r_name", "n_regionkey"), ("n_regionkey", "n_name")])


@query(
    "profile_leak_corr",
    "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 6) FROM lineitem",
)
def profile_leak_corr(t: Tables):
    return profile.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


@query("profile_types", "SELECT * FROM (VALUES ('doc_id', 'id'), ('text', 'text'), ('lang', 'categorical'), ('source', 'categorical'), ('n_chars', 'numeric')) t(\"column\", type)")
def profile_types(t: Tables):
    return profile.column_types(t.documents)


PARSED = """SELECT i, CASE i % 12 WHEN 0 THEN '12' WHEN 1 THEN ' 3.50 ' WHEN 2 THEN '1d' WHEN 3 THEN '0x10' WHEN 4 THEN '1_000' WHEN 5 THEN '.5' WHEN 6 THEN '5.' WHEN 7 THEN '1e3' WHEN 8 THEN 'Infinity' WHEN 9 THEN 'NaN' WHEN 10 THEN '-7' ELSE 'n/a' END AS s,
 CASE i % 8 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2024-03' WHEN 2 THEN '31/01/2023' WHEN 3 THEN '01/31/2023' WHEN 4 THEN '5.6.21' WHEN 5 THEN '2023-07-04 08:09' WHEN 6 THEN '31/02/2023' ELSE '-' END AS d FROM (SELECT o_orderkey % 1000 AS i FROM orders)"""


def parsed(t: Tables):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(PARSED)


@query("scalar_missing", f"SELECT i, s IN ('NaN', 'n/a') AS missing FROM ({PARSED})")
def scalar_missing(t: Tables):
    df = parsed(t)
    return df.select("i", cells.is_missing(df, "s").alias("missing"))


@query("scalar_parse_number", f"SELECT i, CASE WHEN s IN ('1d', '0x10', '1_000', 'Infinity', 'NaN', 'n/a') THEN NULL ELSE CAST(trim(s) AS DOUBLE) END AS x FROM ({PARSED})")
def scalar_parse_number(t: Tables):
    df = parsed(t)
    return df.select("i", cells.number(df, "s").alias("x"))


@query(
    "scalar_parse_date",
    f"SELECT i, CASE i % 8 WHEN 0 THEN '2024-02-29 00:00' WHEN 1 THEN '2024-03-01 00:00' WHEN 2 THEN '2023-01-31 00:00' WHEN 3 THEN '2023-01-31 00:00' WHEN 4 THEN '2021-06-05 00:00' WHEN 5 THEN '2023-07-04 08:09' END AS at FROM ({PARSED})",
)
def scalar_parse_date(t: Tables):
    df = parsed(t)
    return df.select("i", F.date_format(cells.date(df, "d"), "yyyy-MM-dd HH:mm").alias("at"))


@query("scalar_format_number", "SELECT l_orderkey, l_linenumber, rtrim(rtrim(printf('%.6f', l_extendedprice / 7), '0'), '.') AS s FROM lineitem")
def scalar_format_number(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", cells.format_number(F.col("l_extendedprice") / 7).alias("s"))


@query("text_tokens", "SELECT event_id, list_filter(string_split_regex(lower(event_type || ' / ' || props), '[^a-z0-9]+'), lambda w: len(w) >= 3) AS tokens FROM events")
def text_tokens(t: Tables):
    return t.events.select("event_id", cells.tokens(F.concat_ws(" / ", "event_type", "props")).alias("tokens"))


@query(
    "stat_wilson",
    """WITH g AS (SELECT source, count(*) AS n, avg(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source), w AS (SELECT *, 1 + 3.8414588206941254 / n AS d, 1.959963984540054 AS z FROM g)
    SELECT source, n, round(greatest(0, (p + z * z / (2 * n)) / d - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 6) AS lo, round(least(1, (p + z * z / (2 * n)) / d + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d), 6) AS hi FROM w""",
)
def stat_wilson(t: Tables):
    g = t.documents.join(t.labels, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.avg("quality").alias("p"))
    low, high = wilson(F.col("p"), F.col("n"), 1.959963984540054)
    return g.select("source", "n", low.alias("lo"), high.alias("hi"))


OUTLYING = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 101 = 0 THEN l_extendedprice * 40 ELSE l_extendedprice END AS price, l_quantity FROM lineitem"


@query(
    "dq_outliers",
    f"""WITH d AS ({OUTLYING}), q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM d), f AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q),
    q2 AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM d), f2 AS (SELECT q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM q2)
    SELECT 'price' AS "column", round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (price < low OR price > high) AS count FROM d, f GROUP BY low, high
    UNION ALL SELECT 'l_quantity', round(low, 6), round(high, 6), count(*) FILTER (l_quantity < low OR l_quantity > high) FROM d, f2 GROUP BY low, high""",
)
def dq_outliers(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    return quality.outliers(t.spark.sql(OUTLYING), ["price", "l_quantity"])


SPELT = "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 0 THEN c_mktsegment || ' ' ELSE c_mktsegment END AS segment FROM customer"


@query(
    "dq_variants",
    f"""WITH d AS ({SPELT}), c AS (SELECT lower(trim(segment)) AS key, segment, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT 'segment' AS "column", key, arg_min(segment, (-n, segment)) AS canonical, count(*) AS variants, CAST(sum(n) - max(n) AS BIGINT) AS cells FROM c GROUP BY key HAVING count(*) > 1""",
)
def dq_variants(t: Tables):
    t.customer.createOrReplaceTempView("customer")
    return quality.variants(t.spark.sql(SPELT), ["segment"])


REPEATED = "SELECT l_orderkey, l_quantity, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS flag FROM lineitem UNION ALL SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem"


@query("dq_duplicates", f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM ({REPEATED}) GROUP BY l_orderkey, l_quantity, flag)")
def dq_duplicates(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    return quality.duplicates(t.spark.sql(REPEATED))


@query("dq_structural", exclusions_sql("supplier", {c: c for c in ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")} | {"gap": "CASE WHEN s_suppkey % 40 = 0 THEN 1 END"}))
def dq_structural(t: Tables):
    return profile.exclusions(profile.profile_columns(t.supplier.withColumn("gap", F.when(F.col("s_suppkey") % 40 == 0, 1))))


CHECKED = """SELECT o_orderkey, CASE WHEN o_orderkey % 23 = 0 THEN 130 + o_orderkey % 7 ELSE o_orderkey % 90 END AS age, CASE WHEN o_orderkey % 19 = 0 THEN -5.0 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 29 = 0 THEN 140 ELSE o_orderkey % 100 END AS rate,
 CASE WHEN o_orderkey % 31 = 0 THEN 'X1' ELSE lpad(CAST(o_orderkey % 90000 AS STRING), 5, '0') END AS zip, CASE WHEN o_orderkey % 37 = 0 THEN '2999-01-01' ELSE '2020-05-06' END AS day FROM orders"""


def checked(t: Tables):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(CHECKED)


_RULES = {"ageRange": ("age", 23), "negativeAmount": ("price", 19), "percentRange": ("rate", 29), "postcodeShape": ("zip", 31), "futureDate": ("day", 37)}


def _validity(rule: str, column: str, step: int) -> None:
    @query(f"dq_validity_{column}", f"SELECT '{rule}' AS rule, '{column}' AS \"column\", count(*) AS tested, count(*) FILTER (o_orderkey % {step} = 0) AS failed FROM orders")
    def one(t: Tables):
        return quality.validity(checked(t).select("o_orderkey", column), [column])


for _rule, (_column, _step) in _RULES.items():
    _validity(_rule, _column, _step)


@query("dq_validity_total", "SELECT CAST(" + " + ".join(f"count(*) FILTER (o_orderkey % {s} = 0)" for _, s in _RULES.values()) + " AS BIGINT) AS invalid FROM orders")
def dq_validity_total(t: Tables):
    return quality.validity(checked(t), ["age", "price", "rate", "zip", "day"]).agg(F.sum("failed").alias("invalid"))


DATED = "SELECT o_orderdate AS start_date, CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate - INTERVAL 3 DAY ELSE o_orderdate + INTERVAL 9 DAY END AS end_date FROM orders"


@query("dq_consistency_dates", "SELECT 'dateOrder' AS rule, 'start_date,end_date' AS columns, count(*) AS tested, count(*) FILTER (o_orderkey % 41 = 0) AS failed FROM orders")
def dq_consistency_dates(t: Tables):
    t.orders.createOrReplaceTempView("orders")
    return quality.consistency(t.spark.sql(DATED))


MULTIPLIED = "SELECT l_quantity AS quantity, l_extendedprice AS unit_price, CASE WHEN l_orderkey % 43 = 0 THEN l_quantity * l_extendedprice * 1.5 ELSE round(l_quantity * l_extendedprice, 2) END AS total FROM lineitem"


@query("dq_consistency_product", "SELECT 'productMismatch' AS rule, 'quantity,unit_price,total' AS columns, count(*) AS tested, count(*) FILTER (l_orderkey % 43 = 0) AS failed FROM lineitem")
def dq_consistency_product(t: Tables):
    t.lineitem.createOrReplaceTempView("lineitem")
    return quality.consistency(t.spark.sql(MULTIPLIED))


SCORED = "SELECT o_orderkey, CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 19 = 0 THEN -5.0 ELSE o_totalprice END AS price, 'x' AS fixed FROM orders"


@query(
    "dq_score",
    """WITH c AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 15 = 0) AS missing, count(*) FILTER (o_orderkey % 19 = 0) AS bad FROM orders),
    d AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN -5.0 ELSE o_totalprice END AS x FROM orders), q AS (SELECT quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM d),
    o AS (SELECT count(*) FILTER (x < a - 1.5 * (b - a) OR x > b + 1.5 * (b - a)) AS k FROM d, q),
    p AS (SELECT * FROM (VALUES (1, 'missing', 35), (2, 'duplicates', 20), (3, 'messy', 20), (4, 'outliers', 15), (5, 'structural', 10), (6, 'validity', 5)) t(i, part, weight)),
    k AS (SELECT part, weight, CASE i WHEN 1 THEN missing WHEN 4 THEN k WHEN 5 THEN 2 WHEN 6 THEN bad ELSE 0 END AS count, n FROM p, c, o)
    SELECT part, weight, CAST(count AS BIGINT) AS count, round(CASE WHEN part = 'structural' THEN least(10, 2.5 * count) ELSE weight * least(1, count / (4 * n) * 8) END, 1) AS penalty FROM k""",
)
def dq_score(t: Tables):
    t.orders.createOrReplaceTempView("orders")
    return quality.score_parts(quality.report_counts(t.spark.sql(SCORED)))


@query("profile_sketched")
def profile_sketched(t: Tables):
    """The profile as it is taken of very large tables: one pass, sketches of fixed size."""
    return profile.profile_columns(t.lineitem, exact=False)


@query("dq_isolation")
def dq_isolation(t: Tables):
    """Anomaly scores of all rows from 100 trees over a bounded sample."""
    found = quality.isolation_scores(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_orderkey")
    return found.select("l_orderkey", "l_linenumber", "anomaly")
