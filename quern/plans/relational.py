"""The relational surface: joins, aggregates, windows, sets, reshaping and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import joins, quantiles
from quern.plans.registry import Tables, query


def both(name: str, sql: str, oracle: str | None = None) -> None:
    """A query in SQL that Spark runs as it stands; ``oracle`` where DuckDB spells it differently."""

    @query(name, oracle or sql)
    def run(t: Tables):
        for table in TABLES:
            if table in sql:
                getattr(t, table).createOrReplaceTempView(table)
        return t.spark.sql(sql)


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

both("rel_join_inner", "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 6) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
both("rel_join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
both("rel_join_right", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 12 GROUP BY r_name")
both("rel_join_full", "SELECT c_nationkey AS c, s_nationkey AS s, count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey > 5) b ON c_nationkey = s_nationkey GROUP BY 1, 2")
both("rel_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey % 5 = r_regionkey")
both("rel_join_semi", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000", "SELECT c_custkey, c_name FROM customer SEMI JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
both("rel_join_anti", "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey, c_name FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
both("rel_join_lateral", "SELECT n_name, t.c_custkey AS c_custkey, t.c_acctbal AS c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) t")
both("rel_subquery_correlated", "SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
both("rel_subquery_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount > 0.09)")
both("rel_three_way", "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")


@query(
    "rel_join_theta",
    "WITH b(low, high, name) AS (VALUES (0.0, 50000.0, 'small'), (50000.0, 150000.0, 'mid'), (150000.0, 1e9, 'large')) SELECT name, count(*) AS n FROM orders JOIN b ON o_totalprice >= low AND o_totalprice < high GROUP BY name",
)
def rel_join_theta(t: Tables):
    bands = t.spark.sql("SELECT * FROM VALUES (0.0D, 50000.0D, 'small'), (50000.0D, 150000.0D, 'mid'), (150000.0D, 1e9D, 'large') AS b(low, high, name)")
    return t.orders.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("name").agg(F.count("*").alias("n"))


@query(
    "rel_join_range",
    "WITH w AS (SELECT p_partkey, p_retailprice AS low, p_retailprice + 0.5 AS high FROM part) SELECT a.p_partkey AS part, w.p_partkey AS near FROM part a JOIN w ON a.p_retailprice >= low AND a.p_retailprice < high",
)
def rel_join_range(t: Tables):
    windows = t.part.select(F.col("p_partkey").alias("near"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 0.5).alias("high"))
    return joins.range_join(t.part.select(F.col("p_partkey").alias("part"), "p_retailprice"), windows, "p_retailprice", "low", "high", 5.0).select("part", "near")


@query(
    "rel_join_asof",
    """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
    SELECT e.event_id, p.purchase FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def rel_join_asof(t: Tables):
    buys = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase"))
    rest = t.events.where("event_type <> 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof_join(rest, buys, "user_id", "ts", "at", ["purchase"], "purchase").select("event_id", "purchase")


@query("rel_join_positional", "SELECT n_name, c_custkey FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a FULL JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) b USING (i)")
def rel_join_positional(t: Tables):
    return joins.positional_join(t.nation.select("n_name", "n_nationkey"), t.customer.select("c_custkey", "c_acctbal"), ["n_nationkey"], ["c_acctbal", "c_custkey"]).select("n_name", "c_custkey")


both("rel_agg_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY o_orderstatus")
both("rel_agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, round(sum(l_quantity) FILTER (WHERE l_tax < 0.02), 6) AS q FROM lineitem GROUP BY l_returnflag")
both("rel_agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
both("rel_agg_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
both("rel_agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
both("rel_agg_group_by_all", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS v FROM events GROUP BY ALL")
both("rel_agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
both("rel_agg_argmax", "SELECT o_custkey, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS top_order, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS least_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS top_order, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS least_order FROM orders GROUP BY o_custkey")
both("rel_agg_string", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
both("rel_agg_spread", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sp, round(stddev_samp(l_quantity), 6) AS ss, round(var_pop(l_quantity), 6) AS vp, round(var_samp(l_quantity), 6) AS vs, round(avg(l_tax), 6) AS m FROM lineitem GROUP BY l_returnflag")
both("rel_agg_regression", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(covar_pop(l_extendedprice, l_quantity), 4) AS cov FROM lineitem")
both("rel_agg_bool", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderstatus")


@query("rel_agg_quantiles", "SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS q1, round(median(l_extendedprice), 6) AS q2, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 6) AS p90, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS d FROM lineitem GROUP BY l_returnflag")
def rel_agg_quantiles(t: Tables):
    return quantiles.group_quantiles(t.lineitem, "l_returnflag", "l_extendedprice", {"q1": 0.25, "q2": 0.5, "p90": 0.9}, {"d": 0.5})


@query("rel_agg_approx")
def rel_agg_approx(t: Tables):
    """Sketches: distinct counts and quantiles within their stated error."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("orders"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))


@query("agg_mode", "SELECT DISTINCT ON (p_size) p_size, p_brand AS mode, n FROM (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY 1, 2) ORDER BY p_size, n DESC, p_brand")
def agg_mode(t: Tables):
    """The most frequent value, the first by name of equals."""
    counted = t.part.groupBy("p_size", "p_brand").agg(F.count("*").alias("n"))
    return counted.groupBy("p_size").agg(F.min_by(F.struct("p_brand", "n"), F.struct(-F.col("n"), "p_brand")).alias("m")).select("p_size", F.col("m.p_brand").alias("mode"), "m.n")


both("rel_win_rank", "SELECT c_custkey, rank() OVER w AS r, dense_rank() OVER w AS d, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)", "SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal DESC)")
both("rel_win_ntile", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS q, round(percent_rank() OVER (ORDER BY s_acctbal), 6) AS p, round(cume_dist() OVER (ORDER BY s_acctbal), 6) AS c FROM supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS q, round(percent_rank() OVER (ORDER BY s_acctbal), 6) AS p, round(cume_dist() OVER (ORDER BY s_acctbal), 6) AS c FROM supplier")
both("rel_win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1.0D) OVER w AS next2, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_totalprice) OVER w AS prev, lead(o_totalprice, 2, -1.0) OVER w AS next2, first_value(o_orderkey) OVER w AS first_key FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("rel_win_rows", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m3, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 6) AS running FROM orders")
both("rel_win_range", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part")
both("rel_win_ignore_nulls", "SELECT event_id, last_value(CASE WHEN value > 50 THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_big FROM events", "SELECT event_id, last_value(CASE WHEN value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_big FROM events")
both("rel_topk_per_group", "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3", "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS r FROM lineitem QUALIFY r <= 3")
both("rel_sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 10")
both("rel_set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
both("rel_set_union_all", "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
both("rel_set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
both("rel_set_intersect_all", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
both("rel_set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
both("rel_set_except_all", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")


@query("rel_pivot", "SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 6) AS f, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1")
def rel_pivot(t: Tables):
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).toDF("l_returnflag", "f", "o")


@query("rel_unpivot", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_quantity, l_discount, l_tax))")
def rel_unpivot(t: Tables):
    return t.lineitem.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "name", "value")


@query("rel_explode", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CAST(embedding[i] AS DOUBLE), 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
def rel_explode(t: Tables):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))


both("rel_recursive", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
both("rel_values", "SELECT k, v FROM VALUES (1, 'a'), (2, 'b') AS t(k, v)", "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b')) AS t(k, v)")
both("rel_null_safe", "SELECT count(*) AS n FROM (SELECT nullif(l_returnflag, 'N') AS f FROM lineitem) WHERE f IS NOT DISTINCT FROM NULL")
both("rel_filters", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#11', 'Brand#22', 'Brand#33') AND p_type LIKE '%A%' AND p_name ILIKE '%a%'")
both(
    "rel_scalar_string",
    "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, length(p_name) AS l, lpad(CAST(p_size AS STRING), 4, '0') AS pad, replace(p_type, ' ', '_') AS r, reverse(p_brand) AS rev, instr(p_name, 'a') AS i, concat_ws('-', p_brand, p_type) AS c, regexp_replace(p_name, '[aeiou]', '*') AS v, md5(p_name) AS h, left(p_name, 3) AS lft, levenshtein(p_brand, p_type) AS d FROM part",
    "SELECT p_partkey, upper(p_name) AS u, substring(p_name, 2, 4) AS s, CAST(length(p_name) AS INTEGER) AS l, lpad(CAST(p_size AS VARCHAR), 4, '0') AS pad, replace(p_type, ' ', '_') AS r, reverse(p_brand) AS rev, CAST(instr(p_name, 'a') AS INTEGER) AS i, concat_ws('-', p_brand, p_type) AS c, regexp_replace(p_name, '[aeiou]', '*', 'g') AS v, md5(p_name) AS h, left(p_name, 3) AS lft, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS d FROM part",
)
both(
    "rel_scalar_date",
    "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS doy, date_format(o_orderdate, 'yyyy-MM') AS ym, datediff(o_orderdate, date '1992-01-01') AS dd, CAST(last_day(o_orderdate) AS STRING) AS ld, CAST(add_months(o_orderdate, 1) AS STRING) AS am, CAST(date_add(o_orderdate, 10) AS STRING) AS da, CAST(CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS STRING) AS tr FROM orders",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(weekofyear(o_orderdate) AS INTEGER) AS w, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, strftime(o_orderdate, '%Y-%m') AS ym, CAST(datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS dd, CAST(last_day(o_orderdate) AS VARCHAR) AS ld, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS am, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS VARCHAR) AS da, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS tr FROM orders",
)
both(
    "rel_scalar_math",
    "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, c_custkey % 7 AS m, c_custkey div 7 AS d, round(pow(c_nationkey, 2), 6) AS p, sign(c_acctbal) AS sg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le, round(cbrt(c_nationkey), 6) AS cb, bit_count(c_custkey) AS bc FROM customer",
    "SELECT c_custkey, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, c_custkey % 7 AS m, c_custkey // 7 AS d, round(pow(c_nationkey, 2), 6) AS p, CAST(sign(c_acctbal) AS DOUBLE) AS sg, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le, round(cbrt(c_nationkey), 6) AS cb, CAST(bit_count(c_custkey) AS INTEGER) AS bc FROM customer",
)
both(
    "rel_scalar_conditional",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, coalesce(nullif(l_returnflag, 'N'), '-') AS flag, if(l_tax > 0.04, 1, 0) AS taxed, try_cast(l_linestatus AS INT) AS none FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'few' WHEN l_quantity < 30 THEN 'some' ELSE 'many' END AS size, coalesce(nullif(l_returnflag, 'N'), '-') AS flag, if(l_tax > 0.04, 1, 0) AS taxed, try_cast(l_linestatus AS INTEGER) AS none FROM lineitem",
)
both("rel_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k AS k2 FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k2 FROM events")
both(
    "rel_array",
    "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 6) AS mx, CAST(array_position(embedding, array_max(embedding)) AS INT) AS at, round(aggregate(embedding, 0.0D, (a, x) -> a + x * x), 6) AS norm2, size(filter(embedding, x -> x > 0)) AS pos FROM embeddings",
    "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS mx, CAST(list_position(embedding, list_max(embedding)) AS INTEGER) AS at, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS pos FROM embeddings",
)
both("rel_map", "SELECT r_regionkey, element_at(m, 'name') AS name, map_keys(m) AS keys FROM (SELECT r_regionkey, map('name', r_name, 'key', CAST(r_regionkey AS STRING)) AS m FROM region)", "SELECT r_regionkey, m['name'] AS name, map_keys(m) AS keys FROM (SELECT r_regionkey, map {'name': r_name, 'key': CAST(r_regionkey AS VARCHAR)} AS m FROM region)")
both("rel_struct", "SELECT n_nationkey, s.name AS name, s.region AS region FROM (SELECT n_nationkey, named_struct('name', n_name, 'region', n_regionkey) AS s FROM nation)", "SELECT n_nationkey, s.name AS name, s.region AS region FROM (SELECT n_nationkey, {'name': n_name, 'region': n_regionkey} AS s FROM nation)")
both("rel_except_columns", "SELECT * EXCEPT (s_name, s_acctbal) FROM supplier", "SELECT * EXCLUDE (s_name, s_acctbal) FROM supplier")
both("src_parquet_scan", "SELECT l_shipdate, l_orderkey FROM lineitem WHERE l_shipdate < timestamp_ntz '1996-03-01 00:00:00'", "SELECT l_shipdate, l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-03-01 00:00:00'")


@query("rel_sample_fraction")
def rel_sample_fraction(t: Tables):
    """TABLESAMPLE's counterpart; which rows it takes is the engine's."""
    return t.orders.sample(0.1, seed=42)


@query("join_left_first", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN (SELECT doc_id, arg_min(quality, (toxic, quality)) AS quality, min(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id")
def join_left_first(t: Tables):
    return joins.left_join_first(t.documents.select("doc_id", "lang", "source"), t.labels, "doc_id", ["toxic", "quality"])


DUPLICATED = "SELECT CASE WHEN n_nationkey % 9 = 0 THEN ' n/a' WHEN n_nationkey % 4 = 0 THEN n_name || ' ' ELSE n_name END AS name, n_nationkey AS v FROM nation UNION ALL SELECT n_name, 100 + n_nationkey FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'NOWHERE ' || CAST(n_nationkey AS STRING), n_nationkey FROM nation WHERE n_nationkey < 3"


def sides(t: Tables):
    t.nation.createOrReplaceTempView("nation")
    return t.spark.sql("SELECT n_name AS name, n_nationkey FROM nation WHERE n_nationkey < 20"), t.spark.sql(DUPLICATED)


@query(
    "join_stats",
    f"""WITH l AS (SELECT n_name AS k, count(*) AS a FROM nation WHERE n_nationkey < 20 GROUP BY 1), d AS ({DUPLICATED.replace("STRING", "VARCHAR")}),
    r AS (SELECT trim(name) AS k, count(*) AS b FROM d WHERE trim(name) <> 'n/a' GROUP BY 1), j AS (SELECT k, a, b FROM l FULL JOIN r USING (k))
    SELECT CAST(coalesce(sum(a) FILTER (b IS NOT NULL), 0) AS BIGINT) AS matched, CAST(coalesce(sum(a) FILTER (b IS NULL), 0) AS BIGINT) AS orphans, CAST(coalesce(sum(b - 1) FILTER (b > 1), 0) AS BIGINT) AS duplicate_keys, count(*) FILTER (a IS NULL) AS unused_right,
    coalesce((SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT k FROM j WHERE b IS NULL ORDER BY k LIMIT 6)), '') AS orphan_keys FROM j""",
)
def join_stats(t: Tables):
    left, right = sides(t)
    return joins.join_audit(left, right, "name")


@query("join_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def join_orphans(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("join_used_right", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def join_used_right(t: Tables):
    return t.labels.join(t.documents, "doc_id", "left_semi").select("doc_id", "quality")


@query("rel_numbered", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS row_number FROM orders")
def rel_numbered(t: Tables):
    return joins.numbered(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_number")


@query("rel_moving_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS m FROM events")
def rel_moving_mean(t: Tables):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-4, 4)
    return t.events.select("event_id", F.avg("value").over(w).alias("m"))
