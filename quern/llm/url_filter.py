"""URL filter: rules first, link-graph propagation for the rest.

A url is judged by the longest rule that fits its host (or a parent domain) and
the start of its path. Urls without a rule get their host's verdict: trust
spreads by personalised PageRank from the hosts with allowed pages along links,
distrust from the hosts with blocked pages against them (who links to a blocked
host is suspect). What reaches a host without links onward goes back to the
seeds, which comes to the same as bringing all trust, and all distrust, to a sum
of one. A host is blocked where distrust is more than ``cut`` of both: a share,
so that the verdicts of a graph don't depend on how many other hosts there are.

Ranks are tables of hosts; each round passes on only what the round before added
and sums per target, and is stored. Rounds end when no more than ``TOLERANCE`` of
all rank is still under way. The longest rule is picked among the few that fit a
host, which are found once per host by an equality join on the host's parent
domains. Built-in functions only.

Defined results: a null url and one without ``://`` have empty host and path and
no rule; hosts that neither seed reaches are allowed; a null html has no links;
relative links and links within a host are no host edges; repeated rows each
give their own row; of rules of one length, that with the longer host wins, then
a blocking one; a very long url or page is read whole in the JVM; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import LOWER, UPPER, discard, stored
from quern.llm.components import FILE_ROWS

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def linked_hosts(html: Column) -> Column:
    """The hosts of a page's absolute links."""
    pieces = F.split(F.coalesce(html, F.lit("")), "(?i)href\\s*=\\s*")
    hosts = F.transform(F.slice(pieces, 2, 1_000_000_000), lambda x: F.regexp_extract(x, "(?i)^[\"']?https?://([^/?#\"'\\s>]*)", 1))
    return F.transform(F.filter(hosts, lambda h: h != ""), lambda h: F.translate(h, UPPER, LOWER))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fitting): the rules of each host's domains as (size, host size, blocks, host, path, verdict)."""
    labels = F.split("host", "\\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = hosts.select("host", F.explode(domains).alias("domain"))
    size = F.length("rule_host") + F.length("rule_path")
    rule = F.struct(size.alias("size"), F.length("rule_host").alias("of_host"), (F.col("verdict") == "block").alias("blocks"), "rule_host", "rule_path", "verdict")
    return each.join(rules, F.col("domain") == F.col("rule_host")).groupBy("host").agg(F.collect_set(rule).alias("fitting"))


def best_rule(fitting: Column, path: Column) -> Column:
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path, r["rule_path"])))


#: The share of all rank that may be missing when rounds end.
TOLERANCE = 1e-13
#: Above this share of distrust a host is blocked; a half, and what sums in another order may differ by.
CUT = 0.5 + 1e-9


def propagated(edges: DataFrame, seeds: DataFrame, damping: float, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust) of every host that rank reaches.

    ``edges``: (src, dst, links); ``seeds``: (host, allowed, blocked) page counts.
    Without ``rounds``, until what is missing is below the tolerance: no round adds
    more than ``damping`` times what the last one added.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all"))
    forth = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    back = edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), (F.col("links") / F.col("all")).alias("share"))
    graph = stored(forth.union(back), "host-graph")
    sums = seeds.agg(F.greatest(F.sum("allowed"), F.lit(1)).alias("a"), F.greatest(F.sum("blocked"), F.lit(1)).alias("b")).first()
    a, b = (sums["a"] or 1, sums["b"] or 1)
    mass = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), (F.col("allowed") / a).alias("seed")), F.struct(F.lit("distrust").alias("kind"), (F.col("blocked") / b).alias("seed")))).alias("m"))
    mass = stored(mass.select("host", "m.*").where("seed > 0"), "host-seeds")
    files = max(1, graph.count() // FILE_ROWS)
    rank = (F.col("seed") * (1 - damping)).alias("rank")
    ranks = stored(mass.select("kind", "host", rank, rank.alias("added")), "host-ranks")
    while rounds is None or rounds > 0:
        moving = ranks.where("added > 0").select(F.col("kind").alias("k"), F.col("host").alias("h"), "added")
        flow = graph.join(moving, (F.col("kind") == F.col("k")) & (F.col("from") == F.col("h")))
        flow = flow.select("kind", F.col("to").alias("host"), (F.col("share") * F.col("added") * damping).alias("rank")).withColumn("added", F.col("rank"))
        kept = ranks.select("kind", "host", "rank", F.lit(0.0).alias("added"))
        before, ranks = ranks, stored(kept.union(flow).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("added").alias("added")).coalesce(files), "host-ranks")
        discard(before)
        if rounds is not None:
            rounds -= 1
        elif (ranks.agg(F.sum("added")).first()[0] or 0.0) * damping <= TOLERANCE * (1 - damping):
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def suspects(ranks: DataFrame, cut: float = CUT) -> DataFrame:
    """(bad): the hosts whose share of distrust is above the cut. ``ranks``: (host, trust, distrust)."""
    all_trust, all_distrust = ranks.agg(F.sum("trust"), F.sum("distrust")).first()
    trust, distrust = F.col("trust") / (all_trust or 1.0), F.col("distrust") / (all_distrust or 1.0)
    return ranks.where(distrust / (trust + distrust) > cut).select(F.col("host").alias("bad"))


def judge_urls(pages: DataFrame, rules: DataFrame, damping: float = 0.85, rounds: int | None = None, cut: float = CUT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each input row."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fitting = stored(fitting_rules(parsed.select("host").distinct(), rules).withColumnRenamed("host", "of"), "host-rules")
    judged = parsed.join(fitting, F.col("host") == F.col("of"), "left").withColumn("r", best_rule(F.col("fitting"), F.col("path")))
    judged = stored(judged.select("page_id", "host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.verdict").alias("said")), "judged-pages")
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked"))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(linked_hosts(F.col("html"))).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''")
    edges = stored(links.groupBy("src", "dst").agg(F.count("*").alias("links")), "host-edges")
    ranks = stored(propagated(edges, stored(seeds, "host-counts"), damping, rounds), "host-trust")
    bad = stored(suspects(ranks, cut), "bad-hosts")
    own = F.when(F.col("bad").isNotNull(), "block").otherwise("allow")
    return judged.join(bad, F.col("host") == F.col("bad"), "left").select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    names = ("rule_host", "rule_path", "verdict")
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rules])))


def op9_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, rule_table(pages.sparkSession, RULES))


def oracle_op9(rounds: int = 12, damping: float = 0.85) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    ranks = "\n".join(
        f"r{i + 1} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (SELECT g.kind, g.t AS host, g.share * r.rank * {damping} AS rank FROM g JOIN r{i} r ON g.kind = r.kind AND g.f = r.host UNION ALL SELECT * FROM r0) GROUP BY kind, host),"
        for i in range(rounds)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT row_number() OVER () AS rid, page_id, html, translate(regexp_extract(coalesce(r, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rh, rp, v) AS (VALUES {values}),
m AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
j AS (SELECT p.*, m.rule, m.v FROM p LEFT JOIN m USING (rid)),
c AS (SELECT host, count(*) FILTER (v = 'allow') AS a, count(*) FILTER (v = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?https?://([^/?#"''\s>]*)', 1)), '{UPPER}', '{LOWER}') AS dst FROM p),
e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
g AS MATERIALIZED (SELECT 'trust' AS kind, src AS f, dst AS t, n / sum(n) OVER (PARTITION BY src) AS share FROM e UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM e),
r0 AS MATERIALIZED (SELECT 'trust' AS kind, host, a / greatest((SELECT sum(a) FROM c), 1) * (1 - {damping}) AS rank FROM c WHERE a > 0 UNION ALL SELECT 'distrust', host, b / greatest((SELECT sum(b) FROM c), 1) * (1 - {damping}) FROM c WHERE b > 0),
{ranks}
k AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d FROM r{rounds} GROUP BY host),
s AS (SELECT host, t / (SELECT greatest(sum(t), 1e-300) FROM k) AS t, d / (SELECT greatest(sum(d), 1e-300) FROM k) AS d FROM k)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN d / (t + d) > {CUT} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN s USING (host)
"""
