"""Splits, encoders, models, metrics, evaluation, series and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import boosting, cluster, counterfactual, encode, evaluate, metrics, models, nearest, resample, split, timeseries, words
from quern.plans.registry import Tables, determines_sql, query


def labelled(t: Tables):
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id")


_L = "l AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id))"


@query("split_stratified", f"WITH {_L}, r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM l) SELECT doc_id, quality, CASE WHEN n >= 2 AND k <= greatest(1, round(n * 0.2)) THEN 'test' ELSE 'train' END AS part FROM r")
def split_stratified(t: Tables):
    return split.stratified(labelled(t).select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "quality", "part")


@query("split_chronological", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN k > n - round(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r")
def split_chronological(t: Tables):
    return split.chronological(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "part")


@query(
    "split_group",
    """WITH g AS (SELECT CAST(o_custkey AS VARCHAR) AS g, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT g, coalesce(sum(n) OVER (ORDER BY md5('42:' || g), g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
    SELECT o_orderkey, CASE WHEN before < 0.2 * total THEN 'test' WHEN before < 0.36 * total THEN 'validation' ELSE 'train' END AS part FROM orders JOIN b ON CAST(o_custkey AS VARCHAR) = g""",
)
def split_group(t: Tables):
    return split.grouped(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "part")


@query("split_kfold", f"WITH {_L} SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1) % 5 AS INTEGER) AS fold FROM l")
def split_kfold(t: Tables):
    return split.k_folds(labelled(t).select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "fold")


@query("sample_nested", f"WITH {_L} SELECT doc_id, round((row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 0.5) / count(*) OVER (PARTITION BY toxic), 6) AS place FROM l")
def sample_nested(t: Tables):
    return split.nested_order(labelled(t).select("doc_id", "toxic"), "toxic", "doc_id").select("doc_id", "place")


@query("sample_capped", f"WITH {_L}, p AS (SELECT doc_id, toxic, (row_number() OVER (PARTITION BY toxic ORDER BY md5('42:' || doc_id), doc_id) - 0.5) / count(*) OVER (PARTITION BY toxic) AS place FROM l) SELECT doc_id FROM p ORDER BY place, toxic, md5('42:' || doc_id) LIMIT 100")
def sample_capped(t: Tables):
    return split.capped(labelled(t).select("doc_id", "toxic"), "toxic", "doc_id", 100).select("doc_id")


@query("sample_hash_order", "SELECT c_custkey, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1 AS place FROM customer")
def sample_hash_order(t: Tables):
    from quern.operators.ordering import numbered

    shuffled = t.customer.select("c_custkey", split.hash_order("c_custkey").alias("o"))
    return numbered(shuffled, ["o", "c_custkey"], "place").select("c_custkey", "place")


@query("sample_balanced_weights", f"WITH {_L} SELECT quality, count(*) AS n, round((SELECT count(*) FROM l) / (2 * count(*)), 6) AS weight FROM l GROUP BY quality")
def sample_balanced_weights(t: Tables):
    return split.class_weights(labelled(t), "quality")


@query("sample_balanced", f"WITH {_L}, r AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM l), m AS (SELECT max(n) AS most FROM r) SELECT doc_id, unnest(range(1, (most - k) // n + 2)) AS copy FROM r, m")
def sample_balanced(t: Tables):
    return split.balanced(labelled(t).select("doc_id", "quality"), "quality", "doc_id").select("doc_id", "copy")


@query("class_majority_share", f"WITH {_L} SELECT round(max(n) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM l GROUP BY quality)")
def class_majority_share(t: Tables):
    return labelled(t).groupBy("quality").agg(F.count("*").alias("n")).agg((F.max("n") / F.sum("n")).alias("share"))


@query("encode_numeric", "WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders) SELECT o_orderkey, round((o_totalprice - m) / d, 6) AS o_totalprice FROM orders, s")
def encode_numeric(t: Tables):
    return encode.encoded(t.orders, encode.fit_numeric(t.orders, ["o_totalprice"]), ["o_orderkey"])


@query("encode_onehot", "SELECT o_orderkey, " + ", ".join(f"CAST(o_orderpriority = '{p}' AS DOUBLE) AS \"o_orderpriority={p}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def encode_onehot(t: Tables):
    return encode.encoded(t.orders, encode.fit_one_hot(t.orders, ["o_orderpriority"]), ["o_orderkey"])


@query(
    "encode_ordinal",
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT source, row_number() OVER (ORDER BY n DESC, source) - 1 AS rank FROM c), d AS (SELECT doc_id, rank FROM documents JOIN r USING (source)), s AS (SELECT avg(rank) AS m, stddev_pop(rank) AS sd FROM d)
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, round((rank - m) / sd, 6) AS z FROM d, s""",
)
def encode_ordinal(t: Tables):
    return encode.ordinal(t.documents, "source", ["doc_id"])


@query("encode_filled", "SELECT 'price' AS \"column\", count(*) FILTER (o_orderkey % 11 = 0) AS empty, count(*) FILTER (o_orderkey % 11 <> 0 AND o_orderkey % 7 = 0) AS unreadable FROM orders")
def encode_filled(t: Tables):
    price = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderkey") % 7 == 0, "x1").otherwise(F.col("o_totalprice").cast("string"))
    return encode.filled_cells(t.orders.select(price.alias("price")), ["price"])


_TOKENS = "k AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: len(w) >= 3) AS w FROM part), v AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM k) GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 256), i AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM part)) / (1 + df)) + 1 AS idf FROM v)"


def part_texts(t: Tables):
    return t.part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("words"))


@query("text_tfidf_vocab", f"WITH {_TOKENS} SELECT term, df, round(idf, 6) AS idf FROM i")
def text_tfidf_vocab(t: Tables):
    return encode.tfidf_vocabulary(part_texts(t), "words")


@query("text_tfidf_vector", f"WITH {_TOKENS}, w AS (SELECT p_partkey, term, count(*) * max(idf) AS x FROM (SELECT p_partkey, unnest(w) AS term FROM k) JOIN i USING (term) GROUP BY 1, 2) SELECT p_partkey, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS weight FROM w")
def text_tfidf_vector(t: Tables):
    df = part_texts(t)
    return encode.tfidf_vectors(df, "p_partkey", "words", encode.tfidf_vocabulary(df, "words"))


@query(
    "text_word_effects",
    f"""WITH {_TOKENS}, w AS (SELECT p_partkey, term, count(*) * max(idf) AS x, count(*) * max(idf) * (len(term) - 5) AS wx FROM (SELECT p_partkey, unnest(w) AS term FROM k) JOIN i USING (term) GROUP BY 1, 2),
    d AS (SELECT p_partkey, sum(wx) AS s, sum(x * x) AS q, count(*) AS n FROM w GROUP BY 1), e AS (SELECT term, 1 / (1 + exp(-(0.5 + s / sqrt(q)))) - 1 / (1 + exp(-(0.5 + CASE WHEN n = 1 THEN 0 ELSE (s - wx) / sqrt(CASE WHEN n = 1 THEN 1 ELSE q - x * x END) END))) AS shift FROM w JOIN d USING (p_partkey))
    SELECT term AS word, count(*) AS rows, round(avg(shift), 6) + 0.0 AS effect FROM e GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 40""",
)
def text_word_effects(t: Tables):
    """A model whose weights are the words' lengths less five."""
    df = part_texts(t)
    found = encode.tfidf_vocabulary(df, "words").collect()
    model = words.WordModel(tuple(r["term"] for r in found), tuple(r["idf"] for r in found), tuple(float(len(r["term"]) - 5) for r in found), 0.5, True)
    return words.word_effects(df, "words", model, top=None)


@query("text_model_effects")
def text_model_effects(t: Tables):
    """What the words of documents say of their quality: fitted on four rows in five, told on the fifth."""
    df = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id").select("doc_id", "text", "quality")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    return words.word_effects(df.where(held), "text", words.fit_words(df.where(~held), "text", "quality"))


@query("task_detect", "SELECT 'quality' AS target, count(DISTINCT quality) AS \"distinct\", 'binary' AS task FROM labels UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'regression' FROM orders UNION ALL SELECT 'lang', count(DISTINCT lang), 'multiclass' FROM documents")
def task_detect(t: Tables):
    return encode.task_of(t.labels, "quality").union(encode.task_of(t.orders, "o_totalprice")).union(encode.task_of(t.documents, "lang"))


@query("leak_mapping", determines_sql("(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey)", [("n_name", "n_regionkey"), ("n_regionkey", "n_name")]))
def leak_mapping(t: Tables):
    from quern.operators.profile import determines

    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return determines(df, [("n_name", "n_regionkey"), ("n_regionkey", "n_name")])


@query(
    "leak_stump_accuracy",
    f"""WITH {_L}, r AS (SELECT *, doc_id % 5 = 0 AS v FROM l), c AS (SELECT source, quality, count(*) AS n FROM r WHERE NOT v GROUP BY 1, 2), m AS (SELECT source, arg_min(quality, (-n, quality)) AS guess FROM c GROUP BY 1), g AS (SELECT quality AS fallback FROM r WHERE NOT v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT round(avg(CAST(quality = coalesce(guess, fallback) AS DOUBLE)), 6) AS accuracy FROM (SELECT * FROM r WHERE v) LEFT JOIN m USING (source), g""",
)
def leak_stump_accuracy(t: Tables):
    rows = labelled(t)
    train, held = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    counts = train.groupBy("source", "quality").agg(F.count("*").alias("n"))
    guess = counts.groupBy("source").agg(F.min_by("quality", F.struct(-F.col("n"), "quality")).alias("guess"))
    fallback = counts.groupBy("quality").agg(F.sum("n").alias("n")).agg(F.min_by("quality", F.struct(-F.col("n"), "quality")).alias("fallback"))
    told = held.join(guess, "source", "left").crossJoin(F.broadcast(fallback)).withColumn("p", F.coalesce("guess", "fallback"))
    return metrics.accuracy(told, "quality", "p")


@query(
    "leak_stump_r2",
    """WITH m AS (SELECT p_brand, avg(p_retailprice) AS g FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1), h AS (SELECT p_retailprice AS y, coalesce(g, (SELECT avg(p_retailprice) FROM part WHERE p_partkey % 5 <> 0)) AS f FROM part LEFT JOIN m USING (p_brand) WHERE p_partkey % 5 = 0)
    SELECT round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(1 - avg((y - f) ** 2) / var_pop(y), 6) AS r2 FROM h""",
)
def leak_stump_r2(t: Tables):
    train = t.part.where("p_partkey % 5 <> 0")
    guess = train.groupBy("p_brand").agg(F.avg("p_retailprice").alias("g"))
    whole = train.agg(F.avg("p_retailprice").alias("w"))
    told = t.part.where("p_partkey % 5 = 0").join(guess, "p_brand", "left").crossJoin(F.broadcast(whole)).withColumn("f", F.coalesce("g", "w"))
    return metrics.regression(told, "p_retailprice", "f")


@query("ml_baseline", f"WITH {_L}, c AS (SELECT quality, count(*) AS n FROM l GROUP BY 1) SELECT quality, round(n / (SELECT sum(n) FROM c), 6) AS share, quality = (SELECT quality FROM c ORDER BY n DESC, quality LIMIT 1) AS is_prediction FROM c")
def ml_baseline(t: Tables):
    return models.baseline(labelled(t), "quality")


@query("ml_linear", "SELECT p_partkey, round(s * p_size + i, 2) AS predicted FROM part, (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part)")
def ml_linear(t: Tables):
    model = models.fit_linear(t.part, ["p_size"], "p_retailprice")
    return t.part.select("p_partkey", F.round(model.predict(), 2).alias("predicted"))


_DIMS = 64  # all of an embedding


def vectors(t: Tables):
    return t.embeddings.select("vec_id", "label", "embedding", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(_DIMS)])


_V = "v AS (SELECT vec_id, label, embedding, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(_DIMS)) + " FROM embeddings)"


@query(
    "ml_naive_bayes",
    f"WITH {_V}, s AS (SELECT label, count(*) AS n, "
    + ", ".join(f"avg(x{i}) AS m{i}, greatest(var_pop(x{i}), 1e-9) AS w{i}" for i in range(_DIMS))
    + " FROM v WHERE vec_id % 4 <> 0 GROUP BY label), k AS (SELECT count(*) AS k, sum(n) AS t FROM s), j AS (SELECT vec_id, s.label, ln((n + 1) / (t + k))"
    + "".join(f" - 0.5 * (ln(2 * pi() * w{i}) + (x{i} - m{i}) ** 2 / w{i})" for i in range(_DIMS))
    + " AS s FROM (SELECT * FROM v WHERE vec_id % 4 = 0), s, k) SELECT vec_id, arg_max(label, (s, -label)) AS predicted FROM j GROUP BY vec_id",
)
def ml_naive_bayes(t: Tables):
    v = vectors(t)
    return models.naive_bayes(v.where("vec_id % 4 <> 0"), v.where("vec_id % 4 = 0"), "label", [f"x{i}" for i in range(_DIMS)], "vec_id")


_KNN = f"""WITH {_V}, d AS (SELECT p.vec_id AS p, t.vec_id AS n, t.label, sqrt(list_sum(list_transform(range(1, len(p.embedding) + 1), lambda i: (CAST(p.embedding[i] AS DOUBLE) - t.embedding[i]) ** 2))) AS d FROM v p, v t WHERE p.vec_id % 20 = 0 AND t.vec_id % 20 <> 0),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d, n) AS r FROM d) WHERE r <= 5)"""


@query("ml_knn_classify", f"{_KNN}, c AS (SELECT p, label, count(*) AS n FROM k GROUP BY 1, 2) SELECT p AS vec_id, arg_min(label, (-n, label)) AS predicted FROM c GROUP BY p")
def ml_knn_classify(t: Tables):
    """Every vector whose id 20 divides, against all others."""
    e = t.embeddings
    return models.knn_vote(nearest.neighbours(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "embedding", "vec_id", "label"), "vec_id")


@query("ml_knn_regress", f"{_KNN} SELECT p AS vec_id, round(avg(label), 6) AS predicted FROM k GROUP BY p")
def ml_knn_regress(t: Tables):
    e = t.embeddings
    return models.knn_mean(nearest.neighbours(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "embedding", "vec_id", "label"), "vec_id")


@query(
    "nearest_distance",
    "WITH d AS (SELECT q.vec_id AS p, t.vec_id AS k, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (CAST(q.embedding[i] AS DOUBLE) - t.embedding[i]) ** 2))) AS d FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND t.vec_id % 20 <> 0) "
    "SELECT p AS vec_id, round(min(d), 6) AS distance, arg_min(k, (d, k)) AS nearest FROM d GROUP BY p",
)
def nearest_distance(t: Tables):
    """How far every vector whose id 20 divides is from the nearest of all others."""
    e = t.embeddings
    return nearest.nearest_distance(e.where("vec_id % 20 <> 0"), e.where("vec_id % 20 = 0"), "embedding", "vec_id")


_SCORED = "p AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 101.0 * 0.6 + 0.3 * quality AS s, CASE WHEN doc_id % 9 = 0 THEN 1 - quality ELSE quality END AS c, lang FROM documents JOIN labels USING (doc_id))"


def scored(t: Tables):
    s = (F.col("doc_id") * 37 % 101) / 101.0 * 0.6 + 0.3 * F.col("quality")
    c = F.when(F.col("doc_id") % 9 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return labelled(t).select("doc_id", F.col("quality").alias("y"), s.alias("s"), c.alias("c"), "lang", "source")


@query("ml_blend", f"WITH {_SCORED} SELECT doc_id, round((s + (1 - s) + c) / 3, 6) AS score FROM p")
def ml_blend(t: Tables):
    return models.blend(scored(t).withColumns({"a": F.col("s"), "b": 1 - F.col("s"), "d": F.col("c").cast("double")}), "doc_id", ["a", "b", "d"])


def _family(family: str) -> None:
    @query(f"ml_{family}")
    def fit(t: Tables):
        """A family of MLlib on all training rows; its trees and weights have no SQL."""
        v = vectors(t)
        rows = models.assembled(v, [f"x{i}" for i in range(_DIMS)], "label", ["vec_id"])
        classes = v.agg(F.max("label")).first()[0] + 1
        return models.fit_predict(family, rows.where("vec_id % 4 <> 0"), rows.where("vec_id % 4 = 0"), ["vec_id"], classes, _DIMS).select("vec_id", "predicted")


for _name in ("logistic", "tree", "forest", "mlp"):
    _family(_name)


_PART_X = {"p_size": "p_size", "brand": "CAST(substr(p_brand, 7) AS INTEGER)", "place": "p_partkey % 1000"}


def part_rows(t: Tables):
    x = F.array(*[F.expr(e).cast("double") for e in _PART_X.values()])
    return t.part.select("p_partkey", x.alias("x"), "p_retailprice")


@query("ml_boosting_regress")
def ml_boosting_regress(t: Tables):
    """120 rounds on three features; its trees have no SQL, the first round's splits do (``ml_boosting_round``)."""
    rows = part_rows(t)
    model = boosting.fit_regressor(rows.where("p_partkey % 4 <> 0"), "x", "p_retailprice")
    return rows.where("p_partkey % 4 = 0").select("p_partkey", F.get(model.predict("x"), F.lit(0)).alias("predicted"))


@query("ml_boosting_classify")
def ml_boosting_classify(t: Tables):
    """Quality of documents from their length, language and source, one booster for two classes."""
    rows = labelled(t).select("doc_id", F.array(F.col("n_chars").cast("double"), F.pmod(F.xxhash64("lang"), F.lit(97)).cast("double"), F.pmod(F.xxhash64("source"), F.lit(97)).cast("double")).alias("x"), "quality")
    model = boosting.fit_classifier(rows.where("doc_id % 4 <> 0"), "x", "quality", 2)
    return rows.where("doc_id % 4 = 0").select("doc_id", F.get(model.predict("x"), F.lit(1)).alias("share"))


_GAIN = "0.5 * (power(lg, 2) / (ln + 1) + power(ag - lg, 2) / (an - ln + 1) - power(ag, 2) / (an + 1))"


@query(
    "ml_boosting_round",
    f"""WITH x AS (SELECT unnest(range(3)) AS f, unnest([{', '.join(f'CAST({e} AS DOUBLE)' for e in _PART_X.values())}]) AS v, (SELECT avg(p_retailprice) FROM part) - p_retailprice AS g FROM part),
    d AS (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) AS k, count(*) OVER (PARTITION BY f) AS n FROM (SELECT DISTINCT f, v FROM x)),
    e AS (SELECT f, v AS edge FROM d WHERE k < n AND (n <= 32 OR k = (((k * 32 + n - 1) // n) * n) // 32)),
    s AS (SELECT e.f, edge, count(*) FILTER (v <= edge) AS ln, sum(g) FILTER (v <= edge) AS lg, count(*) AS an, sum(g) AS ag FROM e JOIN x ON e.f = x.f GROUP BY e.f, edge)
    SELECT CAST(f AS INTEGER) AS feature, edge, ln AS rows, round({_GAIN}, 3) AS gain, round(-lg / (ln + 1), 6) AS "left", round(-(ag - lg) / (an - ln + 1), 6) AS "right" FROM s WHERE ln >= 10 AND an - ln >= 10""",
)
def ml_boosting_round(t: Tables):
    """Every split of the first tree's root with its gain and both leaves: what the first round chooses from."""
    return boosting.root_splits(part_rows(t), "x", "p_retailprice").withColumn("gain", F.round("gain", 3))


@query("eval_replay_boosting")
def eval_replay_boosting(t: Tables):
    """Each part's way through every tree: steps, the leaf's part, and what the trees so far come to."""
    rows = part_rows(t)
    model = boosting.fit_regressor(rows.where("p_partkey % 4 <> 0"), "x", "p_retailprice", boosting.Settings(rounds=20))
    told = rows.select("p_partkey", F.posexplode(model.replay("x")).alias("tree", "r"))
    return told.select("p_partkey", "tree", F.size("r.path").alias("nodes"), F.get("r.value", F.lit(0)).alias("leaf"), F.get("r.so_far", F.lit(0)).alias("so_far"))


@query("metric_accuracy", f"WITH {_SCORED} SELECT round(avg(CAST(y = c AS DOUBLE)), 6) AS accuracy FROM p")
def metric_accuracy(t: Tables):
    return metrics.accuracy(scored(t), "y", "c")


@query("metric_confusion", f"WITH {_SCORED} SELECT y AS truth, c AS predicted, count(*) AS n FROM p GROUP BY 1, 2")
def metric_confusion(t: Tables):
    return metrics.confusion(scored(t), "y", "c")


@query(
    "metric_macro_prf",
    f"""WITH {_SCORED}, k AS (SELECT y AS k FROM p UNION SELECT c FROM p), m AS (SELECT k, count(*) FILTER (y = k AND c = k) AS tp, count(*) FILTER (y = k) AS a, count(*) FILTER (c = k) AS b FROM p, k GROUP BY k)
    SELECT round(avg(tp / b), 6) AS precision, round(avg(tp / a), 6) AS recall, round(avg(2 * tp / (a + b)), 6) AS f1 FROM m""",
)
def metric_macro_prf(t: Tables):
    return metrics.macro_prf(scored(t), "y", "c")


@query("metric_logloss", f"WITH {_SCORED} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(s, 1e-15)) ELSE ln(greatest(1 - s, 1e-15)) END), 6) AS log_loss FROM p")
def metric_logloss(t: Tables):
    return metrics.log_loss(scored(t), "y", "s")


@query("metric_auc", f"WITH {_SCORED}, a AS (SELECT count(*) FILTER (n.s < q.s) + 0.5 * count(*) FILTER (n.s = q.s) AS won FROM (SELECT s FROM p WHERE y = 1) q, (SELECT s FROM p WHERE y = 0) n) SELECT round(won / ((SELECT count(*) FROM p WHERE y = 1) * (SELECT count(*) FROM p WHERE y = 0)), 6) AS auc FROM a")
def metric_auc(t: Tables):
    return metrics.roc_auc(scored(t), "y", "s")


_CURVE = f"WITH {_SCORED}, g AS (SELECT s, sum(y) AS a, count(*) AS n FROM p GROUP BY s), r AS (SELECT s, sum(a) OVER w AS tp, sum(n) OVER w AS k, (SELECT sum(y) FROM p) AS pos FROM g WINDOW w AS (ORDER BY s DESC))"


@query("metric_pr_curve", f"{_CURVE} SELECT round(s, 6) AS score, round(tp / k, 6) AS precision, round(tp / pos, 6) AS recall FROM r")
def metric_pr_curve(t: Tables):
    return metrics.pr_curve(scored(t), "y", "s")


@query("metric_average_precision", f"{_CURVE}, x AS (SELECT tp / k AS pr, tp / pos - coalesce(lag(tp / pos) OVER (ORDER BY s DESC), 0) AS d FROM r) SELECT round(sum(pr * d), 6) AS average_precision FROM x")
def metric_average_precision(t: Tables):
    return metrics.average_precision(scored(t), "y", "s")


@query("threshold_best_cost", f"{_CURVE} SELECT round(s, 6) AS threshold, round(CAST((pos - tp) * 5 + (k - tp) AS DOUBLE), 6) AS cost FROM r ORDER BY cost, s DESC LIMIT 1")
def threshold_best_cost(t: Tables):
    return metrics.best_threshold(scored(t), "y", "s")


@query("metric_calibration", f"WITH {_SCORED} SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(CAST(y AS DOUBLE)), 6) AS share FROM p GROUP BY 1")
def metric_calibration(t: Tables):
    return metrics.calibration(scored(t), "y", "s")


@query("metric_brier", f"WITH {_SCORED} SELECT round(avg((s - y) ** 2), 6) AS brier FROM p")
def metric_brier(t: Tables):
    return metrics.brier(scored(t), "y", "s")


@query("metric_regression", "WITH e AS (SELECT p_retailprice AS y, 900.0 + p_size * 10 AS f FROM part) SELECT round(sqrt(avg((y - f) ** 2)), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae, round(1 - avg((y - f) ** 2) / var_pop(y), 6) AS r2 FROM e")
def metric_regression(t: Tables):
    return metrics.regression(t.part.withColumn("f", 900.0 + F.col("p_size") * 10), "p_retailprice", "f")


@query(
    "metric_residuals",
    "WITH e AS (SELECT p_retailprice - (900.0 + p_size * 10) AS x FROM part), m AS (SELECT min(x) AS low, max(x) AS high FROM e), b AS (SELECT CAST(least(floor((x - low) / ((high - low) / 12)), 11) AS INTEGER) AS bin, low, high FROM e, m) SELECT bin, round(low + bin * ((high - low) / 12), 6) AS low, round(low + (bin + 1) * ((high - low) / 12), 6) AS high, count(*) AS count FROM b GROUP BY bin, b.low, b.high",
)
def metric_residuals(t: Tables):
    return metrics.residuals(t.part.withColumn("f", 900.0 + F.col("p_size") * 10), "p_retailprice", "f")


@query("metric_rank_models", "SELECT model, v, CAST(row_number() OVER (ORDER BY v DESC, model) AS INTEGER) AS place FROM (VALUES ('a', 0.8), ('b', 0.9), ('c', 0.8)) t(model, v)".replace("v, CAST", "CAST(v AS DOUBLE) AS v, CAST"))
def metric_rank_models(t: Tables):
    return metrics.rank_models(t.spark.sql("SELECT * FROM VALUES ('a', 0.8D), ('b', 0.9D), ('c', 0.8D) AS t(model, v)"), "v", True)


@query("eval_segments", f"WITH {_SCORED} SELECT lang AS segment, count(*) AS n, round(avg(CAST(y = c AS DOUBLE)), 6) AS accuracy FROM p GROUP BY 1 HAVING count(*) >= 8 ORDER BY 2 DESC, 1 LIMIT 8")
def eval_segments(t: Tables):
    return evaluate.segments(scored(t), "lang", "y", "c")


@query(
    "eval_group_audit",
    f"""WITH {_SCORED}, g AS (SELECT lang AS "group", count(*) AS n, count(*) FILTER (c = 1) AS sel, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 1 AND c = 1) AS tp, count(*) FILTER (y = c) AS ok FROM p GROUP BY 1 HAVING count(*) >= 20)
    SELECT "group", n, round(sel / n, 6) AS selection, CASE WHEN pos >= 10 THEN round(tp / pos, 6) END AS recall, round(ok / n, 6) AS accuracy, round(ok / n - first_value(ok / n) OVER (ORDER BY n DESC, "group"), 6) AS accuracy_gap FROM g""",
)
def eval_group_audit(t: Tables):
    return evaluate.group_audit(scored(t), "lang", "y", "c").select("group", "n", "selection", "recall", "accuracy", "accuracy_gap")


@query(
    "eval_value_audit",
    """WITH e AS (SELECT p_brand AS g, 900.0 + p_size * 10 - p_retailprice AS e FROM part), a AS (SELECT g, count(*) AS n, avg(e) AS bias, avg(abs(e)) AS mae FROM e GROUP BY 1 HAVING count(*) >= 20 ORDER BY 2 DESC, 1 LIMIT 8)
    SELECT g AS "group", n, round(bias, 6) + 0.0 AS bias, round(mae, 6) AS mae, round(bias - first_value(bias) OVER w, 6) + 0.0 AS bias_gap, round(mae - first_value(mae) OVER w, 6) + 0.0 AS mae_gap FROM a WHERE (SELECT count(*) FROM a) > 1 WINDOW w AS (ORDER BY n DESC, g)""",
)
def eval_value_audit(t: Tables):
    df = t.part.withColumn("f", 900.0 + F.col("p_size") * 10)
    return evaluate.value_audit(df, "p_brand", "p_partkey", "p_retailprice", "f").select("group", "n", "bias", "mae", "bias_gap", "mae_gap")


@query("eval_conformal_reg", "WITH e AS (SELECT p_partkey, abs(p_retailprice - (900.0 + p_size * 10)) AS e FROM part), c AS (SELECT e FROM e WHERE p_partkey % 2 = 0), q AS (SELECT e AS q FROM (SELECT e, row_number() OVER (ORDER BY e) AS k FROM c) WHERE k = CAST(ceil(((SELECT count(*) FROM c) + 1) * 0.9 - 1e-9) AS BIGINT)) SELECT round(q, 6) AS quantile, count(*) AS n, round(avg(CAST(e <= q AS DOUBLE)), 6) AS covered FROM e, q WHERE p_partkey % 2 = 1 GROUP BY q")
def eval_conformal_reg(t: Tables):
    e = t.part.select("p_partkey", F.abs(F.col("p_retailprice") - (900.0 + F.col("p_size") * 10)).alias("e"))
    return evaluate.conformal_coverage(e.where("p_partkey % 2 = 0"), e.where("p_partkey % 2 = 1"), "e", 0.1)


@query("eval_conformal_cls", f"WITH {_SCORED}, e AS (SELECT doc_id, 1 - CASE WHEN y = 1 THEN s ELSE 1 - s END AS e FROM p), c AS (SELECT e FROM e WHERE doc_id % 2 = 0), q AS (SELECT e AS q FROM (SELECT e, row_number() OVER (ORDER BY e) AS k FROM c) WHERE k = CAST(ceil(((SELECT count(*) FROM c) + 1) * 0.8 - 1e-9) AS BIGINT)) SELECT round(q, 6) AS quantile, count(*) AS n, round(avg(CAST(e <= q AS DOUBLE)), 6) AS covered FROM e, q WHERE doc_id % 2 = 1 GROUP BY q")
def eval_conformal_cls(t: Tables):
    e = scored(t).select("doc_id", (1 - F.when(F.col("y") == 1, F.col("s")).otherwise(1 - F.col("s"))).alias("e"))
    return evaluate.conformal_coverage(e.where("doc_id % 2 = 0"), e.where("doc_id % 2 = 1"), "e", 0.2)


@query(
    "eval_multiclass_policy",
    "WITH p AS (SELECT o_orderkey, [(o_orderkey % 7) / 14.0, (o_orderkey % 5) / 10.0, 1 - (o_orderkey % 7) / 14.0 - (o_orderkey % 5) / 10.0] AS p FROM orders), x AS (SELECT o_orderkey, [(p[1] - 0.3) / 0.7, (p[2] - 0.3) / 0.7, (p[3] - 0.45) / 0.55] AS x FROM p) SELECT o_orderkey, CAST(CASE WHEN list_max(x) >= 0 THEN list_position(x, list_max(x)) - 1 ELSE -1 END AS INTEGER) AS choice FROM x",
)
def eval_multiclass_policy(t: Tables):
    a, b = (F.col("o_orderkey") % 7) / 14.0, (F.col("o_orderkey") % 5) / 10.0
    p = F.array(a, b, 1 - a - b)
    return t.orders.select("o_orderkey", evaluate.multiclass_policy(p, [0.3, 0.3, 0.45]).cast("int").alias("choice"))


@query("eval_bootstrap")
def eval_bootstrap(t: Tables):
    """The interval of an accuracy from 1 000 resamples by hash."""
    df = scored(t)
    return evaluate.bootstrap(df, "doc_id", (F.col("y") == F.col("c")).cast("double"))


def _paired(metric: str) -> None:
    @query(f"eval_paired_{metric}")
    def paired(t: Tables):
        """Two models and a constant on the same 1 000 resamples by hash; intervals have no SQL, ``eval_paired_estimates`` has what they are around."""
        df = scored(t)
        if metric == "auc":
            models = {"score": F.col("s"), "class": F.col("c").cast("double"), "constant": F.lit(0.5)}
        else:
            models = {"score": (F.col("s") > 0.6).cast("int"), "class": F.col("c"), "constant": F.lit(1)}
        return resample.paired_intervals(df, "doc_id", "y", models, metric, "constant")


for _metric in ("accuracy", "macro_f1", "auc"):
    _paired(_metric)


@query(
    "eval_paired_estimates",
    f"""WITH {_SCORED}, r AS (SELECT y, s, c, avg(y) OVER () AS share FROM p), ranked AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS b FROM p),
    n AS (SELECT sum(y) AS up, count(*) - sum(y) AS down FROM p)
    SELECT 'class' AS model, round((sum(b) FILTER (y = 1) - any_value(up) * (any_value(up) + 1) / 2) / (any_value(up) * any_value(down)), 6) AS estimate FROM ranked, n
    UNION ALL SELECT 'score', round((sum(a) FILTER (y = 1) - any_value(up) * (any_value(up) + 1) / 2) / (any_value(up) * any_value(down)), 6) FROM ranked, n""",
)
def eval_paired_estimates(t: Tables):
    """The areas that paired intervals lie around, by the ranges of score that they are taken with."""
    found = resample.resampled(scored(t), "doc_id", "y", {"score": F.col("s"), "class": F.col("c").cast("double")}, "auc", 20)
    return found.where("b = 0").select("model", F.col("value").alias("estimate"))


@query("eval_partial_dependence", "WITH g AS (SELECT unnest(range(0, 20)) AS i), m AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part) SELECT round(a + (b - a) * i / 19, 6) AS x, round(avg(2 * (a + (b - a) * i / 19) + p_retailprice / 10), 6) AS mean FROM part, g, m GROUP BY a, b, i")
def eval_partial_dependence(t: Tables):
    return evaluate.partial_dependence(t.part.withColumn("p_size", F.col("p_size").cast("double")), "p_size", 2 * F.col("p_size") + F.col("p_retailprice") / 10)


@query("eval_permutation_importance")
def eval_permutation_importance(t: Tables):
    df = t.part.select("p_partkey", F.col("p_size").cast("double").alias("a"), "p_retailprice").withColumn("y", 3 * F.col("a") + F.col("p_retailprice") * 0.01)
    return evaluate.permutation_importance(df, ["a", "p_retailprice"], 3 * F.col("a") + F.col("p_retailprice") * 0.01, "y", "p_partkey")


@query("eval_counterfactuals")
def eval_counterfactuals(t: Tables):
    df = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    score = F.col("size") * 20 + F.col("price")
    return evaluate.counterfactuals(df, {"size": [float(x) for x in range(0, 51, 5)], "price": [float(x) for x in range(900, 2100, 100)]}, score, score > 2000, "p_partkey")


@query("eval_counterfactuals_two")
def eval_counterfactuals_two(t: Tables):
    """Changes in one or two columns that bring a part above a score, with plausibility; small ones are held against the full grid in tests."""
    df = t.part.select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), F.substring("p_brand", 1, 7).alias("brand"))
    score = F.col("size") * 20 + F.col("price") + F.when(F.col("brand") == "Brand#5", 300.0).otherwise(0.0)
    return counterfactual.search(df.where("p_partkey % 20 = 0"), df, ["size", "price", "brand"], score, F.col("predicted") > 1900, "p_partkey")


@query("ledger_levels", "WITH l AS (SELECT c_nationkey % 6 AS test_set, c_custkey % (1 + c_nationkey % 6 * 3) AS config FROM customer) SELECT test_set, count(DISTINCT config) AS configs, CASE WHEN count(DISTINCT config) >= 10 THEN 'worn' WHEN count(DISTINCT config) >= 5 THEN 'used' WHEN count(DISTINCT config) >= 2 THEN 'seen' ELSE 'fresh' END AS level FROM l GROUP BY 1")
def ledger_levels(t: Tables):
    return evaluate.ledger_levels(t.customer.select((F.col("c_nationkey") % 6).alias("test_set"), (F.col("c_custkey") % (1 + F.col("c_nationkey") % 6 * 3)).alias("config")))


@query("monitor_performance", f"WITH {_SCORED} SELECT round(avg(CAST(y = c AS DOUBLE)) FILTER (doc_id % 2 = 0), 6) AS reference, round(avg(CAST(y = c AND doc_id % 3 <> 0 AS DOUBLE)) FILTER (doc_id % 2 = 1), 6) AS current, 'retrain' AS verdict FROM p")
def monitor_performance(t: Tables):
    df = scored(t).withColumn("right", F.col("y") == F.col("c"))
    worse = df.where("doc_id % 2 = 1").withColumn("right", F.col("right") & (F.col("doc_id") % 3 != 0))
    return evaluate.performance_signal(df.where("doc_id % 2 = 0"), worse, "right").select("reference", "current", "verdict")


_DAYS = "s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, avg(value) AS y FROM events GROUP BY 1)"


def daily(t: Tables):
    return timeseries.build_series(t.events.withColumn("day", F.to_date("ts")), "day", "value")


@query("ts_build", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS t, round(avg(value), 6) AS y, count(*) AS n FROM events GROUP BY 1")
def ts_build(t: Tables):
    return daily(t).withColumn("t", F.col("t").cast("string"))


@query(
    "ts_frequency",
    f"WITH {_DAYS}, g AS (SELECT date_diff('second', CAST(lag(day) OVER (ORDER BY day) AS TIMESTAMP), CAST(day AS TIMESTAMP)) AS g FROM s), m AS (SELECT g AS seconds FROM (SELECT g, row_number() OVER (ORDER BY g) AS i, count(*) OVER () AS n FROM g WHERE g IS NOT NULL) WHERE i = n // 2 + 1) "
    "SELECT seconds, CASE WHEN d <= 1.5 THEN 'daily' WHEN d <= 10 THEN 'weekly' WHEN d <= 45 THEN 'monthly' WHEN d <= 135 THEN 'quarterly' WHEN d <= 550 THEN 'yearly' ELSE 'irregular' END AS frequency, "
    "CASE WHEN d <= 1.5 THEN 7 WHEN d <= 10 THEN NULL WHEN d <= 45 THEN 12 WHEN d <= 135 THEN 4 END AS period FROM (SELECT seconds, seconds / 86400.0 AS d FROM m)",
)
def ts_frequency(t: Tables):
    return timeseries.frequency(daily(t))


@query("ts_backtest_naive", f"WITH {_DAYS}, f AS (SELECT day, y, lag(y) OVER (ORDER BY day) AS f FROM s) SELECT day AS t, round(y, 6) AS y, round(f, 6) AS forecast, round(abs(y - f), 6) AS error FROM f WHERE f IS NOT NULL")
def ts_backtest_naive(t: Tables):
    return timeseries.backtest_lag(daily(t)).withColumn("t", F.col("t").cast("string"))


@query("ts_backtest_seasonal", f"WITH {_DAYS}, f AS (SELECT day, y, lag(y, 7) OVER (ORDER BY day) AS f FROM s) SELECT day AS t, round(y, 6) AS y, round(f, 6) AS forecast, round(abs(y - f), 6) AS error FROM f WHERE f IS NOT NULL")
def ts_backtest_seasonal(t: Tables):
    return timeseries.backtest_lag(daily(t), 7).withColumn("t", F.col("t").cast("string"))


@query("ts_ses", f"WITH RECURSIVE {_DAYS}, k AS (SELECT y, row_number() OVER (ORDER BY day) AS i FROM s), r(i, level) AS (SELECT i, y FROM k WHERE i = 1 UNION ALL SELECT k.i, 0.5 * k.y + 0.5 * r.level FROM r JOIN k ON k.i = r.i + 1) SELECT CAST(i - 1 AS INTEGER) AS pos, round(level, 6) AS level FROM r")
def ts_ses(t: Tables):
    told = timeseries.Scan(daily(t), [timeseries.ses(0.5)]).every_state()
    return told.select(F.col("pos").cast("int").alias("pos"), "level")


@query(
    "ts_holt",
    f"""WITH RECURSIVE {_DAYS}, k AS (SELECT y, row_number() OVER (ORDER BY day) AS i FROM s), r(i, level, trend) AS (SELECT k.i, k.y, n.y - k.y FROM k JOIN k n ON n.i = 2 WHERE k.i = 1
    UNION ALL SELECT k.i, 0.5 * k.y + 0.5 * (r.level + r.trend), 0.1 * (0.5 * k.y + 0.5 * (r.level + r.trend) - r.level) + 0.9 * r.trend FROM r JOIN k ON k.i = r.i + 1) SELECT round(level, 6) AS level, round(trend, 6) AS trend FROM r ORDER BY i DESC LIMIT 1""",
)
def ts_holt(t: Tables):
    return timeseries.Scan(daily(t), [timeseries.holt(0.5, 0.1)]).last_states().select("level", "trend")


@query(
    "ts_holt_winters",
    f"""WITH RECURSIVE {_DAYS}, k AS (SELECT y, row_number() OVER (ORDER BY day) AS i FROM s), h AS (SELECT avg(y) FILTER (i <= 7) AS one, avg(y) FILTER (i BETWEEN 8 AND 14) AS two, list(y ORDER BY i) FILTER (i <= 7) AS ys FROM k),
    r(i, level, trend, season) AS (SELECT CAST(0 AS BIGINT), one, (two - one) / 7, list_transform(ys, lambda y: y - one) FROM h
    UNION ALL SELECT i, l, 0.1 * (l - level) + 0.9 * trend, list_append(season[2:], 0.3 * (y - l) + 0.7 * season[1]) FROM (SELECT k.i, k.y, r.level, r.trend, r.season, 0.5 * (k.y - r.season[1]) + 0.5 * (r.level + r.trend) AS l FROM r JOIN k ON k.i = r.i + 1))
    SELECT round(level, 6) AS level, round(trend, 6) AS trend FROM r ORDER BY i DESC LIMIT 1""",
)
def ts_holt_winters(t: Tables):
    return timeseries.Scan(daily(t), [timeseries.holt_winters(0.5, 0.1, 0.3, 7)]).last_states().select("level", "trend")


@query(
    "ts_many",
    """WITH RECURSIVE s AS (SELECT o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, avg(o_totalprice) AS y FROM orders GROUP BY 1, 2), k AS (SELECT o_custkey, y, row_number() OVER (PARTITION BY o_custkey ORDER BY day) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM s),
    r(o_custkey, i, n, level) AS (SELECT o_custkey, i, n, y FROM k WHERE i = 1 UNION ALL SELECT k.o_custkey, k.i, k.n, 0.2 * k.y + 0.8 * r.level FROM r JOIN k ON k.o_custkey = r.o_custkey AND k.i = r.i + 1)
    SELECT o_custkey, n AS points, round(level, 6) AS level FROM r WHERE i = n""",
)
def ts_many(t: Tables):
    """The level of every customer's orders: one short series for each of them, side by side."""
    days = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("t")).agg(F.avg("o_totalprice").alias("y"))
    return timeseries.Scan(days, [timeseries.ses(0.2)], ["o_custkey"]).last_states().select("o_custkey", F.col("total").alias("points"), "level")


@query("ts_compare")
def ts_compare(t: Tables):
    return timeseries.compare_forecasters(daily(t), 7)


@query("ts_forecast")
def ts_forecast(t: Tables):
    return timeseries.forecast(daily(t))


@query(
    "cluster_assign_step",
    f"WITH {_V}, c AS (SELECT vec_id AS k, embedding AS e FROM embeddings WHERE vec_id < 4), d AS (SELECT v.vec_id, c.k, sqrt(list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (CAST(v.embedding[i] AS DOUBLE) - c.e[i]) ** 2))) AS d FROM v, c) SELECT vec_id, CAST(arg_min(k, (d, k)) AS INTEGER) AS cluster, round(min(d), 6) AS distance FROM d GROUP BY vec_id",
)
def cluster_assign_step(t: Tables):
    centres = [r["embedding"] for r in t.embeddings.where("vec_id < 4").orderBy("vec_id").collect()]
    return models.kmeans_step(t.embeddings.withColumn("e", F.col("embedding").cast("array<double>")), "vec_id", "e", centres)


@query("cluster_kmeans")
def cluster_kmeans(t: Tables):
    return cluster.kmeans(t.embeddings, "vec_id", "embedding", 4)[0]


@query(
    "cluster_silhouette",
    """WITH v AS (SELECT vec_id, embedding AS e, label AS c FROM embeddings), p AS (SELECT * FROM v ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 300), d AS (SELECT p.vec_id AS p, p.c AS pc, v.c, sqrt(list_sum(list_transform(range(1, len(p.e) + 1), lambda i: (CAST(p.e[i] AS DOUBLE) - v.e[i]) ** 2))) AS d FROM p JOIN v ON p.vec_id <> v.vec_id),
    m AS (SELECT p, pc, c, avg(d) AS m FROM d GROUP BY 1, 2, 3), s AS (SELECT p, min(m) FILTER (c = pc) AS a, min(m) FILTER (c <> pc) AS b FROM m GROUP BY p) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def cluster_silhouette(t: Tables):
    return cluster.silhouette(t.embeddings, "vec_id", "embedding", "label")


@query("cluster_traits", f"WITH {_V}, w AS (" + " UNION ALL ".join(f"SELECT label, 'x{i}' AS \"column\", (avg(x{i}) - (SELECT avg(x{i}) FROM v)) / (SELECT stddev_pop(x{i}) FROM v) AS gap FROM v GROUP BY label" for i in range(_DIMS)) + ') SELECT label, "column", round(gap, 6) AS gap, CAST(row_number() OVER (PARTITION BY label ORDER BY abs(gap) DESC, "column") AS INTEGER) AS rank FROM w QUALIFY rank <= 3')
def cluster_traits(t: Tables):
    return cluster.traits(vectors(t), "label", [f"x{i}" for i in range(_DIMS)])


@query(
    "pca_covariance",
    "WITH l AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings)) "
    "SELECT 'x' || a.i AS a, 'x' || b.i AS b, round(covar_pop(a.x, b.x), 6) + 0.0 AS cov FROM l a JOIN l b USING (vec_id) WHERE a.i <= b.i GROUP BY a.i, b.i",
)
def pca_covariance(t: Tables):
    return cluster.covariance(vectors(t), [f"x{i}" for i in range(_DIMS)])
