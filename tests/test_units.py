"""Hand-computed cases on small tables."""

import json
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import cells
from quern.operators import drift, evaluate, joins, metrics, models, nearest, profile, quality, timeseries
from quern.operators.clean import ColumnStep, Recipe, apply
from quern.operators.intent import Filter, Intent, IntentError, compile_intent, validate
from quern.operators.question import ColumnInfo, parse_question
from quern.sources import console, ingest, sinks


@pytest.fixture(scope="module")
def sales(spark):
    rows = [("Paris", "10", "1"), ("Lyon", "20", "3"), ("Paris ", "30", "4"), ("Paris", "50", "NA"), ("Lyon", "40", "5"), (None, "50", "2.5")]
    return spark.createDataFrame(rows, "city string, price string, quantity string")


def test_mean_under_a_filter(sales):
    row = compile_intent(sales, Intent("aggregate", "price", "mean", filter=Filter("quantity", ">", 2))).first()
    assert row["value"] == pytest.approx(140 / 4) and row["count"] == 4


def test_sum_by_city_trims_and_leaves_missing_groups_out(sales):
    rows = compile_intent(sales, Intent("aggregate", "price", "sum", by="city")).collect()
    assert [(r["group"], r["value"], r["count"]) for r in rows] == [("Paris", 90.0, 3), ("Lyon", 60.0, 2)]


def test_used_differs_from_count(sales):
    df = sales.withColumn("price", F.when(F.col("price") == "20", "?").otherwise(F.col("price")))
    rows = {r["group"]: (r["count"], r["used"]) for r in compile_intent(df, Intent("aggregate", "price", "sum", by="city")).collect()}
    assert rows == {"Paris": (3, 3), "Lyon": (2, 1)}


def test_text_thresholds(sales):
    assert compile_intent(sales, Intent("count", filter=Filter("price", ">=", "20"))).first()[0] == 5
    with pytest.raises(IntentError, match="filter-not-numeric"):
        compile_intent(sales, Intent("count", filter=Filter("price", ">", "cher")))


def test_not_equal_leaves_missing_out(sales):
    assert compile_intent(sales, Intent("count", filter=Filter("quantity", "!=", 1))).first()[0] == 4
    assert compile_intent(sales, Intent("count", filter=Filter("city", "!=", "paris"))).first()[0] == 2


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert compile_intent(df, Intent("correlation", "x", other="y")).first()["r"] is None


def test_intents_are_validated():
    assert validate({"family": "top", "by": "CITY", "k": 3}, ["city"]) == Intent("top", by="city", k=3)
    for bad in ({"family": "x"}, {"family": "top", "by": "city", "k": 51}, {"family": "aggregate", "column": "nope", "op": "mean"}, {"family": "count", "filter": {"column": "city", "op": "~", "value": 1}}):
        with pytest.raises(IntentError):
            validate(bad, ["city"])


@pytest.mark.parametrize(("text", "value"), [("1d", None), ("0x10", None), ("1_000", None), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("Infinity", None), ("NaN", None), ("  12\t", 12.0), ("", None), ("1e999", None)])
def test_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(cells.number(df, "c")).first()[0] == value


@pytest.mark.parametrize(("text", "value"), [("2024-02-30", None), ("31/02/2023", None), ("3/4/21", "2021-04-03"), ("12/13/2020", "2020-12-13"), ("2024-05", "2024-05-01"), ("n/a", None)])
def test_dates(spark, text, value):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(F.date_format(cells.date(df, "c"), "yyyy-MM-dd")).first()[0] == value


def test_first_match_join(spark):
    left = spark.createDataFrame([(1, "latte ", 2), (2, "latte", 1), (3, "tea", 4), (4, None, 1)], "id int, product string, qty int")
    right = spark.createDataFrame([(1, "latte", "hot", 9), (2, "latte", "cold", 8), (3, "mocha", "hot", 7), (4, None, "x", 1)], "n int, product string, category string, qty int")
    rows = joins.left_join_first(left, right, "product", ["n"]).orderBy("id").collect()
    assert [(r["id"], r["category"], r["qty_2"]) for r in rows] == [(1, "hot", 9), (2, "hot", 9), (3, None, None), (4, None, None)]
    audit = joins.join_audit(left, right, "product").first()
    assert (audit["matched"], audit["orphans"], audit["duplicate_keys"], audit["unused_right"], audit["orphan_keys"]) == (2, 2, 1, 1, "tea")


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, at int, v int")
    assert {(r["k"], r["t"]): r["v"] for r in joins.asof_join(left, right, "k", "t", "at", ["v"], "v").collect()} == {("a", 5): 50, ("a", 1): None, ("b", 9): None}


def test_numbering_is_global(spark):
    df = spark.range(1000).withColumn("x", F.xxhash64("id")).repartition(7)
    rows = joins.numbered(df, ["x"], "n").orderBy("x").collect()
    assert [r["n"] for r in rows] == list(range(1000))


def test_fences_need_eight_numbers(spark):
    few = spark.createDataFrame([(float(x),) for x in range(7)], "x double")
    many = spark.createDataFrame([(float(x),) for x in [*range(9), 100]], "x double")
    assert quality.outliers(few, ["x"]).count() == 0
    assert quality.outliers(many, ["x"]).first()["count"] == 1


def test_variants_have_one_canonical_form(spark):
    df = spark.createDataFrame([(c,) for c in ["Paris", "Paris", "paris", "PARIS ", "Lyon", None]], "city string")
    row = quality.variants(df, ["city"]).first()
    assert (row["canonical"], row["variants"], row["cells"]) == ("Paris", 3, 2)


def test_null_and_empty_are_no_duplicates(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None), ("ab", "c"), ("a", "bc")], "x string, y string")
    assert quality.duplicates(df).first()["duplicate_rows"] == 1


def test_recipe_order_and_json(spark):
    df = spark.createDataFrame([(1, " a", 1.0), (2, "A", None), (3, "a", 3.0), (4, "n/a", 8.0)], "id int, s string, x double")
    recipe = Recipe(merge_variants=True, columns={"x": ColumnStep("median", indicator=True), "s": ColumnStep("drop")})
    rows = apply(df, Recipe.from_json(recipe.to_json()), ["id"]).orderBy("id").collect()
    assert [(r["id"], r["s"], r["x"], r["x_absent"]) for r in rows] == [(1, "a", 1.0, "0"), (2, "a", 3.0, "1"), (3, "a", 3.0, "0")]
    for bad in ("[]", "{", '{"trim": 3}', '{"missing": "x"}', '{"columns": {"a": 1}}'):
        assert Recipe.from_json(bad) is None
    assert Recipe.from_json('{"unknown": 1}') == Recipe()


def test_psi(spark):
    a = spark.createDataFrame([("c", "0", 0.5, 10), ("c", "1", 0.5, 10)], "column string, bin string, share double, n long")
    b = spark.createDataFrame([("c", "0", 0.9, 10), ("c", "1", 0.1, 10)], "column string, bin string, share double, n long")
    assert drift.stability(a, b, {"c": ["0", "1"]}).first()["psi"] == pytest.approx(0.8789, abs=1e-4)


def test_noise_ceiling_holds_its_rate():

    rng = np.random.default_rng(1)
    ceiling = drift.noise_ceiling([0.1] * 10, 120, 120, 0.95)
    draws = drift.psi_of(rng.multinomial(120, [0.1] * 10, 400) / 120, rng.multinomial(120, [0.1] * 10, 400) / 120)
    assert (draws > ceiling).mean() < 0.1


def test_ceilings_are_those_of_each_column_s_own_shares(spark):
    """A rare category's stray rows are noise of that column; the ceiling comes from both samples put together."""
    rng = np.random.default_rng(2)
    draw = lambda n: [(float(x), "abc"[rng.choice(3, p=[0.97, 0.02, 0.01])]) for x in rng.normal(size=n)]
    a, b = (spark.createDataFrame(draw(n), "x double, k string") for n in (90, 60))
    for sides, name in ((drift.numeric_sides(a, b, ["x"]), "x"), (drift.categorical_sides(a, b, ["k"]), "k")):
        m, g = sides.first(), drift.graded(sides, 0.975).first()
        assert sum(m["pooled"]) == pytest.approx(1) and (m["reference_rows"], m["rows"]) == (90, 60)
        assert g["ceiling"] == pytest.approx(drift.noise_ceiling(m["pooled"], 90, 60, 0.975))
        assert g["severity"] == drift.severity(g["psi"], g["ceiling"]) == "stable", name
    k = drift.categorical_sides(a, b, ["k"]).first()["pooled"]
    counts = [sum(r["k"] == c for d in (a, b) for r in d.collect()) / 150 for c in "abc"]
    assert sorted(x for x in k if x) == pytest.approx(sorted(x for x in counts if x))
    assert drift.noise_ceiling(k, 90, 60, 0.975) != pytest.approx(drift.noise_ceiling([0.1] * 10, 90, 60, 0.975), rel=0.05)
    assert drift.noise_ceiling([0.1] * 10, 5000, 90_000, 0.95) == drift.noise_ceiling([0.1] * 10, 1000, 1000, 0.95)
    moved = b.withColumn("k", F.lit("c"))
    assert drift.graded(drift.categorical_sides(a, moved, ["k"]), 0.95).first()["severity"] == "strong"


def test_severity_grid():
    assert [drift.severity(v, c) for v, c in ((0.05, None), (0.15, 0.2), (0.15, 0.1), (0.3, 0.35), (0.3, 0.2), (0.2, None))] == ["stable", "stable", "moderate", "stable", "strong", "moderate"]


def test_contract_round_trip(spark):
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(100)], "price double, kind string")
    contract = drift.build_contract(df)
    again = drift.Contract.from_json(contract.to_json())
    assert again == contract
    assert {r["outcome"] for r in drift.check_contract(again, df).collect()} == {"kept"}
    worse = df.withColumn("price", -F.col("price")).drop("kind")
    told = {(r["family"], r["subject"]): r["outcome"] for r in drift.check_contract(contract, worse).collect()}
    assert told["rule", "negativeAmount(price)"] == "broken" and told["schema", "kind"] == "broken" and told["distribution", "price"] == "warning"
    for bad in ("{}", "[]", "x", json.dumps({"format": "other"})):
        assert drift.Contract.from_json(bad) is None


def test_classification_metrics(spark):
    truth, told = [0, 0, 1, 1, 2, 2, 2, 0, 1, 2], [0, 1, 1, 1, 2, 0, 2, 0, 1, 1]
    df = spark.createDataFrame(list(zip(truth, told, strict=True)), "y int, p int")
    assert metrics.accuracy(df, "y", "p").first()[0] == pytest.approx(0.7)
    f1 = metrics.macro_prf(df, "y", "p").first()["f1"]
    assert f1 == pytest.approx((2 / 3 + 0.75 + 2 / 3) / 3)


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1)], "y int, s double")
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.625)
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_conformal_refuses_too_few(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "e double")
    assert evaluate.conformal_quantile(df, "e", 0.1).count() == 0
    assert evaluate.conformal_quantile(df, "e", 0.2).first()[0] == 4.0


def test_bootstrap_covers(spark):
    df = spark.range(2000).withColumn("v", (F.col("id") % 4 == 0).cast("double"))
    r = evaluate.bootstrap(df, "id", F.col("v"), 200).first()
    assert r["low"] < 0.25 < r["high"] and r["high"] - r["low"] < 0.06


def test_linear_solves_exactly(spark):
    df = spark.createDataFrame([(float(a), float(b), 2.0 + 3 * a - b) for a in range(6) for b in range(5)], "a double, b double, y double")
    m = models.fit_linear(df, ["a", "b"], "y")
    assert (m.bias, *m.weights) == pytest.approx((2, 3, -1), abs=1e-4)
    assert models.Linear.from_json(m.to_json()) == m and models.Linear.from_json('{"family": "tree"}') is None


def test_neighbours_in_blocks_match_brute_force(spark):

    x = np.random.default_rng(3).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, v array<double>, y int")
    found = nearest.neighbours(df.where("id % 10 <> 0"), df.where("id % 10 = 0"), "v", "id", "y", k=4)
    for r in found.collect():
        d = [(np.linalg.norm(x[r["id"]] - x[j]), j) for j in range(300) if j % 10]
        assert [n["key"] for n in r["near"]] == [j for _, j in sorted(d)[:4]]


def test_forecasters_on_known_series(spark):
    line = spark.createDataFrame([(i, 3.0 + 2 * i) for i in range(40)], "t int, y double")
    level = timeseries.Scan(line, [timeseries.holt(0.5, 0.1)]).last_states().first()
    assert level["level"] + level["trend"] == pytest.approx(3 + 2 * 40)
    best = timeseries.compare_forecasters(line).first()
    assert best["model"].startswith("holt") and best["mae"] == pytest.approx(0, abs=1e-9)


def brute_forecast(y, method, p, h):
    """Each method refitted on the points it is given, as a loop."""
    a, b, g, m = (p.get(k, 0) for k in ("alpha", "beta", "gamma", "m"))
    if method == "naive":
        return [y[-1]] * h
    if method == "seasonalNaive":
        return [y[len(y) - m + i % m] for i in range(h)]
    if method in ("ses", "holt"):
        level, trend = y[0], y[1] - y[0] if method == "holt" else 0.0
        for x in y[1:]:
            old, level = level, a * x + (1 - a) * (level + trend)
            trend = b * (level - old) + (1 - b) * trend if method == "holt" else 0.0
        return [level + (i + 1) * trend for i in range(h)]
    one, two = sum(y[:m]) / m, sum(y[m : 2 * m]) / m
    level, trend, season = one, (two - one) / m, [x - one for x in y[:m]]
    for i, x in enumerate(y):
        old, level = level, a * (x - season[i % m]) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend
        season[i % m] = g * (x - level) + (1 - g) * season[i % m]
    return [level + (i + 1) * trend + season[(len(y) + i) % m] for i in range(h)]


@pytest.mark.parametrize(("n", "period"), [(90, 7), (40, None), (19, 7)])
def test_backtests_are_refits_at_every_held_out_point(spark, n, period):
    rng = np.random.default_rng(n)
    y = [float(10 + 0.2 * i + 3 * np.sin(2 * np.pi * i / 7) + rng.normal()) for i in range(n)]
    series = spark.createDataFrame(list(enumerate(y)), "t int, y double").repartition(3)
    found = {r["model"]: r for r in timeseries.backtests(series, period).collect()}
    held = max(8, min(60, n // 5))
    want = [f for f in timeseries.forecasters(period) if f.least <= int(n * 0.8) and n - held >= f.least]
    assert list(found) and set(found) == {f.name for f in want}
    for f in want:
        errors = [y[i] - brute_forecast(y[:i], f.method, f.params, 1)[0] for i in range(n - held, n)]
        assert found[f.name]["errors"] == pytest.approx(errors)
        assert found[f.name]["mae"] == pytest.approx(np.mean(np.abs(errors))) and found[f.name]["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))


def test_forecast_goes_on_from_the_last_point(spark):
    rng = np.random.default_rng(1)
    y = [float(50 + 0.5 * i + 9 * np.sin(2 * np.pi * i / 7) + rng.normal()) for i in range(120)]
    rows = [(date(2024, 1, 1) + timedelta(days=i), x) for i, x in enumerate(y)]
    series = spark.createDataFrame(rows, "t date, y double")
    found = timeseries.forecast(series).orderBy("t").collect()
    best = min(timeseries.backtests(series, 7).collect(), key=lambda r: (r["mae"], r["place"]))
    f = timeseries.forecasters(7)[best["place"]]
    assert f.method == "holtWinters" and len(found) == 14
    assert [r["t"].date() for r in found] == [date(2024, 1, 1) + timedelta(days=120 + i) for i in range(14)]
    errors = sorted(best["errors"])
    for r, x in zip(found, brute_forecast(y, f.method, f.params, 14), strict=True):
        assert r["model"] == f.name and r["forecast"] == pytest.approx(x, abs=6e-4)
        assert (r["low"], r["high"]) == pytest.approx((x + errors[2], x + errors[21]), abs=6e-4)
    assert timeseries.forecast(series.limit(5)).count() == 0


def test_long_series_lose_no_point(spark):
    """1.5 million points in many ranges: every one moves the state, none is gathered with all others."""
    n = 1_500_000
    scan = timeseries.Scan(spark.range(n).select(F.col("id").alias("t"), F.col("id").cast("double").alias("y")), [timeseries.holt(0.5, 0.2), timeseries.ses(0.5), timeseries.Forecaster("naive", {}, 1, 1)])
    assert scan.states.count() > 3
    end = scan.last_states().where("place = 0").first()
    assert end["level"] == pytest.approx(n - 1) and end["trend"] == pytest.approx(1)
    assert scan.every_state().where("pos > 0 AND level - pos BETWEEN -0.001 AND 0.001").count() == n - 1
    assert scan.held_errors().where("place = 2").first()["errors"] == [1.0] * 60


def loop_state(y, f):
    """Level and trend after the last point, point by point."""
    m, (a, b, g) = f.season, (f.params.get(k, 0.0) for k in ("alpha", "beta", "gamma"))
    if f.method == "holtWinters":
        one, two = sum(y[:m]) / m, sum(y[m : 2 * m]) / m
        level, trend, season = one, (two - one) / m, [x - one for x in y[:m]]
    else:
        level, trend, season = y[0], y[1] - y[0] if f.method == "holt" else 0.0, [0.0]
    for x in y[f.first :]:
        old, level = level, a * (x - season[0]) + (1 - a) * (level + trend)
        trend = b * (level - old) + (1 - b) * trend if b else 0.0
        season = [*season[1:], g * (x - level) + (1 - g) * season[0]] if g else season
    return level, trend


def test_many_series_side_by_side(spark):
    """A long series over several ranges, short ones, ones too short for a start and one without a key."""
    rng = np.random.default_rng(5)
    made = {"long": 3000, "a": 40, "b": 15, "c": 3, "d": 1, None: 60}
    ys = {k: [float(20 + i * 0.1 + 5 * np.sin(i * 0.9) + rng.normal()) for i in range(n)] for k, n in made.items()}
    series = spark.createDataFrame([(k, i, y) for k, v in ys.items() for i, y in enumerate(v)], "k string, t int, y double").repartition(4)
    models = timeseries.forecasters(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few points are one range
    scan = timeseries.Scan(series, models, ["k"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert scan.states.where("k = 'long'").count() > 2
    found = {(r["k"], models[r["place"]].name): r for r in scan.last_states().collect()}
    assert {k for k, _ in found} == set(made)
    for (k, name), r in found.items():
        f = next(f for f in models if f.name == name)
        if f.method in ("ses", "holt", "holtWinters"):
            assert (r["level"], r["trend"]) == pytest.approx(loop_state(ys[k], f), abs=1e-8)
        else:
            assert list(r["season"]) == pytest.approx(ys[k][-f.season :])
    alone = {k: {(r["place"], r["model"]): (r["mae"], r["rmse"]) for r in timeseries.backtests(series.where(F.col("k").eqNullSafe(F.lit(k))).drop("k"), 7).collect()} for k in made}
    together = {k: {} for k in made}
    for r in timeseries.backtests(series, 7, ["k"]).collect():
        together[r["k"]][r["place"], r["model"]] = (r["mae"], r["rmse"])
    for k in made:
        assert together[k].keys() == alone[k].keys() and bool(together[k]) == (made[k] >= 12)
        assert [together[k][m] for m in alone[k]] == [pytest.approx(v) for v in alone[k].values()]


def test_forecasts_of_each_series(spark):
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), float(s * i + 10 * (i % 7))) for k, s, n in (("x", 1, 80), (None, -2, 40), ("short", 1, 5)) for i in range(n)]
    series = spark.createDataFrame(rows, "k string, t date, y double")
    found = timeseries.forecast_each(series, 86400, 7, ["k"]).collect()
    assert {r["k"] for r in found} == {"x", None} and len(found) == 28
    for k, n in (("x", 80), (None, 40)):
        alone = timeseries.forecast(series.where(F.col("k").eqNullSafe(F.lit(k))).drop("k")).orderBy("t").collect()
        assert [r[1:] for r in sorted((r for r in found if r["k"] == k), key=lambda r: r["t"])] == [tuple(r) for r in alone]
        assert alone[0]["t"].date() == date(2024, 1, 1) + timedelta(days=n)
    assert timeseries.forecast(series.where("false").drop("k")).count() == 0


COLUMNS = [ColumnInfo("age", True), ColumnInfo("fare", True), ColumnInfo("sex", False, ("female", "male")), ColumnInfo("town", False, ("Cherbourg", "Paris"))]


@pytest.mark.parametrize(
    ("question", "lang", "intent"),
    [
        ("how many rows and columns?", "en", Intent("shape")),
        ("valeurs manquantes", "fr", Intent("missing")),
        ("how many female?", "en", Intent("count", filter=Filter("sex", "=", "female"))),
        ("average fare by sex", "en", Intent("aggregate", "fare", "mean", by="sex")),
        ("mean age where sex is male", "en", Intent("aggregate", "age", "mean", filter=Filter("sex", "=", "male"))),
        ("combien de passagers avec age superieur a 60 ?", "fr", Intent("count", filter=Filter("age", ">", 60.0))),
        ("correlation between age and fare", "en", Intent("correlation", "age", other="fare")),
        ("top 3 town", "en", Intent("top", by="town", k=3)),
        ("count the passengers older than 60", "en", None),
        ("average fare of the survivors", "en", None),
        ("mean age above 30", "en", None),
        ("", "en", None),
    ],
)
def test_questions(question, lang, intent):
    got = parse_question(question, COLUMNS, lang)
    if question == "mean age above 30":
        assert got == Intent("aggregate", "age", "mean", filter=Filter("age", ">", 30.0))
    else:
        assert got == intent


def test_head_reading():
    assert ingest.detect_delimiter('a;b;c\n"1;2";3,5;4\n') == ";"
    assert ingest.detect_delimiter("a\n1\n") == ","
    assert ingest.decode_head("é".encode("cp1252"))[1] == "windows-1252" and ingest.decode_head(b"\xef\xbb\xbfa") == ("a", "utf-8")
    assert ingest.decode_head(("é" * ingest.HEAD_BYTES).encode()[: ingest.HEAD_BYTES - 1] + b"\xc3")[1] == "utf-8"
    assert ingest.repair_header(["a", "", "a", "column_2"]).names == ["a", "column_2 (2)", "a (2)", "column_2"]
    assert [ingest.view_name(n) for n in ("My File.csv", "2024.parquet", ".csv")] == ["my_file", "t_2024", "dropped"]


def test_delimited_file_with_commas_and_ragged_rows(spark, tmp_path):
    path = tmp_path / "sales 1.csv"
    path.write_text("id;price;price;\n" + "".join(f"{i};{i},5;1 234,56;x\n" for i in range(25)) + "99;1,0\n", encoding="utf-8")
    df, how = ingest.read_delimited(spark, str(path))
    assert df.columns == ["id", "price", "price (2)", "column_4"] and how.delimiter == ";"
    assert how.decimal_columns == ("price", "price (2)") and how.malformed_rows == 1
    row = df.where("id = '3'").first()
    assert (row["price"], row["price (2)"]) == ("3.5", "1234.56")
    assert ingest.register(spark, str(path)) == "sales_1" and console.run(spark, "SELECT count(*) FROM sales_1;").first()[0] == 26


def test_formula_guard_and_names(spark):
    df = spark.createDataFrame([("=1+1",), ("-5",), ("@a",), ("plain",), (None,)], "c string")
    assert [r[0] for r in sinks.guard_formulas(df).collect()] == ["'=1+1", "-5", "'@a", "plain", None]
    assert sinks.result_name(" select 1 ;", "csv") == sinks.result_name("select 1", "csv")


def test_console_hints(spark):
    with pytest.raises(console.SqlError, match="Hint"):
        console.run(spark, "SELECT * EXCLUDE (id) FROM range(3)")


def test_types_of_a_long_table_with_few_values(spark):
    """Rows far beyond any sample, in 15 combinations of strings; late rows count like early ones."""
    df = spark.range(200_000).select(F.concat(F.lit("status "), F.col("id") % 3).alias("status"), F.concat(F.lit("priority "), F.col("id") % 5).alias("priority"), F.when(F.col("id") < 100_000, F.lit("12")).otherwise(F.lit("word")).alias("mixed"))
    assert {r["column"]: r["type"] for r in profile.column_types(df).collect()} == {"status": "categorical", "priority": "categorical", "mixed": "categorical"}


def test_a_windows_1252_file_and_its_malformed_rows(spark, tmp_path):
    path = tmp_path / "prices.csv"
    path.write_bytes("name;price\ncafé “noir”;1,5 €\nthé;2\nœuf;3;4\n".encode("cp1252"))
    df, told = ingest.read_delimited(spark, str(path), delimiter=";")
    assert (told.encoding, told.delimiter, told.malformed_rows) == ("windows-1252", ";", 1)
    assert [tuple(r) for r in df.orderBy("price").collect()] == [("café “noir”", "1,5 €"), ("thé", "2"), ("œuf", "3")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"


def test_all_white_space_is_trimmed(spark):
    spaces = "        　﻿ \t\n"
    df = spark.createDataFrame([(f"{spaces}a b{spaces}",), (spaces,)], "x string")
    assert [r[0] for r in df.select(cells.jtrim(df["x"])).collect()] == ["a b", ""]


def test_indicators_only_where_there_are_gaps_and_under_free_names(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 3.0, "y")], "id long, full string, x double, x_absent string")
    out = apply(df, Recipe(columns={"full": ColumnStep(indicator=True), "x": ColumnStep(indicator=True)}), ["id"])
    assert set(out.columns) == {"id", "full", "x", "x_absent", "x_absent_2"}
    assert [(r["x_absent"], r["x_absent_2"]) for r in out.orderBy("id").collect()] == [("x", "1"), ("y", "0")]


def test_a_missing_package_is_not_taken_for_a_removed_subpackage(monkeypatch):
    import __spark_entry__ as entry

    def fails(name):
        def of(_):
            raise ModuleNotFoundError("gone", name=name)

        return of

    for name in ("quern.llm", "quern.llm.queries", "corpus_pipeline"):
        monkeypatch.setattr(entry, "import_module", fails(name))
        assert entry.removable("corpus_pipeline" if name == "corpus_pipeline" else "quern.llm.queries") is None
    monkeypatch.setattr(entry, "import_module", fails("xxhash"))
    with pytest.raises(ModuleNotFoundError):
        entry.removable("quern.llm.queries")


def test_range_join_of_crowded_values(spark, monkeypatch):
    """Blocks of rows of one value meet, whatever their size; candidates don't become rows: every task tells its share."""
    monkeypatch.setattr(joins, "BLOCK", 16)
    points = spark.range(900).select("id", F.when(F.col("id") % 100 != 0, F.floor(F.col("id") % 3).cast("double")).alias("x"))
    ranges = spark.range(300).select(F.col("id").alias("r"), (F.col("id") % 5 - 1).cast("double").alias("low"), (F.col("id") % 5).cast("double").alias("high"))
    told = joins.range_join(points, ranges, "x", "low", "high", 10.0)
    want = sorted((i, r) for i in range(900) if i % 100 for r in range(300) if r % 5 - 1 <= i % 3 < r % 5)
    assert sorted((t["id"], t["r"]) for t in told.collect()) == want
    sizes = told.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 8 and max(s["count"] for s in sizes) < len(want) / 4
    only = joins.range_join(points.select("x"), ranges.select("low", "high"), "x", "low", "high", 10.0)
    assert only.columns == ["x", "low", "high"] and only.count() == len(want)


def test_range_join_hands_rows_on_without_gathering_them(spark, monkeypatch):
    """The two sides of a pair of blocks become rows in two compiled loops, so that one holds a block's rows and not its square; nulls and structs stay."""
    monkeypatch.setattr(joins, "BLOCK", 16)
    points = spark.range(200).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("id"), (F.col("id") % 3).cast("double").alias("x"))
    ranges = spark.range(90).select(F.struct(F.col("id").alias("n")).alias("r"), (F.col("id") % 4).cast("double").alias("low"), (F.col("id") % 4 + 1).cast("double").alias("high"))
    told = joins.range_join(points, ranges, "x", "low", "high", 10.0)
    want = [(i if i % 7 else -1, float(i % 3), n) for i in range(200) for n in range(90) if n % 4 == i % 3]
    assert sorted((-1 if t["id"] is None else t["id"], t["x"], t["r"]["n"]) for t in told.collect()) == sorted(want)
    wide = joins.range_join(points.withColumn("also", F.col("x") + 1), ranges.withColumn("name", F.lit("a")), "x", "low", "high", 10.0)
    assert wide.columns == ["id", "x", "also", "r", "low", "high", "name"] and wide.where("also = x + 1 AND name = 'a'").count() == len(want)
    loops = {}
    for line in told._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines():
        if found := re.search(r"\*\((\d+)\) Generate explode\((_[pr])\b", line):
            loops[found[2]] = int(found[1])
    assert set(loops) == {"_p", "_r"} and loops["_p"] != loops["_r"]


def test_isolation_depths_a_level_at_a_time():
    """Trees in heap order say what the nested ones say, for equal and missing values too, in one step for each level."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 3)), 1)
    x[::50, 1] = np.nan

    def plain(tree, row, at=0):
        return at + quality.path_scale(tree[0]) if len(tree) == 1 else plain(tree[2 if row[tree[0]] < tree[1] else 3], row, at + 1)

    for _ in range(5):
        tree = quality.grow(np.nan_to_num(x[rng.choice(700, 64, replace=False)]), 0, 6, rng)
        flat = quality.heap(tree, 6)
        assert len(flat[0]) == 127
        assert quality.depths(flat, x.T.copy(), 6).tolist() == [plain(tree, r) for r in x]


def test_counterfactuals_are_chosen_within_the_row(spark):
    df = spark.createDataFrame([(1, 3.0, 10.0), (2, 50.0, 0.0), (3, None, 12.0), (4, 0.0, 0.0)], "k long, a double, b double")
    found = evaluate.counterfactuals(df, {"a": [0.0, 5.0, 10.0], "b": [0.0, 10.0, 20.0, 40.0]}, F.col("a") + F.col("b"), F.col("predicted") >= 15, "k", 2)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a", 5.0, 15.0), (1, "b", 20.0, 23.0), (2, "b", 10.0, 60.0), (2, "b", 20.0, 70.0), (4, "b", 20.0, 20.0), (4, "b", 40.0, 40.0)]


def test_silhouette_sums_rows_where_they_lie(spark):
    """No probe is paired with a row in a join; repeated keys and missing vectors count as they did."""
    from quern.operators import cluster

    rng = np.random.default_rng(2)
    rows = [(i // 2 if i < 10 else i, None if i == 30 else rng.normal(size=3).tolist(), i % 3 if i != 31 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, v array<double>, c int").repartition(3)
    found = cluster.silhouette(df, "k", "v", "c", 60)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    each = []
    for k, v, c in rows:
        if v is None or c is None:
            continue
        m = {g: [np.linalg.norm(np.subtract(v, w)) for j, w, h in rows if h == g and j != k and w is not None] for g in range(3)}
        m = {g: np.mean(d) for g, d in m.items() if d}
        a, b = m[c], min(x for g, x in m.items() if g != c)
        each.append((b - a) / max(a, b))
    assert tuple(found.first()) == pytest.approx((np.mean(each), len(each)))


def test_short_series_share_a_block(spark, monkeypatch):
    """Ranges are grouped by block, not by series: thousands of short ones make few groups, and long ones are cut into several."""
    monkeypatch.setattr(timeseries, "BLOCK", 100)
    sizes = [1 + k % 7 for k in range(300)] + [450]
    points = [(k if k else None, i, float((k * 31 + i * i * 7) % 23)) for k, n in enumerate(sizes) for i in range(n)]
    models = [timeseries.ses(0.2), timeseries.holt(0.5, 0.1), timeseries.Forecaster("seasonalNaive", {"m": 3}, 4, 3)]
    scan = timeseries.Scan(spark.createDataFrame(points, "k long, t long, y double").repartition(5), models, ["k"])
    blocks = scan.parts.groupBy("_p").agg({"n": "sum", "*": "count"}).toDF("_p", "points", "ranges").collect()
    assert max(b["points"] for b in blocks) <= 100 and len(blocks) < 40 and max(b["ranges"] for b in blocks) > 10
    found = {(r["k"], r["place"]): (r["total"], r["level"], r["trend"], *r["season"]) for r in scan.last_states().collect()}
    want = {}
    for k, n in enumerate(sizes):
        ys = np.array([y for key, _, y in points if key == (k if k else None)])
        for place, f in enumerate(models):
            if n >= f.needed:
                want[k if k else None, place] = (n, *(f.states(ys[f.first :], f.start(ys))[-1] if n > f.first else f.start(ys)))
    assert found.keys() == want.keys()
    for key, state in want.items():
        assert found[key] == pytest.approx(state)
    scan.discard()


def test_ends_of_many_ranges():
    ys = np.random.default_rng(5).normal(size=2000)
    starts = np.array([0, 3, 3, 10, 900, 1999, 2000])
    stops = np.array([3, 3, 10, 900, 1999, 2000, 2000])
    for f in timeseries.forecasters(7):
        ends = f.ends(ys, starts, stops)
        assert np.allclose(ends, [f.end(ys[a:b]) for a, b in zip(starts, stops, strict=True)])
        begun = np.tile(np.arange(f.season + 2.0), (len(starts), 1))
        assert np.allclose(f.over_each(begun, stops - starts, ends), [f.over(s, n, e) for s, n, e in zip(begun, stops - starts, ends, strict=True)])
