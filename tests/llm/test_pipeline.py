"""The pipeline's stages, each judged on its own input, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from quern.llm import mixing, near_copies

WORDS = "the of and stone river light garden winter paper window copper market silver valley engine letter music orange bridge candle forest harbor island jacket kitten ladder mirror needle oyster pencil quartz ribbon saddle timber velvet walnut yellow zephyr".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    good = [". ".join(sentence(rng.randint(8, 15)) for _ in range(12)) for _ in range(80)]
    junk = [" ".join(f"{w}###" for w in sentence(80).split()) for _ in range(30)]
    item = sentence(14)
    rows = [(i, t, "en", "big" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, t, "en", "big", len(t)) for i, t in enumerate(junk)]
    rows += [(300 + i, good[i], "en", "s1", 1) for i in range(5)]
    rows += [(400, f"{good[7]}. {item}. {good[8]}", "en", "s2", 1)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(80)] + [(200 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality_classifier"](spark, docs, folder)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and not ids & set(range(200, 230)) and ids >= set(range(80)) | {400}
    single = stage["simhash_near_dedup"](spark, good, folder)
    assert {r["doc_id"] for r in single.collect()} == set(range(80)) | {400}
    free = stage["benchmark_decontamination"](spark, single, folder)
    assert {r["doc_id"] for r in free.collect()} == set(range(80))
    mix = stage["source_mixing"](spark, free, folder)
    counts = {r["doc_id"]: r["n"] for r in mix.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert mix.columns == docs.columns and set(counts) == set(range(80)) and max(counts.values()) == 2
    placed = stage["sharding"](spark, mix, folder)
    assert sorted(r["doc_id"] for r in placed.collect()) == sorted(r["doc_id"] for r in mix.collect())


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == set(range(80))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_near_copies_at_the_similarity_of_the_rule(spark, folder):
    """Pairs at Jaccard 0.8 to 0.95 go, those below 0.8 stay, against all pairs by brute force."""
    rng = random.Random(5)
    rows, pairs = [], []
    for i in range(60):
        words = sentence_of(rng, 200)
        other = list(words)
        for at in rng.sample(range(0, 200, 8), 1 + i % 6):
            other[at] = f"changed{i}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        pairs.append(near_copies.jaccard(rows[-2][1], rows[-1][1], 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, folder).collect()}
    assert kept == {2 * i for i in range(60)} | {2 * i + 1 for i, j in enumerate(pairs) if j < 0.8}
    assert sum(0.8 <= j < 0.95 for j in pairs) > 20 and sum(j < 0.8 for j in pairs) > 5


def sentence_of(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def test_mix_follows_the_block_order(spark, folder, monkeypatch):
    """Blocks and places rise along the partitions, as they do in op6's result."""
    plain = mixing.mixed
    monkeypatch.setattr(mixing, "mixed", lambda docs, **given: plain(docs, block_tokens=300, **given))
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 80")
    placed = plain(docs, block_tokens=300).collect()
    want = [r["doc_id"] for r in sorted(placed, key=lambda r: (r["block"], r["place"]))]
    assert len({r["block"] for r in placed}) > 5
    assert [r["doc_id"] for r in corpus_pipeline.mix(spark, docs, folder).collect()] == want


def test_columns_named_like_those_of_a_stage_stay_as_they_are(spark, folder):
    names = ["epoch", "block", "place", "n_tokens", "score", "removed", "key", "row", "root", "did"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({n: F.concat(F.lit(f"{n}-"), F.col("doc_id")) for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == docs.columns, name
        assert not found.where(" OR ".join(f"{n} <> concat('{n}-', doc_id)" for n in names)).count(), name


def test_a_large_group_of_loose_copies_makes_few_pairs(spark, monkeypatch):
    """Copies of one text with more and more edits: links are those of brute force, and pairs that can't be similar are no rows."""
    rng = random.Random(9)
    base = sentence_of(rng, 150)
    texts = [" ".join(base)]
    for i in range(260):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 12)):
            words[at] = f"changed{i}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept_rows = {}
    plain = near_copies.stored
    monkeypatch.setattr(near_copies, "stored", lambda df, name: kept_rows.setdefault(name, plain(df, name)))
    monkeypatch.setattr(near_copies, "discard", lambda *tables: None)
    found = near_copies.similar_components(docs).select("doc_id", "root").collect()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [near_copies.shingles(t, 5) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = lambda pairs: {frozenset(i for i, r in pairs if r == root) for root in {r for _, r in pairs}}
    assert groups([(r["doc_id"], r["root"]) for r in found]) == groups([(i, find(i)) for i in range(len(texts))])
    assert 0 < kept_rows["cross-links"].count() < 1000  # links only


def test_marks_pass_nearly_all_pairs_at_the_similarity():
    rng = random.Random(2)
    passed = 0
    for _ in range(300):
        common, own = [[f"{rng.random()}" for _ in range(n)] for n in (160, 40)]
        a, b = set(common) | set(own[:20]), set(common) | set(own[20:])  # 160 of 200: exactly 0.8
        planes = [near_copies.marks_of(near_copies.least_of(x)).view("uint64").reshape(near_copies.PLANES, -1) for x in (a, b)]
        differ = 0
        for w in range(planes[0].shape[1]):
            differ += bin(int(planes[0][0][w] ^ planes[1][0][w]) | int(planes[0][1][w] ^ planes[1][1][w]) | int(planes[0][2][w] ^ planes[1][2][w]) | int(planes[0][3][w] ^ planes[1][3][w])).count("1")
        passed += differ <= near_copies.most_unlike(0.8)
    assert passed >= 299


def test_fingerprints_give_candidates_that_bands_miss(spark, folder, monkeypatch):
    """Without a bucket in common, nearly equal texts still meet by their fingerprints; texts that only look alike to them stay."""
    rng = random.Random(6)
    rows = []
    for i in range(8):
        words = sentence_of(rng, 900)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, f"last{i}"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = near_copies.sketches

    def alone(text, size):
        told = plain(text, size)
        return told.withField("buckets", F.transform(told["buckets"], lambda b: F.xxhash64(b, "doc_id")))

    monkeypatch.setattr(near_copies, "sketches", alone)
    prints = {r["doc_id"]: r["fp"] for r in docs.select("doc_id", near_copies.fingerprints("text", 3, 42).alias("fp")).collect()}
    close = [i for i in range(8) if bin((prints[2 * i] ^ prints[2 * i + 1]) % 2**64).count("1") <= 3]
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, folder).collect()}
    assert close and kept == set(range(16)) - {2 * i + 1 for i in close}
