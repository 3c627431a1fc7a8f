"""Benchmark decontamination through a distributed positional inverted index.

1. Every benchmark item is cut into windows of ``window`` consecutive words.
2. Over all documents, the occurrences of the windows' terms are counted: the
   lengths of their lists of postings.
3. Of each window, the two rarest terms are its pivots. The index stores the
   postings of all pivots: term, document, position, and the words around it.
4. A window's occurrences: the lists of its two rarest terms, each shifted by
   the term's offset in the window, are intersected; the stored surroundings
   then confirm the other terms at their offsets (exact phrase) or, as often as
   the window has them, in any order within the window and ``slop`` words on
   either side of it (proximity).

Texts are split in the JVM and their words pass through two bounded bit maps
(terms, then pivots) in the generated code that splits them up, so that only
rows of the few rare terms are made, stored and shuffled. The bit maps only save
work: the joins behind them are exact. Built-in functions only.

Defined results: null and empty texts have no words and are never hit; an item
without words has no window and is ignored; an item with a null id can hit
words but is not counted as an item; repeated rows each give their own row;
a very long text is one array of words in one task, read whole; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, row_key, stored

#: What separates words, capitals not yet lowered.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words_as_written(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


class BitMap:
    """A Bloom filter of terms as a literal of at most 2^22 bits (512 KiB), tested without regard to case.

    It is built for a benchmark's terms; beyond a million of them more words
    pass it, which costs rows, not results.
    """

    def __init__(self, terms: DataFrame, count: int):
        self.bits = 1 << min(22, max(10, math.ceil(math.log2(64 * max(1, count)))))
        ones = terms.select(F.explode(F.array(*self.places(F.col("term")))).alias("at"))
        ones = ones.groupBy(F.floor(F.col("at") / 64).cast("int").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("w"))
        words = [0] * (self.bits // 64)
        for row in ones.collect():  # bits / 64 rows at most
            words[row["i"]] = row["w"]
        self.literal = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal

    def places(self, term: Column) -> list[Column]:
        low = F.lower(term)
        return [F.pmod(F.xxhash64(low), F.lit(self.bits)), F.pmod(F.xxhash64(low, F.lit(1)), F.lit(self.bits))]

    def holds(self, term: Column) -> Column:
        first, second = (F.bit_get(F.get(self.literal, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.places(term))
        return first & second


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase): the distinct windows of each item."""
    words = items.select("item_id", words_as_written(ascii_lower(F.col("text"))).alias("words")).where(F.size("words") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1))))
    return words.select("item_id", "words", starts.alias("s")).select("item_id", F.slice("words", F.col("s"), F.lit(window)).alias("phrase")).distinct()


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n) of all terms that occur."""
    known = BitMap(terms, terms.count())
    found = docs.select(F.explode(words_as_written(F.col("text"))).alias("w")).where(known.holds(F.col("w")))
    return found.select(ascii_lower(F.col("w")).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def pivoted_windows(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(window, item_id, phrase, rare, rare2): each window with its two rarest terms as (n, term, offset)."""
    windows = stored(benchmark_windows(items, window).withColumn("window", F.xxhash64("phrase")), "windows")
    each = windows.select("window", "phrase", F.posexplode("phrase").alias("offset", "term")).distinct()
    terms = stored(each.select("term").distinct(), "terms")
    counted = stored(occurrences(docs, terms), "frequencies")
    ranked = each.join(counted, "term").groupBy("phrase").agg(F.array_sort(F.collect_set(F.struct("n", "term", "offset"))).alias("r"))
    ranked = ranked.where(F.size("r") == F.size("phrase"))  # a term that no document has: no occurrence
    rare = ranked.select("phrase", F.col("r")[0].alias("rare"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("rare2"))
    return stored(windows.join(rare, "phrase"), "pivots")


def build_index(docs: DataFrame, pivots: DataFrame, reach: int) -> DataFrame:
    """The postings of the pivots: (term, did, key, pos, at, around); around[at] is the term as written."""
    terms = stored(pivots.select("rare.term").union(pivots.select("rare2.term")).distinct(), "pivot-terms")
    known = BitMap(terms, terms.count())
    words = docs.select(F.coalesce("doc_id", F.lit(0)).alias("did"), row_key("doc_id", "text").alias("key"), words_as_written(F.col("text")).alias("words"))

    each = words.select("did", "key", "words", F.posexplode("words").alias("pos", "word")).where(known.holds(F.col("word")))
    around = F.slice("words", F.greatest(F.col("pos") - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    rows = each.select("did", "key", "pos", F.least("pos", F.lit(reach)).alias("at"), around.alias("around"))
    rows = rows.withColumn("term", ascii_lower(F.get("around", F.col("at"))))
    return stored(rows.join(terms, "term", "left_semi"), "postings")


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """(did, key, item_id, start, length, exact): where windows of items occur in documents.

    ``did`` and ``key`` name a row of ``docs`` (``row_names``). With a slop, rows
    with exact = false say that all the window's words, repeats included, occur
    in any order from slop words before ``start`` to slop words behind the
    window's end, the rarest one in its place.
    """
    pivots = pivoted_windows(docs, items, window)
    index = build_index(docs, pivots, window - 1 + slop)
    size = F.size("phrase")

    def shifted(rank: str) -> DataFrame:
        lists = pivots.select(F.col(f"{rank}.term").alias("of"), F.col(f"{rank}.offset").alias("offset"), "window", "item_id", "phrase")
        return index.join(lists, index["term"] == lists["of"]).withColumn("start", F.col("pos") - F.col("offset"))

    first = shifted("rare")
    second = shifted("rare2")
    if slop:  # the second term may lie anywhere in the window and around it
        second = second.withColumn("start", F.explode(F.sequence(F.col("pos") - size - slop + 1, F.col("pos") + slop)))
    both = first.join(second.select("window", "did", "key", "start"), ["window", "did", "key", "start"], "left_semi").withColumn("around", F.transform("around", ascii_lower))
    from_ = F.col("at") - F.col("offset")
    exact = (from_ >= 0) & (F.slice("around", F.greatest(from_, F.lit(0)) + 1, size) == F.col("phrase"))
    low = F.greatest(from_ - slop, F.lit(0))
    both = both.withColumn("reach", F.slice("around", low + 1, from_ + size + slop - low))
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    near = F.forall("phrase", lambda w: times("reach", w) >= times("phrase", w)) if slop else F.lit(False)
    return both.withColumn("exact", exact).where(F.col("exact") | near).select("did", "key", "item_id", "start", size.alias("length"), "exact")


def row_names(docs: DataFrame) -> DataFrame:
    """(did, key, doc_id, text): what matches name the rows by."""
    return docs.select(F.coalesce("doc_id", F.lit(0)).alias("did"), row_key("doc_id", "text").alias("key"), "doc_id", "text")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated), one row for each input row."""
    hits = phrase_matches(docs, items, window).groupBy("did", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    )

    def cover(done: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        new = F.greatest(end - F.greatest(done["end"], s["start"]), F.lit(0))
        return F.struct(F.greatest(done["end"], end).alias("end"), (done["n"] + new).alias("n"))

    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda done: done["n"])
    hits = stored(hits.select("did", "key", covered.cast("long").alias("n_hit"), "items"), "hits")
    named = row_names(docs).select("doc_id", "did", "key", F.size(words_as_written(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return named.join(hits, ["did", "key"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated")
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any occurrence of a window, in the input's columns."""
    hit = stored(phrase_matches(docs, items, window).select(F.col("did").alias("__q_did"), F.col("key").alias("__q_key")).distinct(), "hit")
    named = docs.withColumns({"__q_did": F.coalesce("doc_id", F.lit(0)), "__q_key": row_key("doc_id", "text")})
    return named.join(hit, ["__q_did", "__q_key"], "left_anti").select(*docs.columns)


def op8_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE_OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + 9], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM k),
g AS (SELECT rid, s, n, array_to_string(w[s : s + n - 1], ' ') AS p FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT rid, s, g.n, item_id FROM g JOIN k ON g.p = k.p AND g.n = k.n),
c AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS pos FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""
