"""Substring deduplication by hashing sentences and lines, with ends found word by word.

1. A text is cut into units behind every line end, behind every run of ``.!?``
   that blanks follow and behind every run of ideographic full stops
   (``split="line"``: behind line ends alone; ``"paragraph"``: behind empty lines).
   A piece of fewer than ``least_unit`` words repeats by chance: it is part of the
   unit that follows. Where pieces stay short (lists, code, verse: from the
   ``SHORT_RUN``-th in a row on) a unit also ends behind pieces whose digest says
   so, one in four, so that shifted copies are cut alike. Units cover the whole
   text; each is normalised (lower case, runs of blanks made one space, ends
   trimmed) and hashed. Scripts without blanks count a word for each character.
2. The copies of a digest are grouped over all documents. The earliest ranked
   one (by doc_id, then position) is kept; the others are repeated.
3. Repeated units that follow each other in a document make a run; where one of
   them ended with a short piece, only if their first occurrences follow each
   other too.
4. Passages begin and end within sentences as a rule, and these halves don't
   repeat as units. So the run is drawn out word by word into the units beside it,
   as far as they have the words beside the first occurrence. Runs of ``min_words``
   words or more are removed, the rest is left alone; spans that meet are one.
   Offsets of what was removed refer to the original text (code points, end
   exclusive).

What is not found: passages without a whole unit, and those that differ in every
sentence.

The earliest occurrence of a digest is a minimum, taken per task before
anything is shuffled; only digests that occur twice are joined back, and from a
stored table, so that Spark can split the partition of a unit that a third of
all documents hold. Units are never gathered by digest, only by document. Words
are compared for the two units beside a run, nowhere else.

Defined results: null stays null, empty stays empty; documents with a null id
rank last, by their text; repeated rows (same id and text) rank as one document
and get the same result each; a passage that repeats within its document is kept
once; a document that is a copy as a whole and long enough becomes empty; a very
long text is one row of units in one task and is never cut short; a text without
any end is one unit; other columns are carried along.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, row_key, stored

ENDS = {
    "sentence": re.compile(r"\n|[.!?]+[\x20\x09\x0B-\x0D]+|[。！？]+"),
    "line": re.compile(r"\n"),
    "paragraph": re.compile(r"\n[\x20\x09\x0B-\x0D]*\n"),
}
#: Characters of scripts without blanks between words: Thai, Lao, kana and ideographs.
UNSPACED = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: From so many short pieces in a row on, units end behind one in four of them.
SHORT_RUN = 24
UNITS = "array<struct<digest:binary,pos:int,start:int,end:int,words:int,short:boolean,norm:string>>"
SPANS = "array<struct<start:int,end:int>>"
DRAWN = "array<struct<start:int,end:int,before:int,left:int,after:int,right:int>>"


def marked(words: list[bytes]) -> bool:
    """Whether a short piece ends a unit: one in four, by its own words."""
    return hashlib.md5(b" ".join(words)).digest()[0] < 64


def units_of(texts: pa.Array, ends: re.Pattern[str], least_unit: int) -> pa.Array:
    """The units of each text that has words: digest, number, code point offsets, words, whether a short piece ended it, normalised text."""
    sizes, digests, places, short_ends, norms = [0], [], [], [], []
    for text in texts:
        text, start, pos, held, size, short = text.as_py() or "", 0, 0, [], 0, 0
        last = 0
        for end in [*(m.end() for m in ends.finditer(text)), len(text)]:
            piece = text[last:end]
            words = piece.lower().encode().split()
            many = len(words) + len(UNSPACED.findall(piece))
            held += words
            size += many
            if words:
                short = 0 if many >= least_unit else short + 1
            closes = many >= least_unit or (short >= SHORT_RUN and bool(words) and marked(words))
            if closes or (held and end == len(text)):
                norm = b" ".join(held)
                digests.append(hashlib.blake2b(norm, digest_size=16).digest())
                places.append((pos, start, end, size))
                short_ends.append(many < least_unit)
                norms.append(norm.decode())
                start, pos, held, size = end, pos + 1, [], 0
            last = end
        sizes.append(len(digests))
    numbers = np.array(places, np.int32).reshape(-1, 4)
    fields = [pa.array(digests, pa.binary()), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(short_ends, pa.bool_()), pa.array(norms, pa.string())]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, names=["digest", "pos", "start", "end", "words", "short", "norm"]))


def text_units(text: Column | str, least_unit: int, split: str) -> Column:
    @F.arrow_udf(UNITS)
    def of(texts: pa.Array) -> pa.Array:
        return units_of(texts, ENDS[split], least_unit)

    return of(text)


def common(a: Column, b: Column) -> Column:
    """How many words two lists begin with alike."""
    alike = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(alike, False).cast("int")
    return F.coalesce(F.when(first > 0, first - 1).otherwise(F.size(alike)), F.lit(0))


def repeats(docs: DataFrame, min_words: int, least_unit: int, split: str) -> DataFrame:
    """(did, key, removed): the runs to remove of each document that has any, in order, with how far they reach into the units beside them."""
    # Ids first, rows without one after all others; the text's hash orders what shares an id.
    rank = {"none": F.col("doc_id").isNull(), "did": F.coalesce("doc_id", F.lit(0)), "key": row_key("doc_id", "text")}
    units = docs.select("doc_id", "text").withColumns(rank).select(*rank, F.explode(text_units("text", least_unit, split)).alias("u"))
    units = stored(units.select(*rank, "u.*"), "text-units")
    place = F.struct("none", "did", "key", "pos")
    firsts = units.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = stored(firsts.where("first <> last").select("digest", "first"), "repeated-units")
    later = units.join(firsts, "digest").where(F.col("first") != place).select("did", "key", "pos", "start", "end", "words", "short", "first")
    # From here on all is done where a document's units are: one shuffle.
    later = later.repartition("did", "key").dropDuplicates(["did", "key", "pos"])
    along = Window.partitionBy("did", "key").orderBy("pos")
    before = F.lag(F.struct("pos", "short", "first")).over(along)
    follows = (F.col("first.did") == F.col("p.first.did")) & (F.col("first.key") == F.col("p.first.key")) & (F.col("first.pos") == F.col("p.first.pos") + 1)
    breaks = F.col("p").isNull() | (F.col("pos") != F.col("p.pos") + 1) | ((F.col("short") | F.col("p.short")) & ~follows)
    run = F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(along)
    runs = later.withColumn("p", before).withColumn("run", run).groupBy("did", "key", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min("pos").alias("low"), F.max("pos").alias("high"),
        F.min_by("first", "pos").alias("low_first"), F.max_by("first", "pos").alias("high_first"),
    )
    runs = stored(runs, "repeated-runs")
    drawn = stored(drawn_out(runs, units).where(F.col("words") + F.col("left") + F.col("right") >= min_words), "drawn-runs")
    found = stored(drawn.groupBy("did", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "before", "left", "after", "right"))).alias("removed")), "removed-runs")
    discard(units, firsts, runs, drawn)
    return found


def drawn_out(runs: DataFrame, units: DataFrame) -> DataFrame:
    """The runs with ``left`` and ``right``, the words they go on for on either side, and where the units there begin (``before``) and end (``after``)."""
    texts = units.select("did", "key", "pos", F.col("start").alias("_from"), F.col("end").alias("_to"), "norm")
    side = lambda name, did, key, pos: F.struct(F.lit(name).alias("side"), did.alias("did"), key.alias("key"), pos.alias("pos"))
    own = [F.col("did"), F.col("key")]
    sides = F.array(
        side("left", *own, F.col("low") - 1), side("first_left", F.col("low_first.did"), F.col("low_first.key"), F.col("low_first.pos") - 1),
        side("right", *own, F.col("high") + 1), side("first_right", F.col("high_first.did"), F.col("high_first.key"), F.col("high_first.pos") + 1),
    )
    asked = runs.select(F.col("did").alias("_did"), F.col("key").alias("_key"), "run", F.explode(sides).alias("s")).select("_did", "_key", "run", "s.*").where("pos >= 0")
    told = asked.join(texts, ["did", "key", "pos"]).groupBy("_did", "_key", "run").agg(
        *[F.max(F.when(F.col("side") == name, F.struct("_from", "_to", "norm"))).alias(name) for name in ("left", "first_left", "right", "first_right")]
    )
    words = lambda name: F.split(F.col(f"_t.{name}.norm"), " ")
    told = told.select(F.col("_did").alias("did"), F.col("_key").alias("key"), "run", F.struct("left", "first_left", "right", "first_right").alias("_t"))
    joined = runs.join(told, ["did", "key", "run"], "left")
    return joined.select(
        "did", "key", "start", "end", "words",
        F.coalesce("_t.left._from", "start").alias("before"), common(F.reverse(words("left")), F.reverse(words("first_left"))).alias("left"),
        F.coalesce("_t.right._to", "end").alias("after"), common(words("right"), words("first_right")).alias("right"),
    )


def resolved(text: str, runs: list[dict]) -> list[tuple[int, int]]:
    """The spans of drawn out runs as offsets of the text; those that meet are one."""
    spans: list[tuple[int, int]] = []
    for r in runs:
        start, end = r["start"], r["end"]
        if r["left"]:
            start = [m.start() for m in WORD.finditer(text, r["before"], start)][-r["left"]]
        if r["right"]:
            end = [m.end() for m in WORD.finditer(text, end, r["after"])][r["right"] - 1]
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(end, spans[-1][1])
        else:
            spans.append((start, end))
    return spans


def spans_of(text: Column, runs: Column) -> Column:
    @F.arrow_udf(SPANS)
    def of(texts: pa.Array, drawn: pa.Array) -> pa.Array:
        out = [[{"start": a, "end": b} for a, b in resolved(t, r)] for t, r in zip(texts.to_pylist(), drawn.to_pylist(), strict=True)]
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return of(text, runs)


def cut(text: Column, removed: Column) -> Column:
    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, gone in zip(texts, spans, strict=True):
            text, gone = text.as_py(), gone.as_py()
            edges = [0, *(edge for s in gone or () for edge in (s["start"], s["end"])), None]
            out.append(text if not gone else "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pa.array(out, pa.string())

    return without(text, removed)


def dedup_passages(docs: DataFrame, min_words: int = 50, least_unit: int = 5, split: str = "sentence") -> DataFrame:
    """The input with repeated runs cut from ``text``, and ``removed_spans``: the original offsets of each."""
    named = docs.withColumns({"__q_did": F.coalesce("doc_id", F.lit(0)), "__q_key": row_key("doc_id", "text")})
    runs = repeats(docs, min_words, least_unit, split).toDF("__q_did", "__q_key", "__q_runs")
    # Runs are a few bytes for a text of thousands: hashed per partition, so that texts aren't sorted.
    joined = named.join(runs.hint("shuffle_hash"), ["__q_did", "__q_key"], "left")
    has_runs = F.col("__q_runs").isNotNull()
    touched = F.when(has_runs, F.col("text"))  # other texts stay in the JVM
    known = joined.withColumn("__q_spans", spans_of(touched, F.coalesce("__q_runs", F.array().cast(DRAWN))))
    gone = F.coalesce("__q_spans", F.array().cast(SPANS))
    text = F.when(has_runs, cut(touched, gone)).otherwise(F.col("text"))
    return known.withColumns({"text": text, "removed_spans": gone}).select(*docs.columns, "removed_spans")


def op2_line_dedup(docs: DataFrame) -> DataFrame:
    found = dedup_passages(docs.select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", F.size("removed_spans").cast("long").alias("n_removed"), spans.alias("removed"))


#: Units are cut at a mark of private use, which no text of the tables holds; runs reach into the units beside them as far as words are alike.
ORACLE_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(regexp_replace(text, '(\n|[.!?]+[\x20\x09\x0B-\x0D]+|[。！？]+)', '\1' || chr(63743), 'g'), chr(63743)) AS us FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(us) + 1)) AS nr, unnest(us) AS unit FROM d),
o1 AS (SELECT *, sum(length(unit)) OVER (PARTITION BY rid ORDER BY nr) AS e, list_filter(string_split_regex(lower(unit), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM l),
o2 AS (SELECT *, len(w) + length(regexp_replace(unit, '[^\x{0E00}-\x{0EFF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]', '', 'g')) AS size FROM o1),
o3 AS (SELECT *, count(*) FILTER (size >= 5) OVER (PARTITION BY rid ORDER BY nr) AS section FROM o2),
o AS (SELECT *, size >= 5 OR (len(w) > 0 AND count(*) FILTER (len(w) > 0 AND size < 5) OVER (PARTITION BY rid, section ORDER BY nr) >= 24 AND md5(array_to_string(w, ' ')) < '4') AS closes FROM o3),
b AS (SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nr_unit FROM o),
m AS (SELECT rid, doc_id, nr_unit AS pos, min(e - length(unit)) AS s, max(e) AS e, CAST(sum(size) AS BIGINT) AS words, arg_max(size < 5, nr) AS short, string_agg(unit, '' ORDER BY nr) AS raw, string_agg(array_to_string(w, ' '), ' ' ORDER BY nr) FILTER (len(w) > 0) AS norm FROM b GROUP BY rid, doc_id, nr_unit),
n AS (SELECT *, string_split(norm, ' ') AS ws FROM m WHERE norm IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS k, first_value(rid) OVER w AS frid, first_value(pos) OVER w AS fpos FROM n WINDOW w AS (PARTITION BY norm ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
q AS (SELECT rid, pos, s, e, words, short, frid, fpos, lag(pos) OVER v AS p_pos, lag(short) OVER v AS p_short, lag(frid) OVER v AS p_frid, lag(fpos) OVER v AS p_fpos FROM r WHERE k > 1 WINDOW v AS (PARTITION BY rid ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN p_pos IS NULL OR pos <> p_pos + 1 OR ((short OR p_short) AND NOT (frid = p_frid AND fpos = p_fpos + 1)) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM q),
x AS (SELECT rid, run, min(s) AS s, max(e) AS e, sum(words) AS words, min(pos) AS low, max(pos) AS high, arg_min(frid, pos) AS lrid, arg_min(fpos, pos) AS lpos, arg_max(frid, pos) AS hrid, arg_max(fpos, pos) AS hpos FROM i GROUP BY rid, run),
y AS (SELECT x.*, a.raw AS lraw, c.raw AS rraw, a.ws AS lws, c.ws AS rws,
  coalesce(list_position(list_transform(list_zip(list_reverse(a.ws), list_reverse(f.ws)), lambda z: coalesce(z[1] = z[2], false)), false), len(list_zip(a.ws, f.ws)) + 1, 1) - 1 AS lmost,
  coalesce(list_position(list_transform(list_zip(c.ws, g.ws), lambda z: coalesce(z[1] = z[2], false)), false), len(list_zip(c.ws, g.ws)) + 1, 1) - 1 AS rmost
  FROM x LEFT JOIN n a ON a.rid = x.rid AND a.pos = x.low - 1 LEFT JOIN n f ON f.rid = lrid AND f.pos = lpos - 1 LEFT JOIN n c ON c.rid = x.rid AND c.pos = x.high + 1 LEFT JOIN n g ON g.rid = hrid AND g.pos = hpos + 1),
z AS (SELECT *, CASE WHEN lws IS NULL OR lmost IS NULL THEN 0 ELSE lmost END AS lw, CASE WHEN rws IS NULL OR rmost IS NULL THEN 0 ELSE rmost END AS rw FROM y),
-- A word and the blanks behind (or before) it, as characters from the end of the left unit (or the start of the right one).
h AS (SELECT rid, CAST(s - CASE WHEN lw = 0 THEN 0 ELSE list_sum(list_transform(regexp_extract_all(lraw, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*')[-lw:], lambda u: length(u))) END AS BIGINT) AS rs,
  CAST(e + CASE WHEN rw = 0 THEN 0 ELSE list_sum(list_transform(regexp_extract_all(rraw, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+')[:rw], lambda u: length(u))) END AS BIGINT) AS re FROM z WHERE words + lw + rw >= 50),
j AS (SELECT *, CASE WHEN rs <= max(re) OVER (PARTITION BY rid ORDER BY rs, re ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS begins FROM h),
u AS (SELECT rid, min(rs) AS rs, max(re) AS re FROM (SELECT *, sum(begins) OVER (PARTITION BY rid ORDER BY rs, re) AS span FROM j) GROUP BY rid, span),
g2 AS (SELECT rid, count(*) AS n, string_agg(rs || ':' || re, ',' ORDER BY rs) AS removed, max(re) AS upto, list(rs ORDER BY rs) AS starts, list(re ORDER BY rs) AS ends FROM u GROUP BY rid)
SELECT doc_id, CASE WHEN n > 0 THEN array_to_string(list_transform(list_zip(list_prepend(0, ends), list_append(starts, length(text))), lambda v: substr(text, v[1] + 1, v[2] - v[1])), '') ELSE text END AS text, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN g2 USING (rid)
"""
