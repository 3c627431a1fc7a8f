"""Near-copies: SimHash and bands of minima find candidates, exact similarity confirms them.

Fingerprints that differ in a few bits (``simhash``) give the first candidates. They
are nearly equal texts only, and at the 9 to 16 bits that texts of similarity 0.8
differ in, the index of fingerprints no longer prunes. So a document's shingles are
also hashed and the least value under each of many permutations is taken; documents that agree in a band of minima share a bucket.
A pair of Jaccard similarity 0.8 shares one with probability 0.9999.

1. Equal word sequences are one entry, however many copies there are.
2. Each member of a bucket is held against the bucket's least entry, and entries of
   one or of linked fingerprints against each other, by the exact similarity of both
   texts; confirmed pairs make components.
3. In buckets that still hold several components, entries of different ones are
   held against each other too, so that no pair is lost for want of a like pivot.
   They go through in blocks of bounded size, block against block: four bits of
   each minimum tell apart what can't be similar (99.997 % of pairs at the wanted
   similarity pass), the hashes of all shingles confirm the rest. Only links
   become rows, however large a group of loose copies is.

Words and short texts are read as in ``simhash``: ASCII case is ignored, a text
of fewer words than a shingle is one shingle, null and empty texts are alike;
very long texts are read whole, in one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, row_key, stored
from quern.llm.components import connected_components
from quern.llm.simhash import blocks_for, fingerprints, linked_fingerprints, representatives

BANDS, ROWS = 32, 6
BITS, WORDS, SEED, PER_PART = 3, 3, 42, 4096  # of fingerprints, as in ``simhash``
PLANES, DEVIATIONS = 4, 4
BLOCK = 100_000  # shingles of a block: under a megabyte, or one long text
_DRAWN = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
FACTORS, SHIFTS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def shingles(text: str | None, size: int) -> set[bytes]:
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def jaccard(a: str | None, b: str | None, size: int) -> float:
    x, y = shingles(a, size), shingles(b, size)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def word_key(text: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join((text or "").encode().lower().split()), digest_size=8).digest(), "little", signed=True)


def least_of(shingled: set[bytes] | set[str]) -> np.ndarray:
    """The least value of a set under each permutation."""
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(s, 42) for s in shingled), np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(hashed), 1024):  # bounded memory however long the text
        least = np.minimum(least, (hashed[None, low : low + 1024] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return least


def band_values(least: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def marks_of(least: np.ndarray) -> np.ndarray:
    """The last four bits of every minimum, a plane of longs for each bit."""
    bits = (least[None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64).reshape(-1)


def most_unlike(similarity: float) -> int:
    """Minima whose marks differ, at most, in all but a few of 100 000 pairs of the similarity."""
    n, q = BANDS * ROWS, (1 - similarity) * (1 - 2**-PLANES)
    return math.floor(n * q + DEVIATIONS * math.sqrt(n * q * (1 - q)))


SKETCH = "struct<key:long,buckets:array<long>,marks:array<long>>"


def sketches(text: Column | str, size: int) -> Column:
    """The key of a text's word sequence, its buckets, one for each band, and its marks."""

    @F.arrow_udf(SKETCH)
    def of(texts: pa.Array) -> pa.Array:
        keys, bands, marks = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for t in texts:
            text = t.as_py()
            least = least_of(shingles(text, size))
            keys.append(word_key(text))
            bands.append(band_values(least))
            marks.append(marks_of(least))
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * width), pa.array(np.concatenate(values))) for width, values in ((BANDS, bands), (PLANES * BANDS * ROWS // 64, marks))]
        return pa.StructArray.from_arrays([pa.array(keys, pa.int64()), *lists], names=["key", "buckets", "marks"])

    return of(text)


def similarity_of(a: Column | str, b: Column | str, size: int) -> Column:
    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([jaccard(x.as_py(), y.as_py(), size) for x, y in zip(left, right, strict=True)], pa.float64())

    return of(a, b)


def shingle_hashes(text: Column | str, size: int) -> Column:
    @F.arrow_udf("array<long>")
    def of(texts: pa.Array) -> pa.Array:
        digest = xxhash.xxh64_intdigest
        return pa.array([np.fromiter((digest(s, 42) for s in shingles(t.as_py(), size)), np.uint64).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return of(text)


class Block:
    """The members of row ``i`` of a column of blocks, as arrays."""

    def __init__(self, column: pa.ListArray, i: int):
        start, end = column.offsets[i].as_py(), column.offsets[i + 1].as_py()
        members = column.values.slice(start, end - start)
        whole = lambda name: members.field(name).to_numpy(zero_copy_only=False)
        lists = lambda name: members.field(name).flatten().to_numpy(zero_copy_only=False)
        self.key, self.root = whole("key"), whole("root")
        self.band = np.argmax(lists("buckets").reshape(-1, BANDS) == whole("bucket")[:, None], axis=1)
        self.buckets = lists("buckets").reshape(-1, BANDS)
        self.marks = lists("marks").view(np.uint64).reshape(len(self.key), PLANES, -1)
        self.shingles = np.split(lists("shingles"), np.cumsum(members.field("shingles").value_lengths().to_numpy(zero_copy_only=False))[:-1])


def links_between(x: Block, y: Block, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The links of different components between two blocks of a bucket, each in the first bucket that both entries share."""
    differ = np.zeros((len(x.key), len(y.key)), np.int64)
    for w in range(x.marks.shape[2]):
        bits = np.zeros(differ.shape, np.uint64)
        for plane in range(PLANES):
            bits |= x.marks[:, plane, w][:, None] ^ y.marks[:, plane, w][None, :]
        differ += np.bitwise_count(bits)
    i, j = np.nonzero((differ <= most_unlike(similarity)) & (x.root[:, None] != y.root[None, :]))
    first = np.argmax(x.buckets[i] == y.buckets[j], axis=1) == x.band[i]
    kept = []
    for m, n in zip(i[first].tolist(), j[first].tolist(), strict=True):
        p, q = x.shingles[m], y.shingles[n]
        both = len(np.intersect1d(p, q, assume_unique=True))
        if both / (len(p) + len(q) - both) >= similarity:
            kept.append((m, n))
    a, b = np.array(kept, np.int64).reshape(-1, 2).T
    return x.key[a], y.key[b]


def confirmed(pairs: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) whose texts are at least so similar."""
    both = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b")
    return both.where(similarity_of("x", "y", size) >= similarity).select("a", "b")


def fingerprint_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): keys whose fingerprints are equal or linked, a the less; each fingerprint is met by its least key. Stored."""
    prints = stored(entries.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    near = linked_fingerprints(prints.select("fp"), BITS, blocks_for(prints.count(), BITS, PER_PART))
    ends = [prints.select(F.col("fp").alias(side), F.col("least").alias(f"least_{side}")) for side in "ab"]
    apart = near.join(ends[0], "a").join(ends[1], "b").select(F.least("least_a", "least_b").alias("a"), F.greatest("least_a", "least_b").alias("b"))
    alike = entries.join(prints, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    found = stored(apart.union(alike).distinct(), "print-pairs")
    discard(prints)
    return found


def similar_components(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """(doc_id, row, root), one row for each input row: ``row`` is its key, ``root`` names its component."""
    sketched = docs.select("doc_id", row_key("doc_id", "text").alias("row"), sketches("text", size).alias("s"), fingerprints("text", WORDS, SEED).alias("fp"))
    marked = stored(sketched.select("doc_id", "row", "s.*", "fp"), "sketches")
    entries = stored(marked.groupBy("key").agg(F.min("row").alias("row"), F.first("buckets").alias("buckets"), F.first("marks").alias("marks"), F.first("fp").alias("fp")), "entries")
    printed = fingerprint_pairs(entries)
    members = entries.select("key", F.explode("buckets").alias("bucket"))
    pivots = members.groupBy("bucket").agg(F.min("key").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a")
    pivots = stored(pivots, "bucket-pivots")
    shared = stored(members.join(pivots, "bucket"), "shared-buckets")
    stars = stored(shared.where("key <> a").select("a", F.col("key").alias("b")).union(printed).distinct(), "star-pairs")
    met = shared.select("key").union(printed.select("a")).union(printed.select("b")).distinct()
    wanted = stored(entries.select("key", "row").join(met, "key", "left_semi"), "wanted-rows")
    # Equal rows have equal texts: the first will do.
    texts = docs.select(row_key("doc_id", "text").alias("row"), "text").join(wanted, "row").groupBy("key").agg(F.first("text").alias("text"))
    texts = stored(texts, "wanted-texts")
    links = stored(confirmed(stars, texts, similarity, size), "star-links")

    def rooted(found: DataFrame, keyed: DataFrame) -> DataFrame:
        return keyed.join(found, keyed["key"] == found["node"], "left").withColumn("root", F.coalesce("root", "key")).drop("node")

    roots = connected_components(links)
    placed = stored(rooted(roots, shared), "placed-members")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    split = stored(placed.join(mixed, "bucket").select("bucket", "key", "root"), "split-buckets")
    hashed = texts.join(split.select("key").distinct(), "key", "left_semi").select("key", shingle_hashes("text", size).alias("shingles"))
    known = stored(hashed.join(entries.select("key", "buckets", "marks"), "key"), "split-entries")
    sizes = split.join(known.select("key", F.size("shingles").alias("n")), "key").groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    placed_in = split.join(sizes, "bucket").select("bucket", "key", "root", F.pmod(F.xxhash64("key"), F.col("blocks")).alias("block"))
    member = F.struct("key", "root", "bucket", "buckets", "marks", "shingles")
    blocks = stored(placed_in.join(known, "key").groupBy("bucket", "block").agg(F.collect_list(member).alias("members")), "split-blocks")
    left, right = (blocks.select("bucket", F.col("block").alias(f"block_{side}"), F.col("members").alias(side)) for side in "xy")
    pairs = left.join(right, "bucket").where("block_x <= block_y").select("x", "y")

    def linked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [links_between(Block(batch.column(0), i), Block(batch.column(1), i), similarity) for i in range(batch.num_rows)]
            a, b = (np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    links_across = pairs.mapInArrow(linked, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(links_across.distinct(), "cross-links")
    if more.take(1):
        roots = connected_components(links.union(more))
    discard(entries, printed, pivots, shared, stars, wanted, texts, links, placed, split, known, blocks, more)
    return marked.select("doc_id", "row", "key").join(roots, F.col("key") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "key").alias("root"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each group of near-copies, in the input's columns; see ``simhash.representatives``."""
    return representatives(docs, similar_components(docs, similarity, size))
