"""SimHash near-duplicates through a Gray-order hierarchical index.

1. A document's fingerprint: the majority, bit by bit, of the XXH64 of its word
   shingles. Only (id, fingerprint) goes on; equal fingerprints are one entry
   of the index with the least id, however many copies there are.
2. Pigeonhole parts: of ``blocks`` bit blocks, two fingerprints that differ in
   at most ``distance`` bits agree in all but ``distance`` of them. Each
   fingerprint goes to one part for every choice of blocks to agree in; no pair
   within the distance is missed.
3. The parts are ordered by the Gray rank of their fingerprints, over all tasks
   (a hot part spans several), and cut into branches of leaves. A leaf keeps
   the bits that all its fingerprints share as (mask, pattern); a branch keeps
   those that all its leaves share.
4. Branches of one part are held against each other: a pair of branches, then a
   pair of leaves, is pruned when the masked patterns of both already differ in
   more than ``distance`` bits. Only what is left is compared bit by bit.
5. A comparison returns a spanning forest of its links, not all pairs;
   components are then found in Spark.

Defined results: null and empty texts have fingerprint zero and are linked like
any other; repeated rows each give their own row; component_id ignores null ids
and is null only where no linked document has one; a very long text is hashed
whole, in one task; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, row_key, stored
from quern.llm.components import connected_components

BITS = 64
LEAF, FANOUT = 64, 16
ALL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """Unsigned; bytes.lower and bytes.split touch ASCII only, as the definition of words wants."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = memoryview(b" ".join(words))
    hashed = np.empty(n, np.uint64)
    digest, start, ends = xxhash.xxh64_intdigest, 0, []
    at = -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    for i in range(n):
        end = ends[min(i + shingle, len(words)) - 1]
        hashed[i] = digest(joined[start:end], seed)
        start = ends[i] + 1
    ones = np.zeros(BITS, np.int64)
    for low in range(0, n, 65536):  # bounded memory however long the text
        bits = np.unpackbits(hashed[low : low + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column | str, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint as a long (the unsigned bits as two's complement)."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The position of a code word in the reflected Gray sequence: a prefix XOR of its bits."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_rank_column(x: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, shift))
    return x


def part_masks(blocks: int, distance: int) -> list[int]:
    """One mask for each choice of blocks that must agree."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]  # noqa: B905
    return [sum(chosen) for chosen in combinations(masks, blocks - distance)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(count: int, distance: int, per_part: int) -> int:
    """The fewest blocks whose parts hold about ``per_part`` of ``count`` evenly spread fingerprints."""
    blocks = distance + 1
    while count / 2 ** (BITS * (blocks - distance) / blocks) > per_part and blocks < distance + 4:
        blocks += 1
    return blocks


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links (a[i], b[i]) connect, each component as a heap-shaped tree of low degree."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for x in sorted(parent):
        groups.setdefault(find(x), []).append(x)
    return [(g[(i - 1) // 2], g[i]) for g in groups.values() for i in range(1, len(g))]


def common(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, pattern) of the bits that each run of values shares."""
    both, any_ = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
    return both | ~any_, both


def differences(mask_a: np.ndarray, a: np.ndarray, mask_b: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At least so many bits differ between any member of a and any of b, for all pairs of nodes."""
    return np.bitwise_count((a[:, None] ^ b[None, :]) & mask_a[:, None] & mask_b[None, :])


def links(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two branches in Gray order: leaves first, then what no pair of leaves prunes."""
    sx, sy = np.arange(0, len(x), LEAF), np.arange(0, len(y), LEAF)
    near = differences(*common(x, sx), *common(y, sy)) <= distance
    found_a, found_b = [], []
    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = x[sx[i] : sx[i] + LEAF], y[sy[j] : sy[j] + LEAF]
        k, m = np.nonzero(np.bitwise_count(p[:, None] ^ q[None, :]) <= distance)
        found_a.append(p[k])
        found_b.append(q[m])
    if not found_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = np.concatenate(found_a).view(np.int64), np.concatenate(found_b).view(np.int64)
    return a[a != b], b[a != b]


BRANCH = "part int, key long, branch long, mask long, pattern long, members array<long>"


def branches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts a task's rows, sorted by part, key and Gray rank, into branches of at most LEAF * FANOUT.

    A branch is named by its first fingerprint's rank, so that names hold
    whatever the tasks are. A part that spans batches or tasks only ends
    branches earlier.
    """
    schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("branch", pa.int64()), ("mask", pa.int64()), ("pattern", pa.int64()), ("members", pa.list_(pa.int64()))])
    for batch in rows:
        n = batch.num_rows
        if not n:
            continue
        part, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.nonzero((np.arange(n) - first) % (LEAF * FANOUT) == 0)[0]
        values = fp.view(np.uint64)
        mask, pattern = common(values, starts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part[starts], pa.int32()),
                pa.array(key[starts], pa.int64()),
                pa.array(gray_rank(values[starts]).view(np.int64)),
                pa.array(mask.view(np.int64)),
                pa.array(pattern.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.r_[starts, n], pa.int32()), pa.array(fp, pa.int64())),
            ],
            schema=schema,
        )


def linked_fingerprints(entries: DataFrame, distance: int, blocks: int) -> DataFrame:
    """(a, b): edges that connect all fingerprints within the distance. ``entries``: distinct fp."""
    masks = part_masks(blocks, distance)
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keyed = entries.select("fp", parts.alias("p")).select("p.part", "p.key", "fp").withColumn("rank", gray_rank_column(F.col("fp")))
    # Signed order of a rank is a rotation of its order: runs of shared bits stay together.
    ordered = keyed.repartitionByRange("part", "key", "rank").sortWithinPartitions("part", "key", "rank")
    tree = stored(ordered.select("part", "key", "fp").mapInArrow(branches, BRANCH), "gray-branches")

    def within(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compared(rows, distance, 1)

    def between(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from compared(rows, distance, 2)

    inside = tree.where(F.size("members") > 1).select("members").mapInArrow(within, "a long, b long")
    left, right = tree.alias("l"), tree.alias("r")
    apart = F.bit_count(F.col("l.pattern").bitwiseXOR(F.col("r.pattern")).bitwiseAND(F.col("l.mask")).bitwiseAND(F.col("r.mask")))
    pairs = left.join(right, (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.branch") < F.col("r.branch")) & (apart <= distance))
    across = pairs.select(F.col("l.members").alias("x"), F.col("r.members").alias("y")).mapInArrow(between, "a long, b long")
    return inside.union(across)


def compared(rows: Iterator[pa.RecordBatch], distance: int, sides: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        edges: list[tuple[int, int]] = []
        columns = [batch.column(i) for i in range(sides)]
        values = [c.values.to_numpy().view(np.uint64) for c in columns]
        offsets = [c.offsets.to_numpy() for c in columns]
        for i in range(batch.num_rows):
            x, y = (v[o[i] : o[i + 1]] for v, o in zip((values * 2)[:2], (offsets * 2)[:2], strict=True))
            a, b = links(x, y, distance)
            if len(a):
                edges += forest(a, b)
        a, b = zip(*edges) if edges else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def grouped(docs: DataFrame, distance: int, shingle: int, seed: int, per_part: int) -> DataFrame:
    """(doc_id, row, fp, root, component_id), one row for each input row."""
    marked = stored(docs.select("doc_id", row_key("doc_id", "text").alias("row"), fingerprints("text", shingle, seed).alias("fp")), "fingerprints")
    entries = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    blocks = blocks_for(entries.count(), distance, per_part)
    found = connected_components(linked_fingerprints(entries.select("fp"), distance, blocks))
    placed = stored(entries.join(found, entries["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    roots = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    labels = stored(placed.select("fp", "root").join(roots, "root").select(F.col("fp").alias("of"), "root", "component_id"), "labels")
    discard(entries, placed, roots)
    return marked.join(labels, marked["fp"] == labels["of"]).select("doc_id", "row", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42, per_part: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id), one row for each input row."""
    return grouped(docs, distance, shingle, seed, per_part).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42, per_part: int = 4096) -> DataFrame:
    """The documents that represent their component, in the input's columns."""
    return representatives(docs, grouped(docs, distance, shingle, seed, per_part))


def representatives(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """One document of each component. ``placed``: doc_id, row (``row_key``), root.

    That with the least id stays, and of rows that share it, that with the
    least key; a document without an id stays only where its component has no
    other. Texts are held against keys alone; only rows that are there more than
    once, id and text alike, are gathered.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = placed.groupBy("root").agg(F.min(rank).alias("r")).select(F.coalesce("r.doc_id", F.lit(0)).alias("__q_did"), F.col("r.row").alias("__q_row"))
    times = placed.groupBy(F.coalesce("doc_id", F.lit(0)).alias("__q_did"), F.col("row").alias("__q_row")).agg(F.count("*").alias("times"))
    kept = stored(first.join(times, ["__q_did", "__q_row"]), "representatives")
    named = docs.withColumns({"__q_did": F.coalesce("doc_id", F.lit(0)), "__q_row": row_key("doc_id", "text")})
    single = named.join(kept.where("times = 1"), ["__q_did", "__q_row"], "left_semi")
    repeated = named.join(kept.where("times > 1"), ["__q_did", "__q_row"], "left_semi").dropDuplicates(["__q_did", "__q_row"])
    return single.union(repeated).select(*docs.columns)


def op7_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
