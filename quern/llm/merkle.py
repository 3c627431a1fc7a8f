"""Merkle manifest of a dataset: every row a leaf, a tree for each group, one root above them.

The leaves of a group stand in the order of a key. While several nodes remain,
every two that follow one another become the digest of both (a last lone one the
digest of itself). Roots of groups, in order of the group (null first, then
bytewise), are the leaves of one more tree, whose root names the whole dataset.

Nodes climb by events. A node that arrives puts its digest, by its index, into its
parent's partial entry; the group's size says how many children a parent has (two,
or one at the end). When they are there, the parent is emitted and becomes an event
itself. Each task combines what it holds, as a combiner does before a shuffle; only
what is left unresolved, the frontier along its edges, is reshuffled by block (the
nodes below one ancestor ``BLOCK`` levels up, so at most 4,096) and combined again.
So each round lifts a whole level of blocks, and log2(rows) / 12 rounds reach the
roots. Proofs go the other way: a node keeps its block as a reverse link, and each
block hands the path above it to the nodes within.

Defined results: a null cell is ``-`` and so differs from an empty one; a null
group is one of its own and comes first; rows that share or lack a key are ordered
by their leaves, so that repeated rows have the same leaf but each its own place and
proof; an empty table has no rows and no root; a group of one row has its leaf as
root; other columns are ignored; a very long text is digested whole where it is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import discard, stored
from quern.operators.ordering import in_ranges

#: Levels that one round climbs, and with them the rows of a block (2 ** 12).
BLOCK = 12
#: Partial parents that a task holds before it passes them on; in order it holds a few dozen.
HELD = 1 << 16
NODE = "tree string, size long, at long, digest string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A cell without ambiguity: ``-`` for null, else bytes, colon, value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def above(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(size: int, level: int) -> int:
    """Nodes of a tree of ``size`` leaves on a level."""
    return (size + (1 << level) - 1) >> level


class Parents:
    """Partial parents: indexed child digests, kept until all are there that the tree's size gives."""

    def __init__(self, base: int):
        self.base = base
        self.partial: dict[tuple[str, int, int], tuple[int, dict[int, str]]] = {}
        self.done: list[tuple[str, int, int, int, str]] = []

    def add(self, tree: str, size: int, level: int, at: int, digest: str) -> None:
        while level < self.base + BLOCK and width(size, level) > 1:
            parent, slot = divmod(at, 2)
            key = (tree, level + 1, parent)
            children = self.partial.setdefault(key, (size, {}))[1]
            children[slot] = digest
            if len(children) < min(2, width(size, level) - 2 * parent):
                return
            del self.partial[key]
            digest = above(children[s] for s in sorted(children))
            level, at = level + 1, parent
        self.done.append((tree, size, self.base + BLOCK, at, digest))

    def frontier(self) -> list[tuple[str, int, int, int, str]]:
        """What is unresolved: the children that wait for others."""
        left = [(tree, size, level - 1, 2 * parent + slot, digest) for (tree, level, parent), (size, children) in self.partial.items() for slot, digest in children.items()]
        self.partial.clear()
        return left

    def taken(self) -> list[tuple[str, int, int, int, str]]:
        done, self.done = self.done, []
        return done


EVENT = "tree string, size long, level int, at long, digest string"
EVENTS = pa.schema([("tree", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("digest", pa.string())])


def events(rows: list[tuple[str, int, int, int, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, EVENTS, strict=True)], schema=EVENTS)


def climbed(nodes: DataFrame, base: int) -> DataFrame:
    """The nodes ``BLOCK`` levels above ``base`` (a tree that ends before gives its root). nodes: (tree, size, at, digest)."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parents = Parents(base)
        for batch in batches:
            for tree, size, at, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parents.add(tree, size, base, at, digest)
            if len(parents.partial) > HELD:
                yield events(parents.frontier())
            yield events(parents.taken())
        yield events(parents.frontier())

    def resolve(rows: pa.Table) -> pa.Table:
        parents = Parents(base)
        for event in zip(*[rows[name].to_pylist() for name in EVENTS.names], strict=True):
            parents.add(*event)
        return pa.Table.from_batches([events(parents.taken())])

    combined = stored(nodes.select("tree", "size", "at", "digest").mapInArrow(combine, EVENT), "combined")
    top = base + BLOCK
    waiting = combined.where(F.col("level") < top).withColumn("block", F.expr(f"shiftright(at, {top} - level)"))
    resolved = waiting.groupBy("tree", "block").applyInArrow(resolve, EVENT)
    found = stored(combined.where(F.col("level") == top).unionByName(resolved).select("tree", "size", "at", "digest"), "climbed")
    discard(combined)
    return found


def placed(leaves: DataFrame, *order: str) -> DataFrame:
    """The rows with their place (``at``) in their tree and its ``size``. leaves: (tree, digest, ...), stored."""
    ranked = in_ranges(leaves, ["tree", *order, "digest"])
    parts = ranked.groupBy("tree", "_p").agg(F.count("*").alias("n"), F.min("_i").alias("first"))
    tree = Window.partitionBy("tree")  # a row for each range that the tree lies in
    before = F.coalesce(F.sum("n").over(tree.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("tree").alias("_t"), F.col("_p").alias("_q"), (before - F.col("first")).alias("_shift"), F.sum("n").over(tree).alias("size"))
    joined = ranked.join(starts, (F.col("tree") == F.col("_t")) & (F.col("_p") == F.col("_q")))
    found = stored(joined.select(*leaves.columns, "size", (F.col("_i") + F.col("_shift")).alias("at")), "placed")
    discard(ranked)
    return found


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes on levels 0, BLOCK, 2 BLOCK ...; the last table has a row for each tree, its root."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    found = [nodes]
    while not found[1:] or width(largest, (len(found) - 1) * BLOCK) > 1:
        found.append(climbed(found[-1], (len(found) - 1) * BLOCK))
    return found


def steps_within(digests: list[str], size: int, base: int) -> list[list[str]]:
    """For each node of a block, in order, its steps up to the block's top: ``L`` or ``R`` with the sibling on that side, ``-`` without one."""
    steps: list[list[str]] = [[] for _ in digests]
    for level in range(base, base + BLOCK):
        if width(size, level) == 1:
            break
        for i, mine in enumerate(steps):
            at = (i >> (level - base)) ^ 1
            mine.append(("L" if at < i >> (level - base) else "R") + digests[at] if at < len(digests) else "-")
        digests = [above(digests[i : i + 2]) for i in range(0, len(digests), 2)]
    return steps


def descended(nodes: DataFrame, tops: DataFrame, base: int) -> DataFrame:
    """The nodes with ``steps``, subroot and root: those within their block, then those of the block. tops: (tree, at, steps, subroot, root)."""
    names = nodes.columns

    def hand_down(block: pa.Table, top: pa.Table) -> pa.Table:
        block = block.sort_by("at")
        path = top.to_pylist()[0]
        steps = [s + path["steps"] for s in steps_within(block["digest"].to_pylist(), block["size"][0].as_py(), base)] if block.num_rows else []
        columns = [block[c] for c in names] + [pa.array(steps, pa.list_(pa.string()))] + [pa.array([path[c]] * len(steps), pa.string()) for c in ("subroot", "root")]
        return pa.Table.from_arrays(columns, names=[*names, "steps", "subroot", "root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", steps array<string>, subroot string, root string"
    keyed = nodes.withColumn("_block", F.shiftright("at", BLOCK)).groupBy("tree", "_block")
    return keyed.cogroup(tops.withColumnRenamed("at", "_block").groupBy("tree", "_block")).applyInArrow(hand_down, schema)


def walked_down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The paths of all leaves of ``rounds``. top: the paths of its last table."""
    for i in reversed(range(len(levels) - 1)):
        below = descended(levels[i], top, i * BLOCK)
        top = below if i == 0 else stored(below.select("tree", "at", "steps", "subroot", "root"), "paths")
    return top


def proofs(leaves: DataFrame, *order: str) -> DataFrame:
    """The rows with size, place, ``steps`` to the root, subroot and root.

    leaves: (tree, digest, ...) with a string ``tree`` (no nulls) whose order is
    that of the trees; ``order`` are the columns that order the leaves of a tree.
    """
    levels = rounds(placed(leaves, *order))
    subroots = stored(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest"), "subroots")
    upper = rounds(placed(subroots, "of"))
    whole = upper[-1].select("tree", "at", F.array().cast("array<string>").alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    tops = walked_down(upper, whole).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("at"), "steps", F.col("digest").alias("subroot"), "root")
    found = stored(walked_down(levels, stored(tops, "subroot-paths")), "proofs")
    discard(*levels, *upper, subroots)
    return found


def folded(digest: Column | str, steps: Column | str) -> Column:
    """The root that a leaf and its steps lead to."""

    @F.arrow_udf("string")
    def fold(leaves: pa.Array, paths: pa.Array) -> pa.Array:
        out = []
        for at, path in zip(leaves.to_pylist(), paths.to_pylist(), strict=True):
            for step in path:
                side, sibling = step[0], step[1:]
                at = above((sibling, at) if side == "L" else (at, sibling))
            out.append(at)
        return pa.array(out, pa.string())

    return fold(digest, steps)


def siblings_digest(steps: Column) -> Column:
    given = F.filter(steps, lambda s: s != "-")
    return F.sha2(F.array_join(F.transform(given, lambda s: F.substring(s, 2, 64)), ""), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", key: str = "doc_id", also: dict[str, Column] | None = None) -> DataFrame:
    """(key, group, digest, <also>, size, at, steps, subroot, root): each row's leaf, place and proof. also: further columns of the input to keep."""
    tree = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = docs.select(F.col(key), F.col(group), tree.alias("tree"), leaf(*map(F.col, fields)).alias("digest"), *[c.alias(name) for name, c in (also or {}).items()])
    kept = stored(leaves, "leaves")  # ranges are drawn from a sample: nothing is digested twice
    found = proofs(kept, key)
    discard(kept)
    return found.drop("tree")


def op12_merkle(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, and what they lead to where a share of them (by crc32 of the id) has one character more than it says."""
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    changed = F.when(chosen, leaf(*[F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in FIELDS]))
    found = manifest(docs, also={"changed": changed})
    return found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        siblings_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.coalesce("changed", "digest"), "steps").alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 bit by bit (no such function there), the levels by a recursive table, the folds by another.
ORACLE_OP12 = """
WITH RECURSIVE leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 7 = 0, false) AS chosen
  FROM documents),
digests AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen((n_chars + chosen::INT)::VARCHAR) || ':' || (n_chars + chosen::INT)::VARCHAR, '-') || tail) AS changed
  FROM leaves),
places AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM places
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n),
subroots AS (SELECT tree, digest AS subroot, level AS height, row_number() OVER (ORDER BY tree) - 1 AS pos FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
paths AS (
  SELECT doc_id, p.tree, leaf, changed AS at_digest, p.pos, 0 AS level, '' AS siblings, subroot, height, s.pos AS tree_at FROM places p JOIN subroots s ON p.tree = s.tree
  UNION ALL
  SELECT doc_id, p.tree, leaf, sha256(CASE WHEN sib.digest IS NULL THEN at_digest WHEN sib.pos < p.pos THEN sib.digest || at_digest ELSE at_digest || sib.digest END),
    p.pos // 2, p.level + 1, siblings || coalesce(sib.digest, ''), subroot, height, tree_at
  FROM paths p LEFT JOIN nodes sib ON sib.tree = p.tree AND sib.level = p.level AND sib.pos = xor(p.pos, 1) WHERE p.level < height),
tops AS (SELECT max(level) AS top FROM upper),
above AS (
  SELECT doc_id, leaf, at_digest, tree_at AS pos, 0 AS level, siblings, subroot FROM paths WHERE level = height
  UNION ALL
  SELECT doc_id, leaf, sha256(CASE WHEN sib.digest IS NULL THEN at_digest WHEN sib.pos < p.pos THEN sib.digest || at_digest ELSE at_digest || sib.digest END),
    p.pos // 2, p.level + 1, siblings || coalesce(sib.digest, ''), subroot
  FROM above p LEFT JOIN upper sib ON sib.level = p.level AND sib.pos = xor(p.pos, 1) WHERE p.level < (SELECT top FROM tops))
SELECT doc_id, leaf, subroot, u.digest AS root, sha256(siblings) AS proof_sha256, at_digest AS folded_root, at_digest = u.digest AS verified
FROM above a, (SELECT digest FROM upper WHERE n = 1) u WHERE a.level = (SELECT top FROM tops)
"""
