"""The Merkle manifest against trees built node by node."""

import hashlib
import zlib

import duckdb
import pytest

from quern.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(leaves):
    """(root, for each leaf its steps), level by level."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            other = p ^ 1
            paths[i].append(None if other >= len(level) else (other < p, level[other]))
            at[i] = p // 2
        level = [digest(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def fold(leaf, path):
    for step in path:
        leaf = digest(leaf) if step is None else digest(step[1], leaf) if step[0] else digest(leaf, step[1])
    return leaf


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    out, trees = [], {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, brute_leaf(r), r))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: brute_tree([x[2] for x in sorted(trees[k], key=lambda x: x[:3])]) for k in order}
    root, tops = brute_tree([built[k][0] for k in order]) if order else (None, [])
    for k, top in zip(order, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(trees[k], key=lambda x: x[:3]), built[k][1], strict=True):
            steps = path + top
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            end = fold(brute_leaf((*r[:3], r[3] + 1, r[4])) if changed else leaf, steps)
            out.append((r[0], leaf, built[k][0], root, digest(*(s[1] for s in steps if s)), end, end == root))
    return sorted(out, key=repr)


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65])
def test_trees_of_every_shape(spark, n):
    rows = [(i, "s", ["en", "fr", None, "é", ""][i % (1 + n % 5)], i if i % 3 else None, f"text {i}") for i in range(n)]
    got = sorted((tuple(r) for r in merkle.op12_merkle(spark.createDataFrame(rows, COLUMNS).repartition(3)).collect()), key=repr)
    assert got == brute(rows)


def test_a_tree_of_several_blocks(spark):
    """More rows than a block holds: rounds of combining, frontiers at the edges of tasks, paths handed down."""
    rows = [(i * 3, f"s{i % 5}", "en" if i % 10 else "fr", i, f"t{i}") for i in range(9000)]
    found = merkle.op12_merkle(spark.createDataFrame(rows, COLUMNS).repartition(7)).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    assert not all(r["verified"] for r in found) and all(r["verified"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 != 0) for r in found)


def test_events_in_any_order_give_the_same_nodes():
    leaves = [digest(str(i)) for i in range(1000)]
    want = brute_tree(leaves)[0]
    for step in (1, 7, 333, 999):
        parents = merkle.Parents(0)
        for i in range(1000):
            at = i * step % 1000 if step != 333 else 999 - i
            parents.add("t", 1000, 0, at, leaves[at])
        assert parents.taken() == [("t", 1000, merkle.BLOCK, 0, want)] and parents.frontier() == []


def test_frontiers_resolve_what_tasks_could_not():
    leaves = [digest(str(i)) for i in range(100)]
    tasks = [merkle.Parents(0) for _ in range(3)]
    for i, leaf in enumerate(leaves):
        tasks[0 if i < 33 else 1 if i < 71 else 2].add("t", 100, 0, i, leaf)
    frontier = [e for t in tasks for e in t.frontier()]
    assert len(frontier) < 20 and not any(t.taken() for t in tasks)
    last = merkle.Parents(0)
    for event in frontier:
        last.add(*event)
    assert last.taken()[0][4] == brute_tree(leaves)[0]


def test_manifest_of_odd_tables(spark, docs, empty, clashing):
    assert merkle.op12_merkle(empty).count() == 0
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]
    for table in (docs, clashing):
        assert sorted((tuple(r) for r in merkle.op12_merkle(table).collect()), key=repr) == brute(rows)


def test_cells_are_told_apart(spark):
    rows = [(1, None, "en", 1, ""), (1, "", "en", 1, None), (1, "-", "en", 1, None), (1, "a1:b", "en", 1, ""), (1, "a", "en", 1, "b")]
    assert len({r["leaf"] for r in merkle.op12_merkle(spark.createDataFrame(rows, COLUMNS)).collect()}) == len(rows)


def test_the_sql_agrees_on_odd_rows(spark, docs):
    """Nulls and repeated rows, which the tables of the correctness gate may lack."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    got = sorted((tuple(r) for r in merkle.op12_merkle(docs).collect()), key=repr)
    assert got == sorted(con.execute(merkle.ORACLE_OP12).fetchall(), key=repr)
