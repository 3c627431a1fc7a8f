"""Connected components of an edge table, in Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, stored

#: Rows of one file of a round's tables: small graphs don't become hundreds of tiny files.
FILE_ROWS = 250_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the least node reachable.

    Each round, a node looks at the grandparents of its neighbours, hooks its
    own parent and itself to the least of them, and then halves its path to the
    root. Rounds grow with the logarithm of the longest path. Every round's
    table is stored, so that joins on a hot parent can be split and a lost
    executor repeats one round at most; minima are taken per task before they
    are shuffled. Tables of past rounds are deleted. Null ends and loops are
    ignored; without edges the result is empty.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(edges.union(edges.select("b", "a")).distinct(), "edges")
    files = max(1, both.count() // FILE_ROWS)

    def with_grandparents(moved: DataFrame) -> DataFrame:
        parents = stored(moved.coalesce(files), "parents")
        up = parents.select(F.col("node").alias("up"), F.col("parent").alias("grand"))
        found = stored(parents.join(up, parents["parent"] == up["up"]).select("node", "parent", "grand").coalesce(files), "components")
        discard(parents)
        return found

    state = with_grandparents(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("parent")))
    last = None
    while True:
        # The least grandparent among the neighbours of each node.
        seen = both.join(state.select(F.col("node").alias("b"), "grand"), "b").groupBy("a").agg(F.min("grand").alias("seen"))
        own = stored(state.join(seen, state["node"] == seen["a"]).select("node", "parent", F.least("grand", "seen").alias("least")).coalesce(files), "seen")
        # A parent is hooked to the least that any of its children saw.
        hooks = own.groupBy(F.col("parent").alias("of")).agg(F.min("least").alias("hook"))
        moved = own.join(hooks, own["node"] == hooks["of"], "left").select("node", F.least("parent", "least", F.coalesce("hook", "least")).alias("parent"))
        before, state = state, with_grandparents(moved)
        discard(before, own)
        check = state.agg(F.sum(F.col("parent").cast("decimal(38,0)")), F.sum(F.col("grand").cast("decimal(38,0)"))).first()
        if check == last:
            discard(both)
            return state.select("node", F.col("parent").alias("root"))
        last = check
