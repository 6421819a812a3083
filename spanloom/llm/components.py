"""Connected components by repeated contraction, in DataFrame operations only.

Each round hooks every node to its least neighbour, follows the hooks to their roots
by pointer jumping, and keeps the edges between different roots. A round at least
halves the nodes that still have edges. What leaves a step is a table in
the shared folder, deleted at the end; nothing but row counts reaches the driver. Joins are merge joins by hint:
a broadcast would gather a side of each of the many steps in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Tables, cut


def _jump(nodes: DataFrame, hooks: DataFrame) -> DataFrame:
    """``nodes`` (node, root) with each root's own root, and whether it has one."""
    up = hooks.select(F.col("node").alias("via"), F.col("root").alias("far"))
    out = nodes.join(up.hint("merge"), F.col("root") == F.col("via"), "left")
    return out.select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) with the least node that it reaches. Self-loops and repeats are harmless; edges with a null end are left out."""
    with Tables(edges.sparkSession) as tables:
        return _components(edges, tables)


def _components(edges: DataFrame, tables: Tables) -> DataFrame:
    live = tables.step(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        # a node's hook is its least neighbour, if that is smaller: hooks form trees whose roots have no smaller neighbour
        hook = tables.step(live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        while True:  # two jumps a step; the second tells whether there may be more
            once = _jump(hook, hook).select("node", "root")
            twice = tables.step(_jump(once, hook))
            hook = twice.select("node", "root")
            if twice.filter("moved").isEmpty():
                break
        maps.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = live.join(left.hint("merge"), "a", "left").join(right.hint("merge"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        live = tables.step(live.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not maps:
        return cut(live.select(F.col("a").alias("node"), F.col("b").alias("root")))
    # later rounds move the roots of earlier ones
    found = maps[-1]
    for m in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("final"))
        found = m.join(later.hint("merge"), "root", "left").select("node", F.coalesce("final", "root").alias("root")).unionByName(found)
    roots = found.select(F.col("root").alias("node")).distinct()
    return cut(found.unionByName(roots.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
