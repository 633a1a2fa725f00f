"""Connected components of a graph given by its edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

ONE_TASK = 1_000_000


def _forest(batches):
    """Union-find over the edges of one task: (node, root) of every node that is not its root, the least of its tree."""
    up: dict[int, int] = {}

    def find(x):
        while (p := up.get(x, x)) != x:
            up[x] = q = up.get(p, p)
            x = q
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    roots = [find(x) for x in nodes]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], names=["node", "root"])


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, root) of every node that is not the least of its component; edges: a, b (longs).

    Each task first contracts its own edges to a forest.  Up to one_task tree edges are then united in one task; more of
    them take rounds of large-star and small-star, each a grouped minimum and a join, until nothing changes.
    """
    shape = "node long, root long"
    trees = store(edges.select("a", "b").mapInArrow(_forest, shape), "trees")
    if trees.count() <= one_task:
        return store(trees.repartition(1).mapInArrow(_forest, shape), "components").filter("node <> root")
    last = None
    while True:
        # large-star: every larger neighbour of a node goes to the least of the node and its neighbours
        both = trees.union(trees.select("root", "node")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        trees = store(both.join(least, "u").filter("v > u").select("v", "m").filter("v <> m").distinct().toDF("node", "root"), "large-star")
        # small-star: a node and its smaller neighbours go to the least of them
        least = trees.groupBy("node").agg(F.min("root").alias("m"))
        down = trees.join(least, "node")
        trees = store(down.select("root", "m").filter("root <> m").union(least.select("node", "m")).distinct().toDF("node", "root"), "small-star")
        now = tuple(trees.agg(F.count("*"), F.sum(F.hash("node", "root").cast("long")), F.count_distinct("node")).first())
        if now == last:
            return trees
        last = now
