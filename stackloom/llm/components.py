"""Connected components over a distributed table of links.

Each round contracts every node into its neighbour with the smallest hash, which shrinks the nodes by a
constant factor whatever the shape of the graph (paths and stars alike). Rounds use aggregations with
map-side combining and equi-joins alone, so one node with a third of all links is no bottleneck. When the
links left fit a fixed bound, one task finishes them with union-find.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import materialise

#: Links that one task may finish: two arrays of this length are all it keeps.
FINISH = 200_000


class Forest:
    """Union-find over positions 0..n-1 where every root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _finish(batches):
    pairs = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    u = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    v = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
        forest.join(x, y)
    roots = np.fromiter((forest.find(i) for i in range(len(nodes))), np.int64, len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[roots] if len(nodes) else nodes)], names=["node", "root"])


def components(links: DataFrame, finish: int = FINISH) -> DataFrame:
    """(node, component) for every node of links (u long, v long): component is the smallest node reachable.

    Links are undirected; repeats, self-links and nulls are allowed (a null end is no link). A node without
    links is absent unless it links to itself. An empty table gives an empty result.
    """
    links = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null")
    links = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    steps, left = [], links
    while left.count() > finish:
        both = left.where("u <> v")
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        salt = F.lit(len(steps) + 1)
        key = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("n"))
        # The neighbour, or the node itself, whose hash is smallest: chains of such choices can't cycle.
        to = materialise(both.groupBy("u").agg(F.min(key("v")).alias("m")).select(F.col("u").alias("node"), F.least(F.col("m"), key("u"))["n"].alias("root")), "contract")
        steps.append(to)
        a = to.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = to.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        next_ = left.where("u <> v").join(a, "u").join(b, "v").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).where("u <> v").distinct()
        left = materialise(next_, "links")
    last = left.repartition(1).mapInArrow(_finish, "node long, root long")
    if not steps:
        return last.select("node", F.col("root").alias("component"))
    # Back through the rounds: each maps a node to the node that it went into.
    roots = last.select(F.col("node").alias("at"), F.col("root").alias("end"))
    for to in reversed(steps):
        roots = to.join(roots, to["root"] == roots["at"], "left").select(F.col("node").alias("at"), F.coalesce("end", "root").alias("end"))
        roots = materialise(roots, "roots")
    lone = links.where("u = v").select(F.col("u").alias("at")).join(roots, "at", "left_anti").select("at", F.col("at").alias("end"))
    roots = roots.unionByName(lone)
    least = roots.groupBy("end").agg(F.min("at").alias("component"))
    return roots.join(least, "end").select(F.col("at").alias("node"), "component")
