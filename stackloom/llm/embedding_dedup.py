"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale and the exact norm of their rounding error. For x = a + e and y = b + f
with quantised parts a and b, |x.y - a.b| <= |e||b| + |a||f| + |e||f|, so a tile product of codes tells which pairs may
reach the threshold, and only those are computed again in double precision. Products of codes are exact at every width:
float32 holds the sums of 1,024 dimensions, and those are added in double precision. Different vectors alone enter
the tiles, each with its number of copies. Groups of tiles meet pairwise, every task holding two groups of bounded bytes; a
tile returns counts per vector and links that connect its components, never all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import materialise, ready
from stackloom.llm.components import components

THRESHOLD = 0.95
#: Bytes of the vectors of a group (a task holds two groups), vectors of a tile, dimensions whose products of codes sum
#: up exactly in float32 (127 * 127 * 1,024 < 2 ** 24).
GROUP, TILE, EXACT = 16 << 20, 1_024, 1_024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes as int8, scales, norms of the quantised parts, bounds of the rounding errors' norms) of rows."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    part = codes * scale[:, None]
    # A little more than computed, for the rounding of these computations themselves.
    slack = 1e-12 + 1e-15 * x.shape[1]
    return codes, scale, np.linalg.norm(part, axis=1) + slack, np.linalg.norm(x - part, axis=1) + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of the rows of codes a with those of b."""
    out = None
    for k in range(0, a.shape[1], EXACT):
        one = a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T
        out = one if out is None else out.astype(np.float64) + one
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class Side:
    """The vectors of one group, by tile."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.copies = ids, copies
        self.x = unit(vectors)
        self.codes, self.scale, self.norm, self.error = quantise(self.x)


def linked(a: Side, b: Side, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(linked copies for each row of a, for each row of b, connecting links between ids)."""
    na, nb = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    links: list[tuple[int, int]] = []
    for i in range(0, len(a.ids), TILE):
        s = slice(i, i + TILE)
        for j in range(i if same else 0, len(b.ids), TILE):
            t = slice(j, j + TILE)
            product = products(a.codes[s], b.codes[t])
            worst_b, worst_norm, largest = b.error[t].max(), b.norm[t].max(), b.scale[t].max()
            bound = a.error[s] * (worst_norm + worst_b) + a.norm[s] * worst_b
            least = (threshold - bound - 1e-9) / (a.scale[s] * largest)
            u, v = np.nonzero(product >= np.floor(least)[:, None].astype(product.dtype))
            if not len(u):
                continue
            # Bounds of the pair itself, then double precision for what is left.
            gu, gv = u + i, v + j
            near = a.scale[gu] * b.scale[gv] * product[u, v].astype(np.float64) + a.error[gu] * (b.norm[gv] + b.error[gv]) + a.norm[gu] * b.error[gv] >= threshold - 1e-9
            if same and i == j:
                near &= gu < gv
            gu, gv = gu[near], gv[near]
            hit = np.concatenate([np.einsum("ij,ij->i", a.x[gu[k : k + 512]], b.x[gv[k : k + 512]]) for k in range(0, len(gu), 512)] or [np.zeros(0)]) >= threshold
            gu, gv = gu[hit], gv[hit]
            if not len(gu):
                continue
            na += np.bincount(gu, b.copies[gv], len(na)).astype(np.int64)
            nb += np.bincount(gv, a.copies[gu], len(nb)).astype(np.int64)
            links += _spanning(a.ids[gu], b.ids[gv])
    return na, nb, links


def _spanning(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Fewer links with the same components: labels spread to the smallest until nothing changes."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(n), int(nodes[k])) for n, k in zip(nodes, label) if int(n) != int(nodes[k])]


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, group: int = GROUP) -> DataFrame:
    """Per row of embeddings (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows link if the cosine of their vectors is at least the threshold, in double precision; equal vectors always do.
    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing, nor do vectors of
    different lengths with each other; such a row is its own component. Rows that repeat a vec_id count as rows of their
    own; a null vec_id names no component. Further columns are ignored.
    """
    spark = ready(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(whole, F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("h", F.xxhash64("v"))
    kinds = rows.where("v is not null").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    # One number for each different vector; equal hashes of different vectors are told apart by the rank.
    kinds = materialise(kinds.withColumn("key", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    sizes = {r[0]: r[1] for r in kinds.groupBy("dim").agg(F.count("*")).collect()}

    def pairs(n: int) -> DataFrame:
        # At least six groups where there is enough work to share, so that about twenty pairs of them can run at once.
        parts = max(1, -(-n * dim * 8 // group), min(6, n // 4_096))
        home = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
        mine = kinds.where(F.col("dim") == dim).withColumn("g", home)
        met = mine.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = met.select(F.least("g", "o").alias("i"), F.greatest("g", "o").alias("j"), (F.col("g") <= F.col("o")).alias("left"), (F.col("g") == F.col("o")).alias("same"), "key", "copies", "v")

        def compare(table: pa.Table) -> pa.Table:
            left, same = table["left"].to_numpy(), table["same"].to_numpy()
            v = np.array(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(left), dim)
            key, copies = table["key"].to_numpy(), table["copies"].to_numpy()
            side = lambda m: Side(key[m], copies[m], v[m])
            if same.any():
                a = side(same)
                na, nb, links = linked(a, a, True, threshold)
                ids, counts = a.ids, na + nb
            else:
                a, b = side(left), side(~left)
                na, nb, links = linked(a, b, False, threshold)
                ids, counts = np.concatenate([a.ids, b.ids]), np.concatenate([na, nb])
            some = counts > 0
            u = np.concatenate([ids[some], np.array([x for x, _ in links], np.int64)])
            w = np.concatenate([ids[some], np.array([y for _, y in links], np.int64)])
            n = np.concatenate([counts[some], np.zeros(len(links), np.int64)])
            return pa.table({"u": u, "w": w, "n": n})

        return met.groupBy("i", "j").applyInArrow(compare, "u long, w long, n long")

    found = None
    for dim, n in sorted(sizes.items()):
        one = materialise(pairs(n), "pairs")
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "u long, w long, n long")
    counts = found.groupBy(F.col("u").alias("key")).agg(F.sum("n").alias("others"))
    comp = materialise(components(found.where("u <> w").select("u", F.col("w").alias("v"))), "components")
    low = comp.join(kinds, comp["node"] == kinds["key"]).groupBy("component").agg(F.min("low").alias("first"))
    named = comp.join(low, "component").select(F.col("node").alias("key"), "first")
    told = kinds.join(counts, "key", "left").join(named, "key", "left")
    told = materialise(told.select("v", F.xxhash64("v").alias("h"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "low").alias("component_id")), "told")
    # Rows meet by the hash of their vector; the vectors themselves are compared, but not sorted by.
    r, t = rows.alias("r"), told.alias("t")
    out = r.join(t, F.expr("r.h = t.h and r.v is not null and not (r.v <> t.v)"), "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
