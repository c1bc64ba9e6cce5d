"""Hard negatives by a vector-approximation file.

Components become integers, and every dimension is cut into cells at the quantiles of a normal curve with its mean and
deviation, the outer cells ending at its least and largest value. A row's approximation is one byte of cell number a
dimension. Tables give the edges of each cell, so looking up a row's cells bounds its score with an anchor from below and
above: each component of the anchor meets the edge that makes the product smallest or largest. Rows whose bounds
can't enter a window, or can't reach the best ones known in it, are never scored; the rest are, in integers.

Anchors are compared with all rows in blocks: groups of anchors and groups of rows of bounded bytes meet pairwise, first
for the positives, then for the negatives in the windows that the positives' scores open. A task returns the best few of
each anchor, which Spark ranks.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.common import materialise, ready, table, utf8
from stackloom.llm.repeats import ddl

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: Cells a dimension (a byte holds their numbers); bytes of a group's integers; anchors and rows of a tile.
CELLS, GROUP, ANCHORS, ROWS = 64, 64 << 20, 256, 4_096
#: Components must stay below this, so that scores stay within longs.
LARGEST = 1 << 24


class Cells:
    """Edges of the cells of every dimension, from its least and largest integer, mean and deviation."""

    def __init__(self, low: np.ndarray, high: np.ndarray, mean: np.ndarray, deviation: np.ndarray, cells: int = CELLS) -> None:
        cuts = np.array([NormalDist().inv_cdf(k / cells) for k in range(1, cells)])
        inner = np.clip(np.rint(mean[:, None] + deviation[:, None] * cuts), low[:, None], high[:, None] + 1)
        starts = np.concatenate([low[:, None], inner], axis=1).astype(np.int64)
        ends = np.concatenate([inner, high[:, None] + 1], axis=1).astype(np.int64) - 1
        self.low, self.high, self.cuts = starts, np.maximum(starts, ends), inner

    def approximate(self, x: np.ndarray) -> np.ndarray:
        """Cell numbers of rows of integers, a byte each."""
        return np.stack([np.searchsorted(self.cuts[j], x[:, j], side="right") for j in range(x.shape[1])], axis=1).astype(np.uint8) if x.size else np.zeros(x.shape, np.uint8)


class Anchors:
    """A group of anchors, ready to bound scores of rows by the edges of their cells."""

    def __init__(self, x: np.ndarray, cells: Cells) -> None:
        self.x, self.cells = x, cells
        largest = np.abs(x).astype(np.float64) @ np.maximum(np.abs(cells.low).max(axis=1), np.abs(cells.high).max(axis=1)) if len(x) else np.zeros(1)
        # Integers that a type holds exactly; the sums stay exact then.
        self.exact = largest.max(initial=0) < 1 << 53
        self.kind = np.float32 if largest.max(initial=0) < 1 << 24 else np.float64
        self.slack = 0.0 if self.exact else float(largest.max()) * 1e-12

    def bounds(self, some: slice, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, largest) score of each anchor of a slice with each row of codes."""
        at = np.arange(codes.shape[1])
        low, high = self.cells.low[at, codes].astype(self.kind).T, self.cells.high[at, codes].astype(self.kind).T
        q = self.x[some].astype(self.kind)
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ low + down @ high - self.slack, up @ high + down @ low + self.slack


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b, pair by pair."""
    return np.concatenate([np.einsum("ij,ij->i", a[k : k + 4_096].astype(np.int64), b[k : k + 4_096].astype(np.int64)) for k in range(0, len(a), 4_096)] or [np.zeros(0, np.int64)])


class Best:
    """The best few rows of every anchor so far: higher scores first, then smaller ids, then keys."""

    def __init__(self, anchors: int, keep: int) -> None:
        self.keep, self.least = keep, np.full(anchors, -np.inf)
        self.held = [np.zeros(0, np.int64)] * 4  # anchor, score, id, key

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        if not len(anchor):
            return
        a, s, i, k = (np.concatenate(x) for x in zip(self.held, (anchor, score, ids, keys)))
        order = np.lexsort((k, i, -s, a))
        a, s, i, k = (x[order] for x in (a, s, i, k))
        first = np.searchsorted(a, a)
        place = np.arange(len(a)) - first
        some = place < self.keep
        self.held = [x[some] for x in (a, s, i, k)]
        full = place == self.keep - 1
        self.least[a[full]] = s[full]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -np.inf)


def nearest(anchors: Anchors, a_label: np.ndarray, a_key: np.ndarray, rows: np.ndarray, codes: np.ndarray, label: np.ndarray, ids: np.ndarray, key: np.ndarray, keep: int) -> Best:
    """Best other rows of each anchor's label."""
    best = Best(len(a_key), keep)
    for i in range(0, len(a_key), ANCHORS):
        s = slice(i, i + ANCHORS)
        for j in range(0, len(key), ROWS):
            t = slice(j, j + ROWS)
            low, high = anchors.bounds(s, codes[t])
            fit = (a_label[s, None] == label[None, t]) & (a_key[s, None] != key[None, t])
            least = np.maximum(best.least[s], _kth(np.where(fit, low, -np.inf), keep))
            u, v = np.nonzero(fit & (high >= least[:, None]))
            u, v = u + i, v + j
            best.add(u, scores(anchors.x[u], rows[v]), ids[v], key[v])
    return best


def within(anchors: Anchors, a_label: np.ndarray, windows: np.ndarray, rows: np.ndarray, codes: np.ndarray, label: np.ndarray, ids: np.ndarray, key: np.ndarray, keep: int) -> list[Best]:
    """Best rows of other labels whose scores lie in each window of each anchor; windows is anchors x windows x 2."""
    best = [Best(len(a_label), keep) for _ in range(windows.shape[1])]
    for i in range(0, len(a_label), ANCHORS):
        s = slice(i, i + ANCHORS)
        for j in range(0, len(key), ROWS):
            t = slice(j, j + ROWS)
            low, high = anchors.bounds(s, codes[t])
            fit = a_label[s, None] != label[None, t]
            some = np.zeros(fit.shape, bool)
            for p, found in enumerate(best):
                first, last = windows[s, p, 0, None], windows[s, p, 1, None]
                # Rows that are surely in the window; others must reach the last of the best of these.
                sure = _kth(np.where(fit & (low >= first) & (high <= last), low, -np.inf), keep)
                least = np.maximum(np.maximum(found.least[s], sure)[:, None], first)
                some |= fit & (high >= least) & (low <= last)
            u, v = np.nonzero(some)
            u, v = u + i, v + j
            score = scores(anchors.x[u], rows[v])
            for p, found in enumerate(best):
                m = (score >= windows[u, p, 0]) & (score <= windows[u, p, 1]) & (score >= found.least[u])
                found.add(u[m], score[m], ids[v[m]], key[v[m]])
    return best


_INTEGERS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("v", pa.binary())])
_STATS = pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("total", pa.float64()), ("squares", pa.float64())])


def _vectors(column, dim: int, kind: str = "<i4") -> np.ndarray:
    """Rows of a binary column of integers as one array."""
    data, _ = utf8(column)
    return data.view(kind).reshape(len(column), dim)


def _integers(batches):
    for b in batches:
        flat, sizes = b.column(2), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
        x = np.floor(SCALE * flat.flatten().to_numpy(zero_copy_only=False))
        if len(x) and np.abs(x).max() >= LARGEST:
            raise ValueError(f"components of {LARGEST // SCALE} and more leave the range of scores")
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        x = x.astype("<i4")
        yield table({"vec_id": b.column(0), "label": b.column(1), "dim": sizes.astype(np.int32), "v": [x[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])]}, _INTEGERS)


def _stats(batches):
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        dims = b.column(0).to_numpy()
        for dim in np.unique(dims).tolist():
            x = _vectors(b.column(1).filter(pa.array(dims == dim)), dim).astype(np.float64)
            now = [np.full(dim, len(x)), x.min(axis=0), x.max(axis=0), x.sum(axis=0), (x * x).sum(axis=0)]
            old = held.get(dim)
            held[dim] = now if old is None else [f(a, c) for f, a, c in zip((np.add, np.minimum, np.maximum, np.add, np.add), old, now)]
    for dim, (n, low, high, total, squares) in held.items():
        yield table({"dim": np.full(dim, dim, np.int32), "at": np.arange(dim, dtype=np.int32), "n": n.astype(np.int64), "low": low.astype(np.int64), "high": high.astype(np.int64), "total": total, "squares": squares}, _STATS)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = GROUP) -> DataFrame:
    """Hard negatives of the rows of embeddings (vec_id, label, embedding) that anchor tells.

    Components become floor(256 * x); a score is the integer inner product with the anchor; higher scores come first, then
    smaller vec_ids. For an anchor and each of its first `positives` other rows of the same label, the first `negatives` rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score: anchor_id, positive_id,
    positive_rank, rank, negative_id, positive_score, negative_score. Pairs without such a row give none.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part; components of 65,536 and more
    are an error. Vectors of different lengths don't meet; empty ones score 0 with each other. Rows that repeat a vec_id are
    rows of their own, equal in rank to each other. Further columns are ignored.
    """
    spark = ready(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(~bad)
    wide = pa.schema([*_INTEGERS, ("anchor", pa.bool_())])

    def integers(batches):
        for b in batches:
            for part in _integers([b]):
                yield pa.RecordBatch.from_arrays([*part.columns, b.column(3)], schema=wide)

    ints = materialise(rows.mapInArrow(integers, ddl(wide)).withColumn("key", F.monotonically_increasing_id()), "integers")
    stats = ints.select("dim", "v").mapInArrow(_stats, ddl(_STATS)).groupBy("dim", "at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    sizes = {r["dim"]: r for r in ints.groupBy("dim").agg(F.count("*").alias("rows"), F.count_if("anchor").alias("anchors")).collect()}
    out = None
    for dim, n in sorted(sizes.items()):
        if n["anchors"]:
            # One row a dimension of the vectors, whatever their number.
            found = [np.array(x, np.float64) for x in zip(*[(r["low"], r["high"], r["total"] / r["n"], max(0.0, r["squares"] / r["n"] - (r["total"] / r["n"]) ** 2) ** 0.5) for r in stats.where(F.col("dim") == dim).orderBy("at").collect()])]
            cells = Cells(*found) if dim else Cells(*[np.zeros(0)] * 4)
            one = _one_width(ints.where(F.col("dim") == dim), dim, cells, n, positives, negatives, low, high, group)
            out = one if out is None else out.unionByName(one)
    if out is None:
        out = spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    return out


def _one_width(ints: DataFrame, dim: int, cells: Cells, n, positives: int, negatives: int, low: int, high: int, group: int) -> DataFrame:
    of_bytes = lambda rows: -(-rows * max(dim, 1) * 2 // group)
    # At least a few groups where there is enough work to share.
    a_parts, r_parts = max(1, of_bytes(n["anchors"])), max(1, of_bytes(n["rows"]), min(24, n["rows"] // 2_048))

    kind = "<i2" if max(np.abs(cells.low).max(initial=0), np.abs(cells.high).max(initial=0)) < 1 << 15 else "<i4"

    def approximate(batches):
        for b in batches:
            x = _vectors(b.column(4), dim)
            columns = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x.astype(kind), cells.approximate(x))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *columns], names=["key", "vec_id", "label", "anchor", "v", "codes"])

    rows = ints.select("key", "vec_id", "label", "anchor", "v").mapInArrow(approximate, "key long, vec_id long, label long, anchor boolean, v binary, codes binary")
    rows = materialise(rows.withColumn("r", F.pmod(F.xxhash64("key"), F.lit(r_parts)).cast("int")), "approximations")
    # Columns of their own, so that both sides may meet although they come from one table.
    anchors = rows.where("anchor").select(*(F.col(c).alias(c) for c in ("key", "vec_id", "label", "v"))).withColumn("a", F.pmod(F.xxhash64("key"), F.lit(a_parts)).cast("int"))

    def dealt(anchors: DataFrame, compare, schema: str) -> DataFrame:
        left = anchors.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(r_parts - 1))))
        right = rows.drop("anchor").withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a_parts - 1))))
        return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(compare, schema)

    def sides(left: pa.Table, right: pa.Table):
        mine = Anchors(_vectors(left["v"], dim, kind), cells), left["label"].to_numpy()
        return mine, (_vectors(right["v"], dim, kind), _vectors(right["codes"], dim, "u1"), *(right[c].to_numpy() for c in ("label", "vec_id", "key")))

    def alike(left: pa.Table, right: pa.Table) -> pa.Table:
        (mine, label), others = sides(left, right)
        key = left["key"].to_numpy()
        a, score, ids, other = nearest(mine, label, key, *others, positives).held
        return pa.table({"key": key[a], "score": score, "vec_id": ids, "other": other})

    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id", "other")
    told = dealt(anchors, alike, "key long, score long, vec_id long, other long").withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    told = materialise(told.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "vec_id"))).alias("found")), "positives")
    opened = anchors.join(told.select("key", F.col("found.score").alias("scores")), "key")

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        (mine, label), others = sides(left, right)
        key, windows = left["key"].to_numpy(), np.zeros((left.num_rows, positives, 2), np.int64)
        windows[:, :, 0] = 1  # none: from 1 to 0
        for i, found in enumerate(left["scores"].to_pylist()):
            for p, s in enumerate(found):
                windows[i, p] = -(-low * s // 100), high * s // 100
        parts = [(np.full(len(b.held[0]), p + 1, np.int32), *b.held) for p, b in enumerate(within(mine, label, windows, *others, negatives))]
        p, a, score, ids, other = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"key": key[a], "place": p, "score": score, "vec_id": ids, "other": other})

    first = Window.partitionBy("key", "place").orderBy(F.desc("score"), "vec_id", "other")
    found = dealt(opened, unlike, "key long, place int, score long, vec_id long, other long").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    given = told.select("key", F.explode("found").alias("p")).select("key", F.col("p.place").alias("place"), F.col("p.vec_id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    found = found.join(given, ["key", "place"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.select("anchor_id", "positive_id", F.col("place").alias("positive_rank"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 50 == 0).drop("positive_rank")


SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v
    from embeddings where label is not null and embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) as bigint) score
    from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id negative_id, s.score negative_score, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as int) "rank"
    from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, "rank", negative_id, positive_score, negative_score from n where "rank" <= 3
"""
