"""The calling-context tree as DataFrames.

A tree is three tables: nodes, samples of nodes by process, and edges. It is built from weighted stacks in two
aggregations. Identical stacks of a process are added first. Every remaining stack then becomes one row per frame
that carries a rolling identity of its prefix instead of the prefix itself, so a stack of depth d costs d short rows;
partial aggregation adds them before the shuffle. Paths and frame details come back by one equi-join with a
representative stack of each node. Nothing of a tree is held by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.callstack import wildcard
from stackloom.model import ROOT, TIME_PER_SAMPLE, VIRTUAL, SampleCountMode, TreeBuildMode
from stackloom.operators.numbering import numbered
from stackloom.session import written

#: Identity of the root; every other identity follows from its parent's and its own key.
ROOT_ID = "root"
#: Bits of the pre-order that number nodes within a stretch, for the level order.
STRETCH = 14
FRAME_COLUMNS = ("raw_address", "offset", "library_name", "function_name", "filename", "line_number")


def frame_key(x: Column, mode: TreeBuildMode) -> Column:
    """What tells a frame from its siblings."""
    names = ["function_name", "library_name"] + (["offset"] if mode is TreeBuildMode.ContextAware else [])
    return F.struct(*[x[n].alias(n) for n in names])


def _identities(keys: Column) -> Column:
    """Identity of every prefix of an array of keys, the empty one first."""
    return F.aggregate(keys, F.array(F.lit(ROOT_ID)), lambda ids, k: F.concat(ids, F.array(F.md5(F.concat(F.element_at(ids, -1), F.to_json(k))))))


def weighted(stacks: DataFrame, time_per_sample: float = TIME_PER_SAMPLE) -> DataFrame:
    """stacks with entry_ord and time_us filled in where they are missing, without empty stacks and null counts."""
    out = stacks
    if "entry_ord" not in out.columns:
        out = out.withColumn("entry_ord", F.lit(0).cast("long"))
    time = F.col("count") * F.lit(float(time_per_sample))
    out = out.withColumn("time_us", F.coalesce(F.col("time_us"), time) if "time_us" in out.columns else time)
    return out.where("size(frames) > 0 and count is not null and process_id is not null").select("process_id", "entry_ord", "frames", "count", "time_us")


@dataclass(frozen=True)
class Tree:
    """A calling-context tree.

    stacks: one row per process and different stack: process_id, entry_ord, frames, keys, ids, leaf, count, time_us.
    """

    stacks: DataFrame
    build_mode: TreeBuildMode = TreeBuildMode.ContextFree
    count_mode: SampleCountMode = SampleCountMode.Exclusive
    least_processes: int = 0
    kept: bool = False

    @cached_property
    def stored(self) -> Tree:
        """This tree over stacks that are written once, for whatever derives several tables or answers from it."""
        return self if self.kept else replace(self, stacks=written(self.stacks, "stacks"), kept=True)

    @cached_property
    def _stored_shape(self) -> DataFrame:
        return written(self.stored._shape, "shape")

    @cached_property
    def visits(self) -> DataFrame:
        """(node_id, process_id, visits, ends, visit_time, end_time) of every node but the root."""
        s = self.stacks
        rows = s.select("process_id", "count", "time_us", F.posexplode(F.slice("ids", 2, F.size("keys"))).alias("pos", "node_id"), F.size("keys").alias("n"))
        last = F.col("pos") == F.col("n") - 1
        part = lambda c: F.sum(F.when(last, F.col(c)))
        zero = lambda x, kind: F.coalesce(x, F.lit(0)).cast(kind)
        return rows.groupBy("node_id", "process_id").agg(F.sum("count").alias("visits"), zero(part("count"), "long").alias("ends"), F.sum("time_us").alias("visit_time"), zero(part("time_us"), "double").alias("end_time"))

    def _counted(self, prefix: str) -> Column:
        return F.col("ends" if self.count_mode is SampleCountMode.Exclusive else "visits") if prefix == "samples" else F.col("end_time" if self.count_mode is SampleCountMode.Exclusive else "visit_time")

    @cached_property
    def node_process(self) -> DataFrame:
        """(node_id, process_id, samples, time_us), the root included; nodes a process never counts are absent."""
        rows = self.visits.select("node_id", "process_id", self._counted("samples").alias("samples"), self._counted("time").alias("time_us"))
        root = self.stacks.groupBy("process_id").agg(F.sum("count").alias("samples"), F.sum("time_us").alias("time_us")).select(F.lit(ROOT_ID).alias("node_id"), "process_id", "samples", "time_us")
        return root.unionByName(rows.where("samples > 0"))

    @cached_property
    def _shape(self) -> DataFrame:
        """One row per node but the root: identity, place, frame, order of first appearance, and counts in all.

        One aggregation adds the counts and finds the first stack through each node; one join with that stack brings
        path and frame, so neither travels with the exploded rows.
        """
        s = self.stacks
        rows = s.select("process_id", "entry_ord", "leaf", "count", "time_us", F.posexplode(F.slice("ids", 2, F.size("keys"))).alias("pos", "node_id"), F.size("keys").alias("n"))
        last = F.col("pos") == F.col("n") - 1
        part = lambda c: F.coalesce(F.sum(F.when(last, F.col(c))), F.sum(F.lit(0)))
        first = rows.groupBy("node_id", "pos").agg(F.sum("count").alias("visits"), part("count").alias("ends"), F.sum("time_us").alias("visit_time"), part("time_us").cast("double").alias("end_time"), F.min(F.struct("process_id", "entry_ord", "leaf")).alias("first"))
        r = first.select("*", F.col("first.process_id").alias("p"), F.col("first.leaf").alias("l"))
        j = r.join(s.select(F.col("process_id").alias("p"), F.col("leaf").alias("l"), "keys", "ids", "frames"), ["p", "l"])
        at = F.col("pos")
        return j.select("node_id", F.col("ids")[at].alias("parent_id"), (at + 1).alias("depth"), F.slice("keys", 1, at + 1).alias("path"), F.slice("ids", 2, at + 1).alias("lineage"), F.col("frames")[at].alias("frame"), F.struct("first.process_id", "first.entry_ord").alias("first"), "visits", "ends", "visit_time", "end_time")

    @cached_property
    def nodes(self) -> DataFrame:
        """Every node, the root included, with its frame, counts and place."""
        return self._nodes(self._stored_shape if self.kept else self._shape)

    def _nodes(self, shape: DataFrame) -> DataFrame:
        self_ = F.lit(0).cast("long") if self.count_mode is SampleCountMode.Inclusive else F.col("ends")
        kids = shape.groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("child_count"))
        body = shape.select(
            "node_id", "parent_id", "depth", "path", "lineage", "first", *[F.col(f"frame.{c}").alias(c) for c in FRAME_COLUMNS],
            self._counted("samples").alias("total_samples"), self_.alias("self_samples"), self._counted("time").alias("total_time_us"), F.col("visits").alias("call_count"),
        )
        kinds = dict(body.dtypes)
        empty = lambda c: F.lit(None).cast(kinds[c]).alias(c)
        whole = self.stacks.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum("time_us"), F.lit(0.0)).alias("t"))
        root = whole.select(
            F.lit(ROOT_ID).alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.array().cast(kinds["path"]).alias("path"), F.array().cast("array<string>").alias("lineage"), empty("first"),
            F.lit(0).cast("long").alias("raw_address"), F.lit(0).cast("long").alias("offset"), F.lit(VIRTUAL).alias("library_name"), F.lit(ROOT).alias("function_name"), F.lit("").alias("filename"), F.lit(0).alias("line_number"),
            F.col("n").alias("total_samples"), F.lit(0).cast("long").alias("self_samples"), F.col("t").alias("total_time_us"), F.lit(0).cast("long").alias("call_count"),
        )
        both = body.unionByName(root).join(kids, "node_id", "left")
        return both.withColumn("child_count", F.coalesce("child_count", F.lit(0)).cast("long")).withColumn("is_leaf", F.col("child_count") == 0).withColumn("is_root", F.col("depth") == 0)

    @cached_property
    def edges(self) -> DataFrame:
        """(parent_id, child_id, call_count); calls count in every mode."""
        return self.nodes.where(~F.col("is_root")).select("parent_id", F.col("node_id").alias("child_id"), "call_count")

    @cached_property
    def ordered(self) -> DataFrame:
        """nodes with sibling_rank (order of first appearance), subtree_size and preorder (0 for the root).

        A node's place is the sum, over itself and all above it but the root, of one and the sizes of the subtrees of
        earlier siblings; so the order of a whole tree needs no sort of all nodes in one place, and siblings are numbered
        in ranges, so neither does that of one node's children. Stacks and shape are written once, when this is first asked for.
        """
        shape = self._stored_shape
        above = shape.select(F.col("node_id").alias("of"), F.explode("lineage").alias("node_id"))
        sizes = above.groupBy("node_id").agg(F.count("*").alias("size"))
        siblings = shape.select("node_id", F.col("parent_id").alias("group"), "first", F.element_at("path", -1).alias("key")).join(sizes, "node_id").withColumnRenamed("node_id", "id")
        ranks = numbered(siblings, F.col("first"), F.col("key")).select(F.col("id").alias("node_id"), F.col("size").alias("subtree_size"), F.col("rank").alias("sibling_rank"), (F.col("ahead") + 1).alias("step"))
        place = above.join(ranks.select("node_id", "step"), "node_id").groupBy(F.col("of").alias("node_id")).agg(F.sum("step").alias("preorder"))
        found = self.stored._nodes(shape).join(ranks.drop("step"), "node_id", "left").join(place, "node_id", "left")
        whole = shape.agg((F.count("*") + 1).alias("all_nodes"))
        found = found.crossJoin(F.broadcast(whole))  # one number
        return found.withColumn("preorder", F.coalesce("preorder", F.lit(0))).withColumn("subtree_size", F.coalesce("subtree_size", "all_nodes")).withColumn("sibling_rank", F.coalesce("sibling_rank", F.lit(1))).drop("all_nodes")

    # Scalars, each one small job.

    @property
    def total_samples(self) -> int:
        return self.stacks.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]

    @property
    def total_execution_time(self) -> float:
        return self.stacks.agg(F.coalesce(F.sum("time_us"), F.lit(0.0))).first()[0]

    @property
    def process_count(self) -> int:
        """Largest process + 1, and never below least_processes."""
        return max(self.least_processes, self.stacks.agg(F.coalesce(F.max("process_id") + 1, F.lit(0))).first()[0])

    @property
    def node_count(self) -> int:
        return self.stacks.select(F.explode("ids").alias("i")).distinct().where(F.col("i") != ROOT_ID).count() + 1

    @property
    def max_depth(self) -> int:
        return self.stacks.agg(F.coalesce(F.max(F.size("keys")), F.lit(0))).first()[0]

    @cached_property
    def sampled(self) -> DataFrame:
        """(process_id, samples) of the processes that have any stack."""
        return self.stacks.groupBy("process_id").agg(F.sum("count").alias("samples"))

    @cached_property
    def processes(self) -> DataFrame:
        """(process_id, samples) for every process from 0 on, those without samples included.

        As many rows as the largest id says, made in blocks; what has samples is in ``sampled``.
        """
        n = self.stacks.agg(F.greatest(F.coalesce(F.max("process_id") + 1, F.lit(0)), F.lit(self.least_processes)).cast("long").alias("n"))
        step = F.lit(1 << 16)
        blocks = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, step.cast("long"))).alias("b"))
        every = blocks.select(F.explode(F.sequence(F.col("b"), F.least(F.col("b") + step, F.col("n")) - 1)).alias("process_id"))
        return every.join(self.sampled, "process_id", "left").select("process_id", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"))

    # Filters and lookups; each is a lazy selection of nodes.

    def filter_by_samples(self, least: int) -> DataFrame:
        return self.nodes.where(F.col("total_samples") >= least)

    def filter_by_self_samples(self, least: int) -> DataFrame:
        return self.nodes.where(F.col("self_samples") >= least)

    def filter_nodes(self, predicate: Column) -> DataFrame:
        return self.nodes.where(predicate)

    def find_nodes_by_name(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("function_name") == name)

    def find_nodes_by_library(self, library: str) -> DataFrame:
        return self.nodes.where(F.col("library_name") == library)

    def find_nodes_like(self, pattern: str, strict: bool = True) -> DataFrame:
        return self.nodes.where(wildcard(F.col("function_name"), pattern, strict))

    def nodes_at_depth(self, depth: int) -> DataFrame:
        return self.nodes.where(F.col("depth") == depth)

    @property
    def leaf_nodes(self) -> DataFrame:
        return self.nodes.where("is_leaf")

    @property
    def all_nodes(self) -> DataFrame:
        """Nodes in pre-order."""
        return self.traverse("preorder")

    def children(self, parents: DataFrame) -> DataFrame:
        """Children of the nodes in parents (node_id)."""
        p = parents.select(F.col("node_id").alias("parent_id")).distinct()
        return self.nodes.join(p, "parent_id", "left_semi")

    def find_child(self, parent_id: str, function_name: str, library_name: str | None = None, offset: int | None = None) -> DataFrame:
        """The first child of a node with that name, and that library and offset where given; none or one row of nodes.

        Children come in the order of first appearance, which takes no numbers of the whole tree. The shape is written when a
        child is first asked for and serves all later questions.
        """
        want = (F.col("parent_id") == parent_id) & (F.col("function_name") == function_name)
        if library_name is not None:
            want &= F.col("library_name") == library_name
        if offset is not None:
            want &= F.col("offset") == offset
        return self.stored._nodes(self._stored_shape).where(want).orderBy("first", F.element_at("path", -1)).limit(1)

    def siblings(self, of: DataFrame) -> DataFrame:
        """(of_id, node) pairs: every other child of the same parent; the root has none."""
        n = self.nodes
        a = of.select(F.col("node_id").alias("of_id"), "parent_id").where("parent_id is not null")
        return a.join(n, "parent_id").where(F.col("of_id") != F.col("node_id"))

    def node_samples(self, node_id: str, process_id: int) -> tuple[int, float]:
        """(samples, time in microseconds) of a node in a process; zeros where there are none."""
        found = self.node_process.where((F.col("node_id") == node_id) & (F.col("process_id") == process_id)).select("samples", "time_us").first()
        return tuple(found) if found else (0, 0.0)

    def call_count(self, parent_id: str, child_id: str) -> int:
        found = self.edges.where((F.col("parent_id") == parent_id) & (F.col("child_id") == child_id)).select("call_count").first()
        return found[0] if found else 0

    @property
    def paths(self) -> DataFrame:
        """nodes with names: the function names from the root down."""
        return self.nodes.withColumn("names", F.concat(F.array(F.lit(ROOT)), F.transform("path", lambda k: k["function_name"])))

    def traverse(self, order: str = "preorder", stop: Column | None = None) -> DataFrame:
        """Nodes with visit_rank from 1 in an order; up to and including the first for which stop holds."""
        o = self.ordered
        if order == "preorder":
            out = o.withColumn("visit_rank", F.col("preorder") + 1)
        elif order == "postorder":
            out = o.withColumn("visit_rank", F.col("preorder") + F.col("subtree_size") - F.col("depth"))
        elif order == "levelorder":
            # Nodes of a level are numbered within stretches of the pre-order, which stay small; what lies ahead of a
            # stretch comes from their counts, and what lies ahead of a level from the counts of levels.
            o = o.withColumn("_stretch", F.shiftright("preorder", STRETCH))
            counts = o.groupBy("depth", "_stretch").agg(F.count("*").alias("n"))
            before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            levels = counts.groupBy("depth").agg(F.sum("n").alias("n")).select("depth", before(Window.orderBy("depth")).alias("_level"))  # a row per level
            ahead = counts.withColumn("_ahead", before(Window.partitionBy("depth").orderBy("_stretch"))).drop("n").join(F.broadcast(levels), "depth")
            rank = F.row_number().over(Window.partitionBy("depth", "_stretch").orderBy("preorder"))
            out = o.join(ahead, ["depth", "_stretch"]).withColumn("visit_rank", F.col("_level") + F.col("_ahead") + rank).drop("_level", "_ahead", "_stretch")
        else:
            raise ValueError(f"Unknown traversal order: {order}")
        if stop is not None:
            first = out.where(F.coalesce(stop, F.lit(False))).agg(F.min("visit_rank").alias("_last"))
            out = out.crossJoin(F.broadcast(first)).where("_last is null or visit_rank <= _last").drop("_last")
        return out

    def visit(self, visitor, order: str = "preorder") -> int:
        """Call visitor(row) for nodes in order until it returns False; rows stream to the driver a partition at a time."""
        n = 0
        for row in self.traverse(order).orderBy("visit_rank").toLocalIterator():
            n += 1
            if visitor(row) is False:
                break
        return n

    def merged(self, *others: Tree) -> Tree:
        """One tree with the counts of several; samples that end inside a longer stack of another tree are kept."""
        stacks = self.stacks
        for o in others:
            if o.build_mode is not self.build_mode or o.count_mode is not self.count_mode:
                raise ValueError("only trees of equal modes merge")
            stacks = stacks.unionByName(o.stacks)
        return build_tree(stacks, self.build_mode, self.count_mode, max(t.least_processes for t in (self, *others)))

    def persist(self) -> Tree:
        """Keep the added-up stacks, which every table derives from."""
        self.stacks.persist()
        return self

    def unpersist(self) -> None:
        self.stacks.unpersist()


def build_tree(stacks: DataFrame, build_mode: TreeBuildMode = TreeBuildMode.ContextFree, count_mode: SampleCountMode = SampleCountMode.Exclusive, process_count: int = 0, time_per_sample: float = TIME_PER_SAMPLE) -> Tree:
    """A tree of stacks (process_id, frames from the root down, count; entry_ord and time_us where known).

    Empty stacks count nowhere. Of equal stacks of a process the frames of the first (entry_ord) are kept.
    """
    rows = weighted(stacks, time_per_sample)
    rows = rows.withColumn("keys", F.transform("frames", lambda x: frame_key(x, build_mode)))
    added = rows.groupBy("process_id", "keys").agg(F.sum("count").alias("count"), F.sum("time_us").alias("time_us"), F.min(F.struct("entry_ord", "frames")).alias("first"))
    ids = added.withColumn("ids", _identities(F.col("keys")))
    out = ids.select("process_id", F.col("first.entry_ord").alias("entry_ord"), F.col("first.frames").alias("frames"), "keys", "ids", F.element_at("ids", -1).alias("leaf"), "count", "time_us")
    return Tree(out, build_mode, count_mode, process_count)
