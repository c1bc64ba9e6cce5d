"""Questions asked of a tree or of stacks: hotspots, balance between processes, hot stacks, functions and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.callstack import function_key, percentage, source_location
from stackloom.model import ROOT
from stackloom.operators.tree import Tree

#: Processes whose samples balance lists in one array.
VECTOR = 1 << 20
#: A tree counts as balanced below this imbalance factor.
BALANCED = 0.1

# Names that belong to the run time or the profiler, not to the program (fixed values). A profiler's own prefixes are
# added by the caller.
RUNTIME_NAMES = ("_start", "__libc_start_main", "main", "PAPI_", "papi_", "_papi_")


def _hotspots(tree: Tree) -> DataFrame:
    total = tree.stacks.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all_samples"))
    # One row of totals joins every node: a broadcast of a single number.
    n = tree.nodes.where(F.col("function_name") != ROOT).crossJoin(F.broadcast(total)).where("all_samples > 0")
    return n.select(
        "path", "function_name", "library_name", source_location(F.col("filename"), F.col("line_number")).alias("source_location"), "total_samples", percentage(F.col("total_samples"), F.col("all_samples")).alias("percentage"),
        "self_samples", percentage(F.col("self_samples"), F.col("all_samples")).alias("self_percentage"),
    )


def find_hotspots(tree: Tree, top_n: int = 10) -> DataFrame:
    """The nodes with most samples of their own, none without; ties by path. Fewer than top_n rows may come."""
    return _hotspots(tree).where("self_samples > 0").orderBy(F.desc("self_samples"), "path").limit(top_n)


find_self_hotspots = find_hotspots


def find_total_hotspots(tree: Tree, top_n: int = 10) -> DataFrame:
    """The nodes with most samples in all, nodes without samples included; ties by path."""
    return _hotspots(tree).orderBy(F.desc("total_samples"), "path").limit(top_n)


def balance(tree: Tree) -> DataFrame:
    """One row: mean, population deviation, extremes and their processes (the lowest of ties), samples by process.

    Processes without samples count by arithmetic, so that one with an id of 2^32 - 1 costs nothing; process_samples
    lists samples from process 0 on where there are at most VECTOR processes, else it is null (``tree.processes`` has them).
    """
    have = tree.sampled
    n = F.greatest(F.coalesce(F.max("process_id") + 1, F.lit(0)), F.lit(tree.least_processes)).cast("long")
    most = F.max_by("process_id", F.struct(F.col("samples"), -F.col("process_id")))
    least = F.min_by("process_id", F.struct("samples", "process_id"))
    row = have.agg(n.alias("n"), F.count("*").alias("k"), F.coalesce(F.sum("samples"), F.lit(0)).alias("total"), F.min("samples").alias("low"), F.max("samples").alias("high"), most.alias("most"), least.alias("least"), F.when(n <= VECTOR, n).alias("size"))
    few = have.crossJoin(F.broadcast(row.select("size", "n", "total"))).agg(F.sum(F.pow(F.col("samples") - F.col("total") / F.col("n"), F.lit(2.0))).alias("squares"), F.collect_list(F.when(F.col("size").isNotNull(), F.struct("process_id", F.col("samples").cast("double").alias("samples")))).alias("listed"))
    # The lowest process without samples follows one that has some, or is 0.
    follow = have.select((F.col("process_id") + 1).alias("process_id")).unionByName(have.sparkSession.range(1).select(F.lit(0).cast("long").alias("process_id")))
    gap = follow.join(have.select("process_id"), "process_id", "left_anti").agg(F.min("process_id").alias("gap"))
    row = row.crossJoin(F.broadcast(few)).crossJoin(F.broadcast(gap))  # one row each
    zeros, mean = F.col("n") - F.col("k"), F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0)
    row = row.withColumns({"mean_samples": mean, "some": zeros > 0, "by": F.map_from_entries("listed")})
    low = F.when(F.col("some"), F.lit(0)).otherwise(F.coalesce("low", F.lit(0)))
    every = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("size") - 1), lambda p: F.coalesce(F.try_element_at("by", p), F.lit(0.0)))).when(F.col("size") == 0, F.array().cast("array<double>"))
    row = row.select(
        "mean_samples", F.when(F.col("n") > 0, F.sqrt((F.coalesce("squares", F.lit(0.0)) + zeros * F.col("mean_samples") * F.col("mean_samples")) / F.col("n"))).otherwise(0.0).alias("std_dev_samples"),
        low.cast("double").alias("min_samples"), F.greatest(F.coalesce("high", F.lit(0)), F.lit(0)).cast("double").alias("max_samples"),
        F.when(F.coalesce("high", F.lit(0)) > 0, F.col("most")).otherwise(F.lit(0)).alias("most_loaded_process"),
        F.when(F.col("some"), F.when(F.coalesce("low", F.lit(0)) <= 0, F.least("gap", F.coalesce("least", "gap"))).otherwise(F.col("gap"))).otherwise(F.coalesce("least", F.lit(0))).alias("least_loaded_process"),
        every.alias("process_samples"),
    )
    return row.withColumn("imbalance_factor", F.when(F.col("mean_samples") > 0, (F.col("max_samples") - F.col("min_samples")) / F.col("mean_samples")).otherwise(0.0))


def is_balanced(result: DataFrame) -> DataFrame:
    return result.withColumn("is_balanced", F.col("imbalance_factor") < BALANCED)


def hot_stacks(stacks: DataFrame, top_n: int = 10) -> DataFrame:
    """The different stacks with most samples over all processes."""
    names = F.transform("frames", lambda x: x["function_name"])
    return stacks.groupBy(names.alias("names")).agg(F.sum("count").alias("samples")).orderBy(F.desc("samples"), "names").limit(top_n)


def top_root_children(tree: Tree, top_n: int = 10) -> DataFrame:
    return tree.nodes.where("depth = 1").orderBy(F.desc("total_samples"), "path").limit(top_n)


def _by_frame(stacks: DataFrame, key, name: str) -> DataFrame:
    total = stacks.agg(F.sum("count").alias("all_samples"))
    hot = stacks.select("count", F.explode("frames").alias("x")).groupBy(key(F.col("x")).alias(name)).agg(F.sum("count").alias("samples"))
    return hot.crossJoin(F.broadcast(total)).select(name, "samples", percentage(F.col("samples"), F.col("all_samples")).alias("percentage"))


def library_hotness(stacks: DataFrame) -> DataFrame:
    """Samples by library, counted once per frame, so that shares may add up to more than 100."""
    return _by_frame(stacks, lambda x: x["library_name"], "library_name")


def function_hotness(stacks: DataFrame) -> DataFrame:
    """Samples by function and place in the source, counted once per frame."""
    return _by_frame(stacks, lambda x: function_key(x["function_name"], x["filename"], x["line_number"]), "function_key")


def samples_by_library(tree: Tree) -> DataFrame:
    """Own samples of nodes by library."""
    return tree.nodes.where(F.col("function_name") != ROOT).groupBy("library_name").agg(F.sum("self_samples").alias("self_samples"), F.count("*").alias("node_count"))


def excluded(name: Column, names=RUNTIME_NAMES, exact: bool = False) -> Column:
    """Whether a function belongs to the run time: its name holds one of names, or is one if exact."""
    tests = [name == n if exact else name.contains(n) for n in names]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def flat_hotspots(stacks: DataFrame, frame_order: str = "root_first", names=RUNTIME_NAMES, exact: bool = False) -> DataFrame:
    """Samples by function over all contexts.

    Inclusive samples count a function once per stack that holds it, exclusive ones where it is the leaf. Empty stacks
    count in the total that shares refer to. Details of a function are those of its smallest frame.
    """
    leaf = F.element_at("frames", 1 if frame_order == "leaf_first" else -1)["function_name"]
    total = stacks.agg(F.sum("count").alias("all_samples"))
    rows = stacks.where("size(frames) > 0").withColumn("leaf", leaf)
    once = rows.select("count", "leaf", F.explode(F.aggregate("frames", F.array().cast(rows.schema["frames"].dataType), lambda acc, x: F.when(F.exists(acc, lambda y: y["function_name"] == x["function_name"]), acc).otherwise(F.concat(acc, F.array(x))))).alias("x"))
    own = F.sum(F.when(F.col("leaf") == F.col("function_name"), F.col("count")).otherwise(0))
    place = F.min(F.struct("x.library_name", "x.filename", "x.line_number"))
    by = once.withColumn("function_name", F.col("x.function_name")).where(~excluded(F.col("function_name"), names, exact)).groupBy("function_name").agg(own.alias("exclusive_samples"), F.sum("count").alias("inclusive_samples"), place.alias("at"))
    return by.crossJoin(F.broadcast(total)).select(
        "function_name", "at.library_name", "at.filename", "at.line_number", "exclusive_samples", "inclusive_samples", percentage(F.col("exclusive_samples"), F.col("all_samples")).alias("exclusive_percentage"), percentage(F.col("inclusive_samples"), F.col("all_samples")).alias("inclusive_percentage"),
    )


def group_nodes(tree: Tree, by: list[Column], aggregates: list[Column], where: Column | None = None) -> DataFrame:
    """Nodes grouped by columns and aggregated, after a filter."""
    n = tree.nodes if where is None else tree.nodes.where(where)
    return n.groupBy(*by).agg(*aggregates)
