"""Nodes of call-stack analyses."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions.callstack import wildcard
from stackloom.model import ConcurrencyModel, SampleCountMode, TreeBuildMode
from stackloom.operators import analysis
from stackloom.operators.tree import Tree
from stackloom.plans.graph import DataflowNode
from stackloom.session import ready


def _mode(kind, value, default):
    """A mode by value or name; what isn't known is the default."""
    if isinstance(value, kind):
        return value
    wanted = str(value).replace("_", "").lower()
    return next((m for m in kind if wanted in (m.name.lower(), m.value.replace("_", ""))), default)


class LoadDataNode(DataflowNode):
    """Builds a tree of stacks, or of sample files and library maps; concurrency models and threads change nothing."""

    def __init__(self, sample_files=None, libmap_files=None, mode="context_free", count_mode="both", name: str = "LoadData", stacks: DataFrame | None = None, spark: SparkSession | None = None, time_per_sample: float = 1000.0, frame_order: str = "root_first", symbols: DataFrame | None = None, concurrency_model="serial", num_threads: int = 0) -> None:
        self.sample_files, self.libmap_files = list(sample_files or []), list(libmap_files or [])
        self.mode, self.count_mode = _mode(TreeBuildMode, mode, TreeBuildMode.ContextFree), _mode(SampleCountMode, count_mode, SampleCountMode.Both)
        self.stacks, self.spark, self.time_per_sample, self.frame_order, self.symbols = stacks, spark, time_per_sample, frame_order, symbols
        super().__init__(name, {}, {"tree": "Tree", "process_count": "int"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        from stackloom.api import TreeBuilder

        builder = TreeBuilder(self.mode, self.count_mode, ConcurrencyModel.Serial, spark=self.spark, frame_order=self.frame_order, symbols=self.symbols)
        if self.stacks is not None:
            builder.add_stacks(self.stacks)
        if self.libmap_files:
            builder.load_library_maps(self.libmap_files)
        if self.sample_files:
            builder.build_from_files(self.sample_files, self.time_per_sample)
        tree = builder.tree
        return {"tree": tree, "process_count": tree.process_count}


class HotspotAnalysisNode(DataflowNode):
    """Top hotspots and one row of summary; mode self or total (also: inclusive)."""

    def __init__(self, top_n: int = 10, mode: str = "self", name: str = "HotspotAnalysis") -> None:
        self.top_n, self.mode = top_n, mode
        super().__init__(name, {"tree": "Tree"}, {"hotspots": "DataFrame", "summary": "DataFrame"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        find = analysis.find_total_hotspots if self.mode in ("total", "inclusive") else analysis.find_hotspots
        found = find(inputs["tree"], self.top_n)
        order = F.struct(F.col("total_samples" if self.mode in ("total", "inclusive") else "self_samples"))
        summary = found.agg(F.count("*").alias("count"), F.max_by("function_name", order).alias("top_function"), F.coalesce(F.max_by("self_percentage", order), F.lit(0.0)).alias("top_percentage"))
        return {"hotspots": found, "summary": summary}


class BalanceAnalysisNode(DataflowNode):
    """Balance between processes, with is_balanced."""

    def __init__(self, name: str = "BalanceAnalysis") -> None:
        super().__init__(name, {"tree": "Tree"}, {"balance": "DataFrame", "summary": "DataFrame"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        found = analysis.is_balanced(analysis.balance(inputs["tree"]))
        return {"balance": found, "summary": found.select("mean_samples", "std_dev_samples", "imbalance_factor", "is_balanced")}


#: What a predicate in Python sees of a node, as attributes.
NODE_FIELDS = ("node_id", "parent_id", "depth", "function_name", "library_name", "raw_address", "offset", "filename", "line_number", "total_samples", "self_samples", "total_time_us", "call_count", "child_count", "is_leaf", "is_root")


def node_test(predicate: Callable[[Any], Any]) -> Column:
    """A predicate of one node (its NODE_FIELDS) as a Column, called for the nodes of an Arrow batch at a time."""

    @F.pandas_udf("boolean")
    def test(nodes: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(predicate(n)) for n in nodes.itertuples(index=False, name="Node")], dtype=bool)

    return test(F.struct(*NODE_FIELDS))


class FilterNode(DataflowNode):
    """Nodes that meet all conditions; bounds are inclusive, predicate is a Column, or a function of a node that is asked last."""

    def __init__(self, min_samples: int | None = None, max_samples: int | None = None, min_self_samples: int | None = None, function_pattern: str | None = None, library_name: str | None = None, predicate: Column | Callable[[Any], Any] | None = None, name: str = "Filter", strict: bool = True) -> None:
        self.min_samples, self.max_samples, self.min_self_samples = min_samples, max_samples, min_self_samples
        self.function_pattern, self.library_name, self.predicate, self.strict = function_pattern, library_name, predicate, strict
        if predicate is not None and not isinstance(predicate, Column) and not callable(predicate):
            raise TypeError("predicate is a Column or a function of a node")
        super().__init__(name, {"tree": "Tree"}, {"nodes": "DataFrame", "count": "DataFrame"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        out = inputs["tree"].nodes
        tests = [
            self.min_samples is not None and F.col("total_samples") >= self.min_samples,
            self.max_samples is not None and F.col("total_samples") <= self.max_samples,
            self.min_self_samples is not None and F.col("self_samples") >= self.min_self_samples,
            self.function_pattern is not None and wildcard(F.col("function_name"), self.function_pattern, self.strict),
            self.library_name is not None and F.col("library_name") == self.library_name,
        ]
        for t in tests:
            if isinstance(t, Column):
                out = out.where(t)
        if self.predicate is not None:
            ready(out.sparkSession)
            out = out.where(self.predicate if isinstance(self.predicate, Column) else node_test(self.predicate))
        return {"nodes": out, "count": out.agg(F.count("*").alias("count"))}


class TreeTraversalNode(DataflowNode):
    """visitor(row) for nodes in order, results that are not None kept; stop is a Column or a test of a row.

    The node that stops is visited. Rows stream to the driver; a visitor can be any Python.
    """

    def __init__(self, visitor: Callable[[Any], Any], order: str = "preorder", stop_condition=None, name: str = "TreeTraversal") -> None:
        self.visitor, self.order, self.stop_condition = visitor, order, stop_condition
        super().__init__(name, {"tree": "Tree"}, {"results": "list", "visited_count": "int"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        tree: Tree = inputs["tree"]
        by_column = isinstance(self.stop_condition, Column)
        rows = tree.traverse(self.order, self.stop_condition if by_column else None).orderBy("visit_rank")
        results, visited = [], 0
        for row in rows.toLocalIterator():
            visited += 1
            found = self.visitor(row)
            if found is not None:
                results.append(found)
            if self.stop_condition is not None and not by_column and self.stop_condition(row):
                break
        return {"results": results, "visited_count": visited}


class TransformNode(DataflowNode):
    """transform(value of the input port) -> value of the output port."""

    def __init__(self, transform: Callable[[Any], Any], input_port: str = "input", output_port: str = "output", name: str = "Transform") -> None:
        self.transform, self.input_port, self.output_port = transform, input_port, output_port
        super().__init__(name, {input_port: "Any"}, {output_port: "Any"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        return {self.output_port: self.transform(inputs[self.input_port])}


class MergeNode(DataflowNode):
    """Several inputs into one: a dict of them, or what merge_function makes of that dict."""

    def __init__(self, input_ports: list[str], merge_function: Callable[[dict[str, Any]], Any] | None = None, name: str = "Merge") -> None:
        self.input_ports, self.merge_function = list(input_ports), merge_function
        super().__init__(name, dict.fromkeys(input_ports, "Any"), {"merged": "Any", "keys": "list"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        some = {p: inputs[p] for p in self.input_ports}
        return {"merged": self.merge_function(some) if self.merge_function else some, "keys": list(some)}


def union_all(frames: dict[str, DataFrame]) -> DataFrame:
    """A merge function: rows of all inputs, with the port in column source."""
    out = None
    for port, df in frames.items():
        some = df.withColumn("source", F.lit(port))
        out = some if out is None else out.unionByName(some, allowMissingColumns=True)
    return out


class CustomNode(DataflowNode):
    """execute_fn(inputs) -> outputs, over any ports."""

    def __init__(self, execute_fn: Callable[[dict[str, Any]], dict[str, Any]], inputs: dict[str, str] | None = None, outputs: dict[str, str] | None = None, name: str = "Custom") -> None:
        self.execute_fn = execute_fn
        super().__init__(name, inputs, outputs)

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        return self.execute_fn(inputs)


class AggregateNode(DataflowNode):
    """Nodes grouped and aggregated by Columns; or by aggregate_fn(pandas frame) -> pandas frame with a schema."""

    def __init__(self, aggregates: list[Column] | None = None, group_by: list[Column] | None = None, filter_by: Column | None = None, aggregate_fn=None, schema: str | None = None, name: str = "Aggregate") -> None:
        self.aggregates, self.group_by, self.filter_by, self.aggregate_fn, self.schema = aggregates, group_by, filter_by, aggregate_fn, schema
        super().__init__(name, {"tree": "Tree"}, {"aggregated": "DataFrame", "groups": "DataFrame"})

    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        nodes = inputs["tree"].nodes
        if self.filter_by is not None:
            nodes = nodes.where(self.filter_by)
        grouped = nodes.groupBy(*(self.group_by or [F.col("function_name")]))
        if self.aggregate_fn:
            flat = nodes.drop("path", "lineage", "first")
            out = flat.groupBy(*(self.group_by or [F.col("function_name")])).applyInPandas(self.aggregate_fn, self.schema)
        else:
            out = grouped.agg(*(self.aggregates or [F.sum("self_samples").alias("self_samples")]))
        return {"aggregated": out, "groups": grouped.count()}
