"""A fluent builder of workflows, and ready-made ones."""

from __future__ import annotations

from typing import Any

from stackloom.plans.executor import CachingExecutor, GraphExecutor, ParallelExecutor
from stackloom.plans.graph import DataflowGraph, DataflowNode
from stackloom.plans.nodes import BalanceAnalysisNode, CustomNode, FilterNode, HotspotAnalysisNode, LoadDataNode, TransformNode, TreeTraversalNode


class WorkflowBuilder:
    """Steps that analyse a tree are wired to the load step by themselves; others by connect."""

    def __init__(self, name: str = "Workflow") -> None:
        self._graph = DataflowGraph(name)
        self._by_name: dict[str, DataflowNode] = {}
        self._load: LoadDataNode | None = None

    def _add(self, node: DataflowNode, *aliases: str, fed: bool = False) -> WorkflowBuilder:
        self._graph.add_node(node)
        for a in (node.name.lower(), *aliases):
            self._by_name[a] = node
        if fed:
            if self._load is None:
                raise ValueError("load data first")
            self._graph.connect(self._load, node, "tree")
        return self

    def load_data(self, sample_files=None, libmap_files=None, mode="context_free", count_mode="both", name: str = "LoadData", **more) -> WorkflowBuilder:
        self._load = LoadDataNode(sample_files, libmap_files, mode, count_mode, name, **more)
        return self._add(self._load, "load_data", "load")

    def find_hotspots(self, top_n: int = 10, mode: str = "self", name: str = "HotspotAnalysis") -> WorkflowBuilder:
        return self._add(HotspotAnalysisNode(top_n, mode, name), "hotspots", fed=True)

    def analyze_balance(self, name: str = "BalanceAnalysis") -> WorkflowBuilder:
        return self._add(BalanceAnalysisNode(name), "balance", fed=True)

    def filter_nodes(self, name: str = "Filter", **conditions) -> WorkflowBuilder:
        return self._add(FilterNode(name=name, **conditions), "filter", fed=True)

    def traverse(self, visitor, order: str = "preorder", stop_condition=None, name: str = "TreeTraversal") -> WorkflowBuilder:
        return self._add(TreeTraversalNode(visitor, order, stop_condition, name), "traversal", fed=True)

    def transform(self, transform, source: str | None = None, source_port: str | None = None, input_port: str = "input", output_port: str = "output", name: str = "Transform") -> WorkflowBuilder:
        """A step on one value; source and source_port name where it comes from, if given."""
        self._add(TransformNode(transform, input_port, output_port, name))
        if source:
            self._graph.connect(self._named(source), self._by_name[name.lower()], source_port=source_port or output_port, target_port=input_port)
        return self

    def custom(self, execute_fn, inputs=None, outputs=None, name: str = "Custom") -> WorkflowBuilder:
        return self._add(CustomNode(execute_fn, inputs, outputs, name))

    def add_node(self, node: DataflowNode) -> WorkflowBuilder:
        return self._add(node)

    def _named(self, name: str) -> DataflowNode:
        node = self.get_node(name)
        if node is None:
            raise ValueError(f"no node is called {name!r}")
        return node

    def connect(self, source: str, target: str, port: str | None = None, source_port: str | None = None, target_port: str | None = None) -> WorkflowBuilder:
        self._graph.connect(self._named(source), self._named(target), port, source_port, target_port)
        return self

    def get_node(self, name: str) -> DataflowNode | None:
        return self._by_name.get(name.lower())

    def build(self) -> DataflowGraph:
        self._graph.validate()
        return self._graph

    def execute(self, executor=None, parallel: bool = False, caching: bool = False) -> dict[str, dict[str, Any]]:
        """Outputs by node_id; caching goes before parallel unless an executor is given."""
        if executor is None:
            executor = CachingExecutor() if caching else ParallelExecutor() if parallel else GraphExecutor()
        return self.build().execute(executor)


def create_hotspot_workflow(sample_files=None, libmap_files=None, top_n: int = 10, **more) -> DataflowGraph:
    return WorkflowBuilder("HotspotWorkflow").load_data(sample_files, libmap_files, **more).find_hotspots(top_n).build()


def create_balance_workflow(sample_files=None, libmap_files=None, **more) -> DataflowGraph:
    return WorkflowBuilder("BalanceWorkflow").load_data(sample_files, libmap_files, **more).analyze_balance().build()


def create_full_analysis_workflow(sample_files=None, libmap_files=None, top_n: int = 10, **more) -> DataflowGraph:
    return WorkflowBuilder("FullAnalysis").load_data(sample_files, libmap_files, **more).find_hotspots(top_n).find_hotspots(top_n, "total", "TotalHotspots").analyze_balance().build()
