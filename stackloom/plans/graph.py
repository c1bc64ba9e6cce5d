"""Dataflow graphs: analyses as nodes with named ports, edges between ports, order and validation.

Values on ports are lazy (DataFrames, trees): running a graph builds plans, and Spark jobs start where a node or the
caller asks for rows.
"""

from __future__ import annotations

import hashlib
import itertools
from abc import ABC, abstractmethod
from collections import deque
from dataclasses import dataclass
from enum import Enum
from typing import Any

_numbers = itertools.count(1)


class NodeState(Enum):
    PENDING = "pending"
    READY = "ready"
    RUNNING = "running"
    COMPLETED = "completed"
    FAILED = "failed"
    CACHED = "cached"


class DataflowNode(ABC):
    """A step with input and output ports; subclasses say what it does in execute."""

    def __init__(self, name: str, inputs: dict[str, str] | None = None, outputs: dict[str, str] | None = None) -> None:
        self._name, self._inputs, self._outputs = name, dict(inputs or {}), dict(outputs or {})
        self._node_id = f"{name}_{next(_numbers)}"
        self.reset()

    name = property(lambda self: self._name)
    node_id = property(lambda self: self._node_id)
    inputs = property(lambda self: dict(self._inputs))
    outputs = property(lambda self: dict(self._outputs))

    def reset(self) -> None:
        self.state: NodeState = NodeState.PENDING
        self.result: dict[str, Any] | None = None
        self.error: Exception | None = None

    @abstractmethod
    def execute(self, inputs: dict[str, Any]) -> dict[str, Any]:
        """Outputs by port, from inputs by port."""

    def validate_inputs(self, inputs: dict[str, Any]) -> bool:
        lacking = sorted(self._inputs.keys() - inputs.keys())
        if lacking:
            raise ValueError(f"node {self.name!r} lacks inputs: {', '.join(lacking)}")
        return True

    def config(self) -> dict[str, Any]:
        """Everything that what the node computes depends on, besides its inputs."""
        hidden = {"_node_id", "state", "result", "error"}
        return {k: v for k, v in vars(self).items() if k not in hidden}

    def get_cache_key(self, upstream: dict[str, str]) -> str:
        """A key of class, whole configuration and the keys of what feeds each port."""
        parts = [type(self).__module__, type(self).__qualname__, *(f"{k}={_told(v)}" for k, v in sorted(self.config().items())), *(f"{k}<{v}" for k, v in sorted(upstream.items()))]
        return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self._name!r} {self.state.value}>"


def _told(value: Any) -> str:
    """A text that tells values apart: plain data by content, anything else by identity."""
    if isinstance(value, (str, int, float, bool, bytes, type(None), Enum)):
        return repr(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{_told(k)}:{_told(v)}" for k, v in value.items()) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(_told, value)) + "]"
    return f"{type(value).__name__}@{id(value)}"


@dataclass(frozen=True)
class DataflowEdge:
    """From an output port to an input port."""

    source: DataflowNode
    source_port: str
    target: DataflowNode
    target_port: str

    def __post_init__(self) -> None:
        if self.source_port not in self.source.outputs:
            raise ValueError(f"node {self.source.name!r} has no output port {self.source_port!r}")
        if self.target_port not in self.target.inputs:
            raise ValueError(f"node {self.target.name!r} has no input port {self.target_port!r}")


class DataflowGraph:
    """A directed acyclic graph of nodes."""

    def __init__(self, name: str = "DataflowGraph") -> None:
        self.name = name
        self._nodes: dict[str, DataflowNode] = {}
        self._edges: list[DataflowEdge] = []

    @property
    def nodes(self) -> list[DataflowNode]:
        return list(self._nodes.values())

    @property
    def edges(self) -> list[DataflowEdge]:
        return list(self._edges)

    def __contains__(self, node: DataflowNode) -> bool:
        return node.node_id in self._nodes

    def __len__(self) -> int:
        return len(self._nodes)

    def add_node(self, node: DataflowNode) -> DataflowGraph:
        if node in self:
            raise ValueError(f"node {node.node_id!r} is in the graph already")
        self._nodes[node.node_id] = node
        return self

    def remove_node(self, node: DataflowNode) -> DataflowGraph:
        """Take a node and its edges out; nothing happens if it isn't there."""
        if self._nodes.pop(node.node_id, None):
            self._edges = [e for e in self._edges if node not in (e.source, e.target)]
        return self

    def connect(self, source: DataflowNode, target: DataflowNode, port: str | None = None, source_port: str | None = None, target_port: str | None = None) -> DataflowGraph:
        """Connect two nodes; port names both ends unless each is named."""
        for node in (source, target):
            if node not in self:
                raise ValueError(f"node {node.name!r} is not in the graph")
        a, b = source_port or port, target_port or port
        if a is None or b is None:
            raise ValueError("name the port, or both ports")
        self._edges.append(DataflowEdge(source, a, target, b))
        return self

    def incoming(self, node: DataflowNode) -> list[DataflowEdge]:
        return [e for e in self._edges if e.target is node]

    def get_predecessors(self, node: DataflowNode) -> list[DataflowNode]:
        return list({e.source.node_id: e.source for e in self.incoming(node)}.values())

    def get_successors(self, node: DataflowNode) -> list[DataflowNode]:
        return list({e.target.node_id: e.target for e in self._edges if e.source is node}.values())

    def get_source_nodes(self) -> list[DataflowNode]:
        fed = {e.target.node_id for e in self._edges}
        return [n for n in self.nodes if n.node_id not in fed]

    def get_sink_nodes(self) -> list[DataflowNode]:
        feeding = {e.source.node_id for e in self._edges}
        return [n for n in self.nodes if n.node_id not in feeding]

    def topological_sort(self) -> list[DataflowNode]:
        """Nodes after all that feed them, first added first; ValueError on a cycle."""
        waiting = {n.node_id: len(self.get_predecessors(n)) for n in self.nodes}
        ready, out = deque(n for n in self.nodes if not waiting[n.node_id]), []
        while ready:
            node = ready.popleft()
            out.append(node)
            for succ in self.get_successors(node):
                waiting[succ.node_id] -= 1
                if not waiting[succ.node_id]:
                    ready.append(succ)
        if len(out) < len(self._nodes):
            raise ValueError("the graph has a cycle")
        return out

    def get_parallel_groups(self) -> list[list[DataflowNode]]:
        """Nodes by the length of the longest way to them; those of a group don't depend on each other."""
        level: dict[str, int] = {}
        groups: list[list[DataflowNode]] = []
        for node in self.topological_sort():
            level[node.node_id] = at = max((level[p.node_id] + 1 for p in self.get_predecessors(node)), default=0)
            if at == len(groups):
                groups.append([])
            groups[at].append(node)
        return groups

    def validate(self) -> bool:
        """No cycle, no input port fed twice, and no port left open on a node that has any edge in."""
        self.topological_sort()
        for node in self.nodes:
            ports = [e.target_port for e in self.incoming(node)]
            twice = sorted({p for p in ports if ports.count(p) > 1})
            if twice:
                raise ValueError(f"node {node.name!r} has inputs fed more than once: {', '.join(twice)}")
            lacking = sorted(node.inputs.keys() - set(ports))
            if ports and lacking:
                raise ValueError(f"node {node.name!r} lacks inputs: {', '.join(lacking)}")
        return True

    def reset(self) -> None:
        for node in self.nodes:
            node.reset()

    def execute(self, executor=None) -> dict[str, dict[str, Any]]:
        """Outputs of every node by node_id."""
        from stackloom.plans.executor import GraphExecutor

        return (executor or GraphExecutor()).execute(self)
