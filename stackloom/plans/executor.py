"""Executors of dataflow graphs: one node after the other, levels in threads, or with a cache of results."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor, as_completed, wait
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from stackloom.operators.tree import Tree
from stackloom.plans.graph import DataflowGraph, DataflowNode, NodeState

Results = dict[str, dict[str, Any]]


class GraphExecutor:
    """Runs nodes in topological order. Plans are lazy, so this is where jobs are described rather than run."""

    def __init__(self) -> None:
        self._progress: Callable[[int, int, str], None] | None = None
        self._times: dict[str, float] = {}

    def set_progress_callback(self, callback: Callable[[int, int, str], None] | None) -> None:
        """callback(done, total, name of the node)."""
        self._progress = callback

    def get_execution_times(self) -> dict[str, float]:
        return dict(self._times)

    def _tell(self, done: int, total: int, name: str) -> None:
        if self._progress:
            self._progress(done, total, name)

    def _inputs(self, graph: DataflowGraph, node: DataflowNode, results: Results) -> dict[str, Any]:
        return {e.target_port: results[e.source.node_id][e.source_port] for e in graph.incoming(node)}

    def _run(self, graph: DataflowGraph, node: DataflowNode, results: Results) -> dict[str, Any]:
        began = time.perf_counter()
        node.state = NodeState.RUNNING
        try:
            inputs = self._inputs(graph, node, results)
            node.validate_inputs(inputs)
            node.result = node.execute(inputs)
        except Exception as e:
            node.state, node.error = NodeState.FAILED, e
            raise RuntimeError(f"node {node.name!r} failed: {e}") from e
        node.state = NodeState.COMPLETED
        self._times[node.node_id] = time.perf_counter() - began
        return node.result

    def execute(self, graph: DataflowGraph) -> Results:
        graph.reset()
        graph.validate()
        self._times.clear()
        results: Results = {}
        order = graph.topological_sort()
        for i, node in enumerate(order, 1):
            results[node.node_id] = self._run(graph, node, results)
            self._tell(i, len(order), node.name)
        return results


SequentialExecutor = GraphExecutor


class ParallelExecutor(GraphExecutor):
    """Runs the nodes of a level in threads, so that jobs which they start run at the same time.

    The jobs of each node have a pool and a tag of their own: where spark.scheduler.mode is FAIR, nodes share the cluster
    evenly. When a node fails, the jobs of the others are cancelled, now and as long as they start any, and its error is raised
    once they have ended.
    """

    def __init__(self, max_workers: int | None = None) -> None:
        super().__init__()
        self.max_workers = max_workers

    def _tagged(self, spark: SparkSession | None, tag: str, graph: DataflowGraph, node: DataflowNode, results: Results) -> dict[str, Any]:
        if spark is None:
            return self._run(graph, node, results)
        context = spark.sparkContext
        pool = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", tag)
        context.addJobTag(tag)
        try:
            return self._run(graph, node, results)
        finally:  # threads of the executor serve several nodes
            context.removeJobTag(tag)
            context.setLocalProperty("spark.scheduler.pool", pool)

    def execute(self, graph: DataflowGraph) -> Results:
        graph.reset()
        graph.validate()
        self._times.clear()
        results: Results = {}
        done, total = 0, len(graph)
        spark, run = SparkSession.getActiveSession(), uuid.uuid4().hex[:12]
        with ThreadPoolExecutor(self.max_workers) as pool:
            for group in graph.get_parallel_groups():
                tags = {node.node_id: f"{run}-{node.node_id}" for node in group}
                started = {}
                for node in group:
                    # Each thread has the caller's own properties: description, group and tags of its jobs.
                    work = inheritable_thread_target(spark)(self._tagged) if spark else self._tagged
                    started[pool.submit(work, spark, tags[node.node_id], graph, node, results)] = node
                for future in as_completed(started):
                    if error := future.exception():
                        self._end(spark, [f for f in started if not f.done()], [tags[n.node_id] for f, n in started.items() if not f.done()])
                        raise error
                    node = started[future]
                    results[node.node_id] = future.result()
                    done += 1
                    self._tell(done, total, node.name)
        return results

    @staticmethod
    def _end(spark: SparkSession | None, futures: list[Future], tags: list[str]) -> None:
        waiting = {f for f in futures if not f.cancel()}
        while waiting:
            for tag in tags if spark else ():
                spark.sparkContext.cancelJobsWithTag(tag)
            waiting = wait(waiting, timeout=0.5).not_done


def _keep(value: Any, on: bool) -> None:
    if isinstance(value, (DataFrame, Tree)):
        value.persist() if on else value.unpersist()


class CachingExecutor(GraphExecutor):
    """Keeps results by configuration and upstream keys, the least recently used going first.

    DataFrames and trees are persisted while they are kept and released when they go.
    """

    def __init__(self, max_cache_size: int = 100, parallel: bool = False, max_workers: int | None = None) -> None:
        super().__init__()
        self.max_cache_size, self.parallel, self.max_workers = max_cache_size, parallel, max_workers
        self._cache: OrderedDict[str, dict[str, Any]] = OrderedDict()
        self._held: dict[str, DataflowNode] = {}
        self._hits = self._misses = 0

    def execute(self, graph: DataflowGraph, force_recompute: bool = False) -> Results:
        graph.reset()
        graph.validate()
        self._times.clear()
        results: Results = {}
        keys: dict[str, str] = {}
        done, total = 0, len(graph)

        def one(node: DataflowNode) -> dict[str, Any]:
            key = keys[node.node_id]
            if not force_recompute and key in self._cache:
                self._hits += 1
                self._cache.move_to_end(key)
                node.result, node.state = self._cache[key], NodeState.CACHED
                return node.result
            self._misses += 1
            out = self._run(graph, node, results)
            self._store(key, node, out)
            return out

        with ThreadPoolExecutor(self.max_workers if self.parallel else 1) as pool:
            for group in graph.get_parallel_groups():
                for node in group:
                    keys[node.node_id] = node.get_cache_key({e.target_port: f"{keys[e.source.node_id]}.{e.source_port}" for e in graph.incoming(node)})
                for node, out in zip(group, pool.map(one, group)):
                    results[node.node_id] = out
                    done += 1
                    self._tell(done, total, node.name)
        return results

    def _store(self, key: str, node: DataflowNode, value: dict[str, Any]) -> None:
        if self.max_cache_size <= 0:
            return
        while len(self._cache) >= self.max_cache_size and key not in self._cache:
            self._drop(next(iter(self._cache)))
        for v in value.values():
            _keep(v, True)
        # The node stays with its key, which may hold the identity of objects that it refers to.
        self._cache[key], self._held[key] = value, node

    def _drop(self, key: str) -> None:
        for v in self._cache.pop(key).values():
            _keep(v, False)
        self._held.pop(key, None)

    def clear_cache(self) -> None:
        for key in list(self._cache):
            self._drop(key)
        self._hits = self._misses = 0

    def get_cache_stats(self) -> dict[str, Any]:
        asked = self._hits + self._misses
        return {"size": len(self._cache), "max_size": self.max_cache_size, "hits": self._hits, "misses": self._misses, "hit_rate": self._hits / asked if asked else 0.0}
