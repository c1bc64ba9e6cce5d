import threading
import time

import pytest
from pyspark.sql import functions as F

from stackloom.functions import callstack as C
from stackloom.functions.colors import color
from stackloom.model import ColorScheme
from stackloom.operators import benchmarks as N
from stackloom.plans.builder import WorkflowBuilder, create_balance_workflow, create_full_analysis_workflow, create_hotspot_workflow
from stackloom.plans.executor import CachingExecutor, GraphExecutor, ParallelExecutor
from stackloom.plans.graph import DataflowGraph, NodeState
from stackloom.plans.nodes import AggregateNode, CustomNode, HotspotAnalysisNode, LoadDataNode, MergeNode, TransformNode, union_all
from tests.util import stacks


def const(value, name="Source"):
    return CustomNode(lambda _: {"output": value}, {}, {"output": "Any"}, name)


def diamond():
    g, s = DataflowGraph(), const(10)
    left, right = TransformNode(lambda x: x * 2, name="Left"), TransformNode(lambda x: x + 5, name="Right")
    end = MergeNode(["a", "b"], lambda d: d["a"] + d["b"], "Sum")
    for n in (s, left, right, end):
        g.add_node(n)
    for n in (left, right):
        g.connect(s, n, source_port="output", target_port="input")
    g.connect(left, end, source_port="output", target_port="a").connect(right, end, source_port="output", target_port="b")
    return g, end


@pytest.mark.parametrize("executor", [GraphExecutor, ParallelExecutor, CachingExecutor, lambda: CachingExecutor(parallel=True)])
def test_diamond(executor):
    g, end = diamond()
    told = []
    x = executor()
    x.set_progress_callback(lambda *a: told.append(a))
    assert g.execute(x)[end.node_id]["merged"] == 35 and told[-1] == (4, 4, "Sum") and len(x.get_execution_times()) == 4
    assert [len(p) for p in g.get_parallel_groups()] == [1, 2, 1] and g.get_source_nodes()[0].name == "Source" and g.get_sink_nodes() == [end]


def test_graph_rules():
    g = DataflowGraph()
    a, b = TransformNode(lambda x: x, name="A"), TransformNode(lambda x: x, name="B")
    g.add_node(a).add_node(b)
    with pytest.raises(ValueError):
        g.add_node(a)
    for ports in ({"source_port": "no", "target_port": "input"}, {"source_port": "output", "target_port": "no"}, {}):
        with pytest.raises(ValueError):
            g.connect(a, b, **ports)
    with pytest.raises(ValueError):
        g.connect(a, const(1), source_port="output", target_port="input")
    g.connect(a, b, source_port="output", target_port="input")
    assert [n.name for n in g.topological_sort()] == ["A", "B"] and g.get_predecessors(b) == [a]
    g.connect(b, a, source_port="output", target_port="input")
    for f in (g.topological_sort, g.get_parallel_groups, g.validate):
        with pytest.raises(ValueError):
            f()
    g.remove_node(a).remove_node(a)
    assert len(g) == 1 and g.edges == []
    h = DataflowGraph().add_node(m := MergeNode(["x", "y"])).add_node(s := const(1))
    h.connect(s, m, source_port="output", target_port="x")
    with pytest.raises(ValueError):
        h.validate()
    h.connect(s, m, source_port="output", target_port="y").connect(s, m, source_port="output", target_port="y")
    with pytest.raises(ValueError):
        h.validate()


def test_failure_names_its_cause():
    g = DataflowGraph().add_node(n := CustomNode(lambda _: 1 / 0, {}, {}, "Bad"))
    with pytest.raises(RuntimeError) as e:
        g.execute()
    assert isinstance(e.value.__cause__, ZeroDivisionError) and n.state is NodeState.FAILED


def test_cache():
    calls, lock = [], threading.Lock()

    def run(_):
        with lock:
            calls.append(1)
        return {"output": 1}

    g = DataflowGraph().add_node(CustomNode(run, {}, {"output": "int"}, "Count"))
    x = CachingExecutor(max_cache_size=2)
    g.execute(x)
    g.execute(x)
    assert len(calls) == 1 and x.get_cache_stats()["hits"] == 1 and x.get_cache_stats()["misses"] == 1 and g.nodes[0].state is NodeState.CACHED
    x.execute(g, force_recompute=True)
    assert len(calls) == 2
    for i in range(3):
        DataflowGraph().add_node(const(i, f"N{i}")).execute(x)
    assert x.get_cache_stats()["size"] == 2
    x.clear_cache()
    assert x.get_cache_stats() == {"size": 0, "max_size": 2, "hits": 0, "misses": 0, "hit_rate": 0.0}


def test_changed_configuration_is_not_stale(spark):
    df = stacks(spark, *[(0, f"main@a > f{i}@a", i + 1) for i in range(6)])
    x, load = CachingExecutor(), LoadDataNode(stacks=df, spark=spark)
    sizes = []
    for n in (2, 5):
        g = DataflowGraph().add_node(load).add_node(h := HotspotAnalysisNode(n))
        g.connect(load, h, "tree")
        sizes.append(g.execute(x)[h.node_id]["hotspots"].count())
    assert sizes == [2, 5] and x.get_cache_stats()["hits"] == 1
    x.clear_cache()


def test_workflow(spark):
    df = stacks(spark, (0, "main@a > hot@a", 90), (1, "main@a > cold@b", 10))
    names = []
    w = WorkflowBuilder("W").load_data(stacks=df, spark=spark).find_hotspots(1).analyze_balance().filter_nodes(min_samples=20, function_pattern="*o*").traverse(lambda r: names.append(r["function_name"]), stop_condition=lambda r: r["function_name"] == "main")
    w.transform(lambda h: h.count(), "hotspots", "hotspots").custom(lambda i: {"out": 1}, {}, {"out": "int"})
    out = w.execute(parallel=True)
    get = lambda name: out[w.get_node(name).node_id]
    assert get("hotspots")["summary"].first().asDict() == {"count": 1, "top_function": "hot", "top_percentage": 90.0}
    assert get("balance")["balance"].first()["is_balanced"] is False and [r["function_name"] for r in get("filter")["nodes"].orderBy("depth").collect()] == ["[root]", "hot"]
    assert names == ["[root]", "main"] and get("TreeTraversal")["visited_count"] == 2 and get("transform")["output"] == 1
    with pytest.raises(ValueError):
        WorkflowBuilder().find_hotspots()
    for make, n in ((create_hotspot_workflow, 2), (create_balance_workflow, 2), (create_full_analysis_workflow, 4)):
        assert len(make(stacks=df, spark=spark).execute(CachingExecutor())) == n


def test_aggregate_and_merge(spark):
    import pandas as pd

    df = stacks(spark, (0, "main@a > hot@a", 90), (1, "main@a > cold@b", 10))
    g = DataflowGraph().add_node(load := LoadDataNode(stacks=df, spark=spark))
    a = AggregateNode([F.sum("self_samples").alias("n")], [F.col("library_name")], F.col("depth") > 0)
    b = AggregateNode(aggregate_fn=lambda pdf: pd.DataFrame({"f": [pdf["function_name"].iloc[0]], "n": [int(pdf["self_samples"].sum())]}), schema="f string, n long", name="B")
    m = MergeNode(["x", "y"], union_all)
    for n in (a, b, m):
        g.add_node(n)
    g.connect(load, a, "tree").connect(load, b, "tree").connect(a, m, source_port="aggregated", target_port="x").connect(b, m, source_port="aggregated", target_port="y")
    out = g.execute()
    assert {r["library_name"]: r["n"] for r in out[a.node_id]["aggregated"].collect()} == {"a": 90, "b": 10} and out[m.node_id]["merged"].count() == 6


def test_benchmarks(spark):
    runs = spark.createDataFrame([("cg", "C", 4, i, t) for i, t in ((1, 4.0), (2, 6.0), (3, 10.0))], "benchmark string, class string, num_processes int, iteration int, execution_time_sec double")
    assert N.baseline_times(runs, running=True).first()["baseline_time_sec"] == 7.5 and abs(N.baseline_times(runs).first()["baseline_time_sec"] - 20 / 3) < 1e-9
    over = spark.createDataFrame([("cg", "C", 4, 1, 4.86), ("cg", "C", 4, 2, 0.0), ("ep", "C", 4, 1, 3.0)], runs.schema)
    base = spark.createDataFrame([("cg", "C", 4, 4.76)], "benchmark string, class string, num_processes int, baseline_time_sec double")
    got = {(r["benchmark"], r["iteration"]): r["overhead_percent"] for r in N.overhead(over, base).collect()}
    assert got == {("cg", 1): 2.1, ("cg", 2): None, ("ep", 1): None}
    assert N.average_overhead(N.overhead(over, base)).first()["runs"] == 1
    assert N.select_runs(spark.createDataFrame([("bt", "C", 8), ("bt", "C", 16), ("cg", "C", 8)], "benchmark string, class string, num_processes int")).count() == 2


def test_column_functions(spark):
    row = spark.range(1).select(
        C.push(F.array(F.lit(1)), F.lit(2), 2).alias("a"), C.push(F.array(F.lit(1)), F.lit(2), 1).alias("b"), C.pop(F.array().cast("array<int>")).alias("c"), C.frame(F.array(F.lit(7)), -1).alias("d"), C.percentage(F.lit(1), F.lit(0)).alias("e"),
        C.source_location(F.lit("a.c"), F.lit(3)).alias("f"), C.function_key(F.lit("g"), F.lit(""), F.lit(0)).alias("h"), C.wildcard(F.lit("xfoox"), "*foo*").alias("i"), C.wildcard(F.lit("bar"), "*foo*").alias("j"), C.wildcard(F.lit("bar"), "*foo*", False).alias("k"),
        color(F.lit(1), F.lit(0), ColorScheme.Heatmap).alias("l"), color(F.lit(1), F.lit(1), ColorScheme.Grayscale).alias("m"), color(F.lit(0), F.lit(4), ColorScheme.Heatmap).alias("n"), color(F.lit(4), F.lit(4), ColorScheme.Rainbow).alias("o"), color(F.lit(0), F.lit(4), ColorScheme.Rainbow).alias("p"),
    ).first()
    assert tuple(row) == ([1, 2], [1], [], None, 0.0, "a.c:3", "g", True, False, True, "white", "#000000", "#0000ff", "#ff0000", "#7f00ff")
    with pytest.raises(ValueError):
        C.root_first(F.lit(1), "sideways")


def test_a_failing_node_ends_the_jobs_of_the_others(spark):
    def slow(batches):
        for b in batches:
            time.sleep(120)
            yield b

    def count(inputs):
        spark.range(4).mapInArrow(slow, "id long").count()
        return {"n": 1}

    def fail(inputs):
        time.sleep(3)
        raise ValueError("no more")

    graph = DataflowGraph("g")
    nodes = [CustomNode(count, {}, {"n": "int"}, name="slow"), CustomNode(fail, {}, {"n": "int"}, name="bad"), CustomNode(count, {}, {"n": "int"}, name="slower")]
    for n in nodes:
        graph.add_node(n)
    began = time.time()
    with pytest.raises(RuntimeError, match="'bad' failed: no more"):
        ParallelExecutor(3).execute(graph)
    assert time.time() - began < 60 and all(n.state.name == "FAILED" for n in nodes)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_jobs_of_a_node_have_their_pool_and_tag(spark):
    seen = {}

    def look(inputs):
        seen[len(seen)] = (spark.sparkContext.getLocalProperty("spark.scheduler.pool"), set(spark.sparkContext.getJobTags()))
        return {"n": spark.range(3).count()}

    graph = DataflowGraph("g")
    for i in range(3):
        graph.add_node(CustomNode(look, {}, {"n": "int"}, name=f"n{i}"))
    out = ParallelExecutor(1).execute(graph)
    assert [v["n"] for v in out.values()] == [3, 3, 3] and len({p for p, _ in seen.values()}) == 3 and all(t == {p} for p, t in seen.values())
