"""Inputs that once broke a reader, a writer or an analysis."""

import os
import time

import pytest
from pyspark.sql import functions as F

from stackloom import file_queries as M
from stackloom.model import LIB_MAP, ResolveStrategy
from stackloom.operators import analysis as A
from stackloom.operators import resolve as R
from stackloom.operators.tree import build_tree
from stackloom.plans.builder import WorkflowBuilder
from stackloom.plans.nodes import FilterNode
from stackloom.session import scratch_dir
from stackloom.sinks import writers as W
from stackloom.sources import datasource, files
from stackloom.sources.formats import pack_map, pack_samples, parse_map, parse_samples, signed
from stackloom.streaming.online import OnlineAnalysis
from tests.util import stacks


def test_own_maps_are_read_whole(spark, tmp_path):
    text = open("/proc/self/maps").read() + "ffffffffff600000-ffffffffff601000 --xp 00000000 00:00 0                  [vsyscall]\n"
    (tmp_path / "maps").write_text(text)
    want = []
    for line in text.splitlines():
        span, mode, _, _, _, *name = line.split(None, 5)
        if mode[2] == "x":
            want.append((*[signed(int(x, 16)) for x in span.split("-")], name[0] if name else "[anonymous]"))
    got = files.read_process_maps(spark, str(tmp_path / "maps"))
    assert [(r["base"], r["end"], r["name"]) for r in got.orderBy("ord").collect()] == want and want[-1][2] == "[vsyscall]"
    back = files.read_maps(spark, W.export_map(got, str(tmp_path / "rank_0.libmap"), 0))
    assert [(r["base"], r["end"], r["name"]) for r in back.orderBy("ord").collect()] == want


def test_kernel_addresses_keep_their_bits():
    rows = [([0xFFFFFFFFFF600010, 5], 3)]
    data = pack_samples(rows)
    assert [a & (1 << 64) - 1 for a in parse_samples(data).rows[0][1]] == rows[0][0] and pack_samples([(parse_samples(data).rows[0][1], 3)]) == data
    assert parse_map(pack_map([(0xFFFFFFFFFF600000, 0xFFFFFFFFFF601000, True, "v")], 1)).rows == [(0, -10485760, -10481664, True, "v")]


def test_many_offsets_and_failures(spark):
    frames = spark.range(50_000).selectExpr("'lib' library_name", "id * 1000000007 offset").unionByName(spark.createDataFrame([("gone", 1)], "library_name string, offset long"))
    found = R.symbolize(frames.coalesce(1), M._tool(spark), statuses=True)
    assert found.where("status = 'Success' and library = 'lib'").count() == 50_000
    lost = R.symbolize(frames, "no-such-tool", statuses=True)
    assert {r["status"].split(":")[0] for r in lost.select("status").distinct().collect()} == {"NotRun"} and R.symbolize(frames, "no-such-tool").count() == 0
    table = spark.createDataFrame([("gone", 1, "f", "", 0)], "library string, offset long, function_name string, filename string, line_number int")
    assert R.find_symbols(frames, table, ResolveStrategy.TableOnly) is table
    assert R.find_symbols(frames.limit(10), None, ResolveStrategy.Addr2LineOnly, "false").count() == 0


def test_balance_with_a_far_process(spark):
    far = 4294967295
    b = A.balance(build_tree(stacks(spark, (0, "main@a", 5), (1, "main@a", 7), (far, "main@a", 7)))).first()
    assert (b["least_loaded_process"], b["most_loaded_process"], b["min_samples"], b["max_samples"], b["process_samples"]) == (2, 1, 0.0, 7.0, None)
    n, xs = far + 1, [5, 7, 7]
    mean = sum(xs) / n
    assert b["mean_samples"] == pytest.approx(mean) and b["std_dev_samples"] == pytest.approx((sum(x * x for x in xs) / n - mean * mean) ** 0.5)
    b = A.balance(build_tree(stacks(spark, (1, "main@a", 4), (2, "main@a", 4)))).first()
    assert (b["least_loaded_process"], b["most_loaded_process"], b["process_samples"]) == (0, 1, [0.0, 4.0, 4.0])
    b = A.balance(build_tree(stacks(spark, (0, "main@a", 2)).limit(0))).first()
    assert (b["mean_samples"], b["std_dev_samples"], b["imbalance_factor"], b["process_samples"]) == (0.0, 0.0, 0.0, [])


def test_balance_table_with_a_far_process(spark):
    table = W.balance_table(build_tree(stacks(spark, (0, "main@a", 5), (4294967295, "main@a", 7))))
    assert "Processes:        4294967296" in table


def test_filter_predicates(spark):
    tree = build_tree(stacks(spark, (0, "main@a > f@b", 5), (0, "main@a > g@b", 7), (1, "main@a", 1)))
    run = lambda **c: sorted(r["function_name"] for r in FilterNode(**c).execute({"tree": tree})["nodes"].collect())
    assert run(predicate=lambda n: False) == [] and run(predicate=lambda n: n.function_name > "f" and not n.is_root) == run(predicate=F.col("function_name") > "f") == ["g", "main"]
    assert run(predicate=lambda n: 1 // (n.total_samples > 6) > 0, min_samples=7) == ["[root]", "g"] and len(run()) == 4
    with pytest.raises(TypeError, match="predicate"):
        FilterNode(predicate="depth > 1")


def test_builder_takes_threads_and_the_name_load(spark):
    b = WorkflowBuilder().load_data(stacks=stacks(spark, (0, "main@a", 5)), spark=spark, concurrency_model="Serial", num_threads=2).custom(lambda tree: {"n": tree["tree"].total_samples}, {"tree": "Tree"}, {"n": "int"}, name="count")
    out = b.connect("load", "count", "tree").execute()
    assert b.get_node("load") is b.get_node("load_data") and out[b.get_node("count").node_id]["n"] == 5


def test_stream_takes_rewritten_files(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state", replace=True)
    p = data / "rank_0.pflw"
    p.write_bytes(pack_samples([([1], 5)]))
    o.start(None).awaitTermination(60)
    assert o.tree.total_samples == 5
    p.write_bytes(pack_samples([([1], 8), ([2], 1)]))
    o.start("1 second")
    until = time.time() + 60
    while o.tree.total_samples != 9 and time.time() < until:
        time.sleep(1)
    o.stop()
    assert o.tree.total_samples == 9


def test_writer_leaves_nothing_of_failed_jobs(spark, tmp_path):
    datasource.register(spark)
    df = spark.range(100).selectExpr("id % 3 process_id", "array(id) addrs", "1L count")
    df.write.format("pflw").mode("append").save(str(tmp_path / "out"))
    assert all(x.startswith("rank_") for x in os.listdir(tmp_path / "out"))
    bad = df.selectExpr("process_id", "addrs", "if(addrs[0] = 99, raise_error('no'), count) count")
    with pytest.raises(Exception, match="no"):
        bad.write.format("pflw").mode("append").save(str(tmp_path / "out"))
    assert all(x.startswith("rank_") for x in os.listdir(tmp_path / "out")) and spark.read.format("pflw").load(str(tmp_path / "out")).count() == 100
    df.where("process_id = 1").write.format("pflw").mode("overwrite").save(f"file://{tmp_path}/out")
    assert {r["process_id"] for r in spark.read.format("pflw").load(str(tmp_path / "out")).collect()} == {1}


def test_map_patterns_and_crossing_ranges(spark):
    maps = spark.createDataFrame([(0, 0, 1 << 62, signed((1 << 63) + 10), True, "x")], LIB_MAP)
    asked = spark.createDataFrame([(0, signed((1 << 63) + 4))], "process_id long, address long")
    for n in (0, 10):
        assert R.resolve_addresses(asked, maps, n).first()["offset"] == (1 << 62) + 4


def test_no_shared_folder_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Fake)
