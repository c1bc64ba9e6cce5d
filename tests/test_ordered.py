"""Ordered files by executors: bytes against a plain writer, parts, other stores, failures."""

import os

import pytest
from pyspark.sql import functions as F

from stackloom.model import SampleCountMode
from stackloom.operators.tree import build_tree
from stackloom.sinks import ordered
from stackloom.sinks import writers as W
from stackloom.sources.trees import read_trees

from .util import stacks


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("direct", [True, False])
def test_parts_come_in_order(spark, tmp_path, many_parts, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(ordered, "seen_by_tasks", lambda spark, path: None)
    rows = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("no"), F.concat(F.lit("é"), (F.col("id") * 7919 % 50_000).cast("string")).alias("line"))
    path = tmp_path / "x.txt"
    path.write_text("old")
    ordered.write_ordered(rows, str(path), ["no"], head=b"head\n", tail=b"tail")
    assert path.read_text() == "head\n" + "".join(f"é{i}\n" for i in range(50_000)) + "tail"
    ordered.write_ordered(rows.limit(0), str(path), ["no"], head=b"head\n", tail=b"tail")
    assert path.read_text() == "head\ntail" and os.listdir(tmp_path) == ["x.txt"]


def test_a_failed_write_keeps_the_old_file(spark, tmp_path, many_parts):
    def broken(batches):
        for _ in batches:
            yield b"some"
            raise RuntimeError("stopped")

    path = tmp_path / "x.txt"
    path.write_text("old")
    with pytest.raises(Exception, match="stopped"):
        ordered.write_ordered(spark.range(1000).select(F.col("id").alias("no")), str(path), ["no"], broken)
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["x.txt"]


def _tree(spark):
    rows = [(i % 5 * 2, f"main@app > f{i % 37}@lib{i % 3}+0x{i:x} > g{i}@lib", i % 4 + 1) for i in range(400)]
    return build_tree(stacks(spark, *rows), count_mode=SampleCountMode.Both)


def test_tree_file_equals_a_plain_writer_and_reads_back(spark, tmp_path, many_parts):
    t = _tree(spark)
    path = W.export_tree(t, str(tmp_path / "t.ptree"), 11)
    found, count = W.read_tree(open(path, "rb").read()), t.process_count
    n = t.traverse("preorder").orderBy("visit_rank").collect()
    number = {r["node_id"]: r["visit_rank"] - 1 for r in n}
    per = {}
    for r in t.node_process.collect():
        per.setdefault(r["node_id"], {})[r["process_id"]] = r
    expected = W.TREE_HEADER.pack(W.TREE_MAGIC, W.VERSION, 0, 0, len(n), count, 0, 11, b"")
    for r in n:
        names = [r[c].encode() for c in ("function_name", "library_name", "filename")]
        expected += W.TREE_NODE.pack(r["visit_rank"] - 1, number.get(r["parent_id"], 0), r["total_samples"], r["self_samples"], r["raw_address"], r["offset"], r["line_number"], *map(len, names), r["child_count"], 0) + b"".join(names)
        mine = [per.get(r["node_id"], {}).get(p) for p in range(count)]
        expected += W.struct.pack(f"<{count}Q{count}d", *[x["samples"] if x else 0 for x in mine], *[x["time_us"] if x else 0 for x in mine])
    assert open(path, "rb").read() == expected
    for stretch in (1, 64, 1 << 14):
        rows = read_trees(spark, path, stretch=stretch).orderBy("node").collect()
        assert [(r["node"], r["parent"], r["total_samples"], r["function_name"], r["library_name"], r["child_count"], r["samples"], r["times"]) for r in rows] == [(x["node"], x["parent"], x["total"], x["function"], x["library"], x["children"], x["samples"], x["times"]) for x in found]
    (tmp_path / "short.ptree").write_bytes(expected[:-1])
    with pytest.raises(Exception, match="ends within node"):
        read_trees(spark, str(tmp_path / "short.ptree")).count()


def test_text_and_dot_equal_their_lines(spark, tmp_path, many_parts):
    t = _tree(spark)
    body = "".join(r["line"] + "\n" for r in W.tree_lines(t).orderBy("visit_rank").collect())
    assert open(W.export_tree_text(t, str(tmp_path / "t.txt"), 5)).read().split("#\n\n")[1] == body
    edges = "".join(r["line"] + "\n" for r in W.dot_lines(t).orderBy("visit_rank", "part").collect())
    assert open(W.generate_dot(t, str(tmp_path / "t.dot"))).read().split(";\n\n")[1] == edges + "}\n"
