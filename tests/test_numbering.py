"""Numbering within groups: against a window, with one group over many tasks."""

from statistics import median

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stackloom.model import SampleCountMode, TreeBuildMode
from stackloom.operators.numbering import numbered, ranges
from stackloom.operators.tree import build_tree

FRAMES = "array<struct<raw_address:long,offset:long,library_name:string,function_name:string,filename:string,line_number:int>>"


def _expected(rows):
    w = Window.partitionBy("group").orderBy("place")
    ahead = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("id", "group", "size", F.row_number().over(w).cast("long").alias("rank"), ahead.alias("ahead"))


def _family(spark, n, hot):
    """n rows, the first `hot` of which are of one group; the others of groups of three."""
    group = F.when(F.col("id") < hot, F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") / 3).cast("long").cast("string")))
    return spark.range(n).select(F.col("id").cast("string"), group.alias("group"), F.pmod(F.hash("id"), F.lit(7)).cast("long").alias("size"), F.xxhash64("id").alias("place"))


@pytest.mark.parametrize("n, hot", [(0, 0), (1, 1), (40, 40), (1_000, 0), (5_000, 4_000)])
def test_equals_a_window_over_each_group(spark, n, hot):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        rows = _family(spark, n, hot)
        assert sorted(map(tuple, numbered(rows, F.col("place")).collect())) == sorted(map(tuple, _expected(rows).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_group_of_a_million_spreads_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _family(spark, 1_000_000, 990_000)
        sizes = [r["count"] for r in ranges(rows, [F.col("place")]).groupBy("part").count().collect()]
        assert len(sizes) >= 4 and max(sizes) <= 2 * median(sizes)
        found, wanted = (x.agg(F.count("*"), F.sum(F.xxhash64("id", "group", "size", "rank", "ahead").cast("decimal(38,0)"))).first() for x in (numbered(rows, F.col("place")), _expected(rows)))
        assert found == wanted and found[0] == 1_000_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_node_with_many_children_is_walked_in_order_of_appearance(spark):
    frame = lambda name: F.struct(F.lit(0).cast("long").alias("raw_address"), F.lit(0).cast("long").alias("offset"), F.lit("lib").alias("library_name"), name.alias("function_name"), F.lit("").alias("filename"), F.lit(0).alias("line_number"))
    n = 20_000
    stacks = spark.range(n).select((F.col("id") % 3).alias("process_id"), F.col("id").alias("entry_ord"), F.array(frame(F.lit("main")), frame(F.concat(F.lit("f"), F.md5(F.col("id").cast("string"))))).alias("frames"), F.lit(1).cast("long").alias("count"), F.col("id"))
    tree = build_tree(stacks, TreeBuildMode.ContextFree, SampleCountMode.Exclusive)
    walked = [r["function_name"] for r in tree.traverse("preorder").where("depth = 2").orderBy("visit_rank").select("function_name").collect()]
    order = [r["f"] for r in stacks.orderBy("process_id", "entry_ord").select(F.col("frames")[1]["function_name"].alias("f")).collect()]
    assert walked == order and len(order) == n
    top = tree.ordered.where("depth <= 1").orderBy("depth").select("sibling_rank", "subtree_size", "preorder").collect()
    assert [tuple(r) for r in top] == [(1, n + 2, 0), (1, n + 1, 1)]


def test_an_empty_tree_has_its_root_alone(spark):
    tree = build_tree(spark.createDataFrame([], f"process_id long, frames {FRAMES}, count long"))
    assert [(r["visit_rank"], r["is_root"]) for order in ("preorder", "postorder", "levelorder") for r in tree.traverse(order).collect()] == [(1, True)] * 3
