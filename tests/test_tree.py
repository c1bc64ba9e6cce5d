import random

import pytest
from pyspark.sql import functions as F

from stackloom.model import SampleCountMode as M
from stackloom.model import TreeBuildMode as B
from stackloom.operators import analysis as A
from stackloom.operators.tree import ROOT_ID, build_tree
from stackloom.sinks import writers as W
from tests.util import by_path, stacks


def test_empty_tree(spark):
    t = build_tree(stacks(spark))
    assert (t.total_samples, t.process_count, t.node_count, t.max_depth) == (0, 0, 1, 0)
    assert [r["function_name"] for r in t.nodes.collect()] == ["[root]"] and A.find_hotspots(t).count() == 0
    assert A.balance(t).first()["process_samples"] == []


def test_counts_by_process(spark):
    t = build_tree(stacks(spark, *[(p, "main@a > work@a", p + 1) for p in range(4)]), count_mode=M.Both)
    work = by_path(t)["main/work"]
    assert t.total_samples == 10 and [t.node_samples(work["node_id"], p)[0] for p in range(5)] == [1, 2, 3, 4, 0]


SITES = [(0, "main@test+0x1000 > func@test+0x2000", 10), (0, "main@test+0x1000 > func@test+0x3000", 5)]


def test_context_free_merges_sites(spark):
    n = by_path(build_tree(stacks(spark, *SITES), count_mode=M.Both))
    assert set(n) == {"", "main", "main/func"} and n["main"]["total_samples"] == 15 and n["main"]["child_count"] == 1


def test_context_aware_keeps_sites(spark):
    t = build_tree(stacks(spark, *SITES), B.ContextAware, M.Both)
    assert sorted(r["total_samples"] for r in t.nodes_at_depth(2).collect()) == [5, 10]
    same = build_tree(stacks(spark, SITES[0], (0, SITES[0][1], 5)), B.ContextAware, M.Both)
    assert [r["total_samples"] for r in same.nodes_at_depth(2).collect()] == [15]


@pytest.mark.parametrize("mode,want", [(M.Exclusive, (100, 0, 0, 100, 100)), (M.Inclusive, (100, 100, 0, 100, 0)), (M.Both, (100, 100, 0, 100, 100))])
def test_count_modes(spark, mode, want):
    t = build_tree(stacks(spark, (0, "main@a > leaf@a", 100)), count_mode=mode)
    n = by_path(t)
    assert (n[""]["total_samples"], n["main"]["total_samples"], n["main"]["self_samples"], n["main/leaf"]["total_samples"], n["main/leaf"]["self_samples"]) == want
    assert t.call_count(ROOT_ID, n["main"]["node_id"]) == 100 and n[""]["self_samples"] == 0


def test_recursion_and_empty_stacks(spark):
    t = build_tree(stacks(spark, (0, "main@a > f@a > f@a", 4), (0, "", 5)), count_mode=M.Both)
    n = by_path(t)
    assert (n["main/f"]["total_samples"], n["main/f"]["self_samples"], n["main/f/f"]["total_samples"], n["main/f/f"]["self_samples"]) == (4, 0, 4, 4)
    assert t.total_samples == 4 and t.max_depth == 3


def test_merge_keeps_inner_samples(spark):
    a, b = (build_tree(stacks(spark, x), count_mode=M.Both) for x in ((0, "main@a", 7), (1, "main@a > f@a", 3)))
    t = a.merged(b)
    n = by_path(t)
    assert t.total_samples == 10 and n["main"]["self_samples"] == 7 and n["main"]["total_samples"] == 10
    with pytest.raises(ValueError):
        a.merged(build_tree(stacks(spark, SITES[0])))


def test_shape_and_lookups(spark):
    t = build_tree(stacks(spark, (0, "main@a > compute@b", 10), (0, "main@a > io@c", 5)), count_mode=M.Both)
    n = by_path(t)
    assert t.node_count == 4 and t.max_depth == 2 and {r["function_name"] for r in t.leaf_nodes.collect()} == {"compute", "io"}
    assert [r["function_name"] for r in t.traverse("levelorder").orderBy("visit_rank").collect()] == ["[root]", "main", "compute", "io"]
    assert [r["function_name"] for r in t.traverse("postorder").orderBy("visit_rank").collect()] == ["compute", "io", "main", "[root]"]
    assert t.find_nodes_by_name("compute").count() == 1 and t.find_nodes_by_name("nonexistent").count() == 0
    assert t.find_nodes_by_library("c").first()["function_name"] == "io" and t.filter_by_samples(10).count() == 3
    assert t.find_child(n["main"]["node_id"], "io").first()["total_samples"] == 5 and t.find_child(ROOT_ID, "io").count() == 0
    assert t.siblings(t.find_nodes_by_name("io")).first()["function_name"] == "compute" and t.siblings(t.nodes_at_depth(0)).count() == 0
    assert [r["names"] for r in t.paths.where("function_name = 'io'").collect()] == [["[root]", "main", "io"]]
    assert [r["function_name"] for r in t.traverse("preorder", F.col("function_name") == "compute").orderBy("visit_rank").collect()] == ["[root]", "main", "compute"]
    seen = []
    assert t.visit(lambda r: seen.append(r["function_name"]) or r["function_name"] != "main") == 2 and seen == ["[root]", "main"]
    with pytest.raises(ValueError):
        t.traverse("sideways")


def test_appearance_orders_siblings(spark):
    t = build_tree(stacks(spark, (1, "main@a > a@a", 1), (0, "main@a > z@a", 1)), count_mode=M.Both)
    assert [r["function_name"] for r in t.all_nodes.orderBy("visit_rank").collect()] == ["[root]", "main", "z", "a"]


def test_deep_stacks(spark):
    rows = [(0, " > ".join(f"f{(i + j) % 50}@lib" for j in range(128)), i) for i in range(1, 40)]
    t = build_tree(stacks(spark, *rows), count_mode=M.Both)
    assert t.max_depth == 128 and t.nodes.agg(F.sum("self_samples")).first()[0] == t.total_samples


def reference_trie(rows):
    total, own = {}, {}
    for _, s, n in rows:
        names = s.split(" > ") if s else []
        for d in range(1, len(names) + 1):
            k = tuple(names[:d])
            total[k] = total.get(k, 0) + n
        if names:
            own[tuple(names)] = own.get(tuple(names), 0) + n
    return {"/".join(x.split("@")[0] for x in k): (total[k], own.get(k, 0)) for k in total}


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_trie_whatever_the_partitions(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.randint(0, 3), " > ".join(f"{rnd.choice('abc')}@l" for _ in range(rnd.randint(0, 5))), rnd.randint(1, 9)) for _ in range(120)]
    df = stacks(spark, *rows)
    got = {k: (r["total_samples"], r["self_samples"]) for k, r in by_path(build_tree(df.repartition(7).orderBy(F.rand(seed)), count_mode=M.Both)).items() if k}
    assert got == reference_trie(rows)


def test_balance(spark):
    def of(*counts, n=0):
        return A.balance(build_tree(stacks(spark, *[(p, "main@a", c) for p, c in counts]), process_count=n)).first()

    even = of(*[(p, 100) for p in range(4)])
    assert (even["mean_samples"], even["std_dev_samples"], even["imbalance_factor"]) == (100, 0, 0)
    b = of((0, 50), (1, 100), (2, 150), (3, 200))
    assert (b["mean_samples"], b["least_loaded_process"], b["most_loaded_process"], b["imbalance_factor"]) == (125, 0, 3, 1.2) and abs(b["std_dev_samples"] - 3125**0.5) < 1e-9
    tie = of((0, 5), (1, 5), (2, 7), (3, 7))
    assert (tie["least_loaded_process"], tie["most_loaded_process"]) == (0, 2)
    assert of((2, 9), n=3)["process_samples"] == [0, 0, 9] and of((0, 1), n=3)["process_samples"] == [1, 0, 0]


def test_hotspots(spark):
    rows = [(0, "main@a > hot@a", 900), (0, "main@a > cold@a", 100)]
    hot = A.find_hotspots(build_tree(stacks(spark, *rows))).collect()
    assert [(h["function_name"], h["self_samples"], h["self_percentage"]) for h in hot] == [("hot", 900, 90.0), ("cold", 100, 10.0)]
    total = A.find_total_hotspots(build_tree(stacks(spark, *rows), count_mode=M.Both)).collect()
    assert [(h["function_name"], h["total_samples"], h["percentage"]) for h in total[:2]] == [("main", 1000, 100.0), ("hot", 900, 90.0)]
    assert A.find_hotspots(build_tree(stacks(spark, *rows), count_mode=M.Inclusive)).count() == 0
    many = build_tree(stacks(spark, *[(0, f"main@a > f{i}@a", 100 - 4 * i) for i in range(20)]))
    assert [h["self_samples"] for h in A.find_hotspots(many, 5).collect()] == [100, 96, 92, 88, 84]


def test_flat_hotspots(spark):
    df = stacks(spark, (0, "k@l > f@l > _start@l", 6), (0, "k@l > k@l > f@l", 4), (0, "", 2))
    got = {r["function_name"]: (r["exclusive_samples"], r["inclusive_samples"], r["inclusive_percentage"]) for r in A.flat_hotspots(df, "leaf_first").collect()}
    assert got == {"k": (10, 10, 1000 / 12), "f": (0, 10, 1000 / 12)}
    exact = A.flat_hotspots(stacks(spark, (0, "domain@l", 1)), exact=True)
    assert exact.count() == 1 and A.flat_hotspots(stacks(spark, (0, "domain@l", 1))).count() == 0


def test_missing_columns_and_nulls(spark):
    df = stacks(spark, (0, "main@a", 2), (1, "main@a", 3)).drop("time_us", "entry_ord").withColumn("keys", F.lit(1))
    df = df.unionByName(df.withColumn("count", F.lit(None).cast("long"))).unionByName(df.withColumn("process_id", F.lit(None).cast("long")))
    t = build_tree(df)
    assert t.total_samples == 5 and t.total_execution_time == 5000.0


def _counted(spark, *rows):
    """(stacks, how many times a row of theirs was made)."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    s = stacks(spark, *rows)
    return s.mapInArrow(count, s.schema), made


def test_children_are_found_from_stacks_made_once(spark, monkeypatch):
    """Same-named children of two libraries: the first in order of appearance, without numbers of the whole tree."""
    rows = [(1, "main@a > f@x", 4), (0, "main@a > f@z", 2), (0, "main@a > f@y", 1), (0, "main@a > g@y", 7)]
    s, made = _counted(spark, *rows)
    t = build_tree(s, count_mode=M.Both)
    top = next(r["node_id"] for r in build_tree(stacks(spark, *rows)).nodes.collect() if r["function_name"] == "main")
    o = build_tree(stacks(spark, *rows), count_mode=M.Both).ordered.where("function_name = 'f'").orderBy("sibling_rank").collect()
    assert [r["library_name"] for r in o] == ["z", "y", "x"]
    monkeypatch.setattr("stackloom.operators.tree.numbered", None)
    found = [t.find_child(top, "f").collect(), t.find_child(top, "f", "x").collect(), t.find_child(top, "f", "z", 1).collect(), t.find_child(top, "h").collect()]
    assert [[(r["library_name"], r["total_samples"], r["child_count"]) for r in x] for x in found] == [[("z", 2, 0)], [("x", 4, 0)], [], []]
    assert made.value == len(rows)


def test_tree_files_come_from_stacks_made_once(spark, tmp_path):
    rows = [(p, f"main@a > f{i}@b", i + p + 1) for p in range(3) for i in range(5)]
    s, made = _counted(spark, *rows)
    whole = W.read_tree(open(W.export_tree(build_tree(s, count_mode=M.Both), str(tmp_path / "t.ptree")), "rb").read())
    assert made.value == len(rows)
    assert [(x["function"], x["samples"]) for x in whole] == [("[root]", [15, 20, 25]), ("main", [15, 20, 25]), *[(f"f{i}", [i + 1, i + 2, i + 3]) for i in range(5)]]
