"""Sample files and maps of any size: written, read in pieces, and resolved by slices."""

import random

import pyarrow as pa
import pytest

from stackloom.api import TreeBuilder, analyze_samples
from stackloom.model import SampleCountMode, TreeBuildMode
from stackloom.operators import stabbing
from stackloom.operators.resolve import last_counts, resolve_added, resolve_samples
from stackloom.operators.tree import build_tree
from stackloom.sources import datasource, files, formats
from stackloom.sources.formats import pack_map, pack_samples, parse_map, parse_samples, signed


def entries(spark, rows):
    return spark.createDataFrame(rows, "process_id long, file_no long, entry_ord long, addrs array<long>, count long")


@pytest.mark.parametrize("mode", list(TreeBuildMode))
def test_samples_of_one_frame_are_added_in_slices(spark, monkeypatch, mode):
    """The same tree by slices as by frames that are joined: overlapping ranges, an address that many slices share, repeated, deep and empty stacks."""
    monkeypatch.setattr(stabbing, "SLICE_BITS", 5)
    rng = random.Random(7)
    maps = [(p, i, b := rng.randrange(400), b + rng.randrange(120), rng.random() < 0.8, f"l{rng.randrange(9)}") for p in (0, 1, 70_000, -3) for i in range(40)]
    maps += [(2, 0, 0x1000, 0x2000, False, "data"), (1, 99, signed(0xFFFFFFFFFF600000), signed(0xFFFFFFFFFF601000), True, "[vsyscall]")]
    rows, no = [], 0
    for p in (0, 1, 2, 5, 70_000, -3):
        for _ in range(5):
            for i in range(60):
                stack = rng.choice([[rng.randrange(450)], [rng.randrange(450)], [200], [signed(0xFFFFFFFFFF600010)], [rng.randrange(450), 7], []])
                rows.append((p, no, (no << 40) + i, stack, rng.randrange(1, 9)))
            no += 1
    lib_map = spark.createDataFrame(maps, "process_id long, ord int, base long, end long, executable boolean, name string")
    e = entries(spark, rows)

    def nodes(stacks):
        t = build_tree(stacks, mode, SampleCountMode.Both)
        return sorted(tuple(r) for r in t.nodes.select("depth", "path", "raw_address", "offset", "library_name", "function_name", "first", "total_samples", "self_samples", "total_time_us").where("depth > 0").collect())

    assert nodes(resolve_added(e, lib_map, by_offset=mode is TreeBuildMode.ContextAware, few=0)) == nodes(resolve_samples(last_counts(e), lib_map))


def test_slices_give_fewer_rows_than_entries(spark):
    lib_map = spark.createDataFrame([(0, 0, 0, 100_000, True, "l")], "process_id long, ord int, base long, end long, executable boolean, name string")
    e = entries(spark, [(0, 0, i, [i], 1) for i in range(3_000)])
    some = resolve_added(e, lib_map, few=0).collect()
    assert len(some) < 100 and sum(r["count"] for r in some) == 3_000


def test_one_file_is_decoded_by_several_tasks(spark, tmp_path):
    n = 900_000
    (tmp_path / "a_rank_3.pflw").write_bytes(pack_samples([([i], 1) for i in range(n)]))
    (tmp_path / "b_rank_4.pflw").write_bytes(pack_samples([([1, 2], 5), ([], 2)])[:-1])
    index = files.index_samples(files.binary(spark, str(tmp_path), "*.pflw"))
    assert sorted((r["file"].rsplit("/", 1)[1], r["status"], r["rows"]) for r in files.status_of(index).collect()) == [("a_rank_3.pflw", "Success", n), ("b_rank_4.pflw", "FileRead", 0)]
    named = index.select("file").distinct().selectExpr("file", "5L as file_no", "3L as process_id")
    got = files.entries_of(index, named)
    parts = [p for p in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if p]
    assert len(parts) > 2 and sum(parts) == n
    assert got.selectExpr("count(distinct entry_ord)", "min(entry_ord)", "max(entry_ord)", "sum(entry_ord - (5L << 40) - addrs[0])").first() == (n, 5 << 40, (5 << 40) + n - 1, 0)


def test_answers_do_not_read_the_files_again(spark, tmp_path):
    """What a tree is made of is written once; the files and the resolver serve no later question."""
    for p in range(3):
        (tmp_path / f"rank_{p}.pflw").write_bytes(pack_samples([([0x10 + p], 2), ([0x10 + p, 0x20], 3), ([0x10 + p], 4)]))
    (tmp_path / "rank_0.libmap").write_bytes(pack_map([(0x10, 0x18, True, "lib")], 0))
    names = [(f"{tmp_path}/rank_{p}.pflw", p) for p in range(3)]
    got = analyze_samples(names, [(f"{tmp_path}/rank_0.libmap", 0)], spark=spark)
    b = TreeBuilder(count_mode=SampleCountMode.Both, spark=spark)
    assert b.build_from_files(names[:1]) == 1 and b.build_from_files(names[1:]) == 2
    for p in range(3):
        (tmp_path / f"rank_{p}.pflw").unlink()
    for tree in (got["tree"], b.tree):
        plan = tree.nodes._jdf.queryExecution().toString()
        assert tree.kept and "binaryFile" not in plan and "MapInArrow" not in plan and tree.total_samples == 21
    assert {(r["library_name"], r["self_samples"]) for r in got["hotspots"].collect()} == {("lib", 4), ("[unknown]", 8), ("[unknown]", 6), ("[unresolved]", 3)}


def test_packed_batches_are_the_entries_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(4), [rng.randrange(-9, 1 << 62) for _ in range(rng.choice([0, 1, 2, 5, 128, 200]))], rng.randrange(1 << 40)) for _ in range(500)]
    schema = pa.schema([("count", pa.int64()), ("process_id", pa.int64()), ("addrs", pa.list_(pa.int64()))])
    batch = pa.RecordBatch.from_pylist([{"process_id": p, "addrs": a, "count": n} for p, a, n in rows], schema)
    got = {p: (n, body) for p, n, body in datasource._packed(batch.slice(50, 400))}
    assert got == {p: (len(x), b"".join(formats.pack_entry(a[:128], n) for a, n in x)) for p in range(4) if (x := [(a, n) for q, a, n in rows[50:450] if q == p])}
    for bad in ({"process_id": None, "addrs": [1], "count": 1}, {"process_id": 1, "addrs": None, "count": 1}, {"process_id": 1, "addrs": [None], "count": 1}, {"process_id": 1, "addrs": [1], "count": None}, {"process_id": 1, "addrs": [1], "count": -1}):
        with pytest.raises(ValueError):
            list(datasource._packed(pa.RecordBatch.from_pylist([bad], schema)))
    datasource.register(spark)
    df = spark.createDataFrame([(p, a, n) for p, a, n in rows], "process_id long, addrs array<long>, count long")
    df.repartition("process_id").write.format("pflw").mode("append").save(str(tmp_path / "out"))
    for p in range(4):
        (file,) = (tmp_path / "out").glob(f"rank_{p}-*.pflw")
        assert sorted((a, n) for _, a, n in parse_samples(file.read_bytes()).rows) == sorted((a[:128], n) for q, a, n in rows if q == p)


def test_bodies_are_put_together_from_parts(tmp_path):
    store = datasource.store_of(str(tmp_path))[0]
    body = datasource._Body(f"{tmp_path}/rank_0.pflw")
    for i in range(3):
        body.add(store, 1, formats.pack_entry([i], i + 1))
        if i < 2:
            assert body.spill(store) == 24
    body.close(store)
    assert [p.name for p in tmp_path.iterdir()] == ["rank_0.pflw"] and parse_samples((tmp_path / "rank_0.pflw").read_bytes()).rows == [(0, [0], 1), (1, [1], 2), (2, [2], 3)]


def test_names_of_maps_that_are_not_utf8():
    raw = formats.MAP_ENTRY.pack(1, 2, 1, b"", 3, 0) + b"a\xffb" + formats.MAP_ENTRY.pack(3, 4, 0, b"", 0, 0)
    p = parse_map(formats.map_header(2, 9) + raw)
    assert p.rows == [(0, 1, 2, True, "a�b"), (1, 3, 4, False, "")]


def test_maps_of_few_files_stay_spread(spark, tmp_path):
    """Rows of one map are dealt to several tasks, and finding their process doesn't bring them together again."""
    (tmp_path / "m.libmap").write_bytes(pack_map([(16 * i, 16 * i + 8, True, f"l{i}") for i in range(20_000)], 9))
    b = TreeBuilder(spark=spark)
    assert b.load_library_maps([(f"{tmp_path}/m.libmap", 2)]) == 1
    sizes = b._lib_map().rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 20_000 and max(sizes) < 10_000 and b._lib_map().selectExpr("min(process_id)", "max(process_id)").first() == (2, 2)


def test_nodes_of_a_stored_tree_come_from_one_shape(spark):
    b = TreeBuilder(count_mode=SampleCountMode.Both, spark=spark).insert_call_stack(["main", "f"], 0, 3).insert_call_stack(["main"], 1, 2)
    t = b.tree
    assert sorted((r["function_name"], r["total_samples"], r["child_count"]) for r in t.nodes.collect()) == [("[root]", 5, 1), ("f", 3, 0), ("main", 5, 1)]
    assert "posexplode" not in t.nodes._jdf.queryExecution().toString()
