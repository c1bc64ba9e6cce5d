import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.api import TreeBuilder, analyze_samples
from stackloom.model import FileStatus as S
from stackloom.model import SampleCountMode
from stackloom.operators.resolve import OffsetConverter, parse_addr2line, resolve_addresses, resolve_samples, symbolize
from stackloom.sinks import writers as W
from stackloom.sources import datasource, files, formats
from stackloom.sources.formats import SAMPLE_HEADER, SAMPLE_MAGIC, pack_map, pack_samples, parse_map, parse_samples

STACKS = [([0x1000, 0x2000, 0x3000], 100), ([0x4000, 0x5000], 200), ([0x6000], 50)]
LIBS = [(0x7F0000001000, 0x7F0000002000, True, "lib1"), (0x7F0000003000, 0x7F0000004000, True, "lib2"), (0x400000, 0x500000, True, "/usr/bin/test"), (0x7F0000005000, 0x7F0000006000, False, "data")]


def test_layout_sizes():
    assert len(pack_samples([])) == 64 and len(pack_samples([([1], 1)])) == 64 + 16 + 8 and len(pack_map([], 1)) == 64
    assert W.TREE_NODE.size == 64


def test_parse_statuses():
    good = pack_samples(STACKS)
    assert [(a, c) for _, a, c in parse_samples(good).rows] == STACKS and parse_samples(pack_samples([])).rows == []
    newer = SAMPLE_HEADER.pack(SAMPLE_MAGIC, 2, 0, 0, 0, 128, 0, 0, b"")
    packed = SAMPLE_HEADER.pack(SAMPLE_MAGIC, 1, 1, 0, 0, 128, 0, 0, b"")
    deep = pack_samples([(list(range(129)), 1)], max_depth=129)
    huge = SAMPLE_HEADER.pack(SAMPLE_MAGIC, 1, 0, 0, 1, 128, 0, 0, b"") + struct.pack("<IIQ", 0, 0, 1 << 63)
    cases = {b"X" * 64: S.InvalidFormat, b"": S.FileRead, good[:-1]: S.FileRead, good[:70]: S.FileRead, newer: S.VersionMismatch, packed: S.Compression, deep: S.Integrity, huge: S.Integrity}
    for data, status in cases.items():
        got = parse_samples(data)
        assert got.status is status and not got.rows
    assert parse_samples(newer, header_only=True).status is S.Success
    name = "x" * 390
    assert [r[4] for r in parse_map(pack_map([(1, 2, True, name)], 7)).rows] == [name]
    assert parse_map(pack_map([(1, 2, True, "y" * 5000)], 7)).status is S.Integrity and parse_map(b"Z" * 80).status is S.InvalidFormat
    assert len(parse_samples(pack_samples([(list(range(200)), 1)])).rows[0][1]) == 128


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "perf_rank_0.pflw").write_bytes(pack_samples([([0x7F0000001500, 0x7F0000003500], 10), ([0x7F0000001500], 3), ([0x7F0000001500], 4)]))
    (tmp_path / "sub" / "perf_rank_12.pflw").write_bytes(pack_samples([([0x410000, 0x9999], 5)]))
    (tmp_path / "bad_rank_3.pflw").write_bytes(b"X" * 64)
    (tmp_path / "perf_rank_0.libmap").write_bytes(pack_map(LIBS, 99))
    (tmp_path / "perf_rank_12.libmap").write_bytes(pack_map(LIBS, 12))
    return tmp_path


def test_read_folder(spark, folder):
    samples, status = files.read_samples(spark, str(folder), glob="*.pflw")
    got = sorted((r["process_id"], r["entry_ord"], r["addrs"], r["count"]) for r in samples.collect())
    assert got == [(0, 0, [0x7F0000001500, 0x7F0000003500], 10), (0, 1, [0x7F0000001500], 4), (12, 0, [0x410000, 0x9999], 5)]
    assert sorted((r["file"].rsplit("/", 1)[1], r["status"]) for r in status.collect()) == [("bad_rank_3.pflw", "InvalidFormat"), ("perf_rank_0.pflw", "Success"), ("perf_rank_12.pflw", "Success")]
    assert files.read_samples(spark, str(folder), glob="*.pflw", duplicates="sum")[0].where("process_id = 0 and entry_ord = 1").first()["count"] == 7
    assert files.count_ok(files.read_headers(spark, str(folder), "*.pflw")) == 2
    listed = files.list_files(spark, str(folder))
    pairs = files.pair_files(listed.where("file_type = 'sample_data'"), listed.where("file_type = 'library_map'"))
    assert pairs.where("map_path is null").count() == 1


def test_data_sources(spark, folder, tmp_path):
    datasource.register(spark)
    df = spark.read.format("pflw").option("frame_order", "leaf_first").option("duplicates", "all").load(str(folder))
    assert spark.read.format("pflw").load(str(folder)).count() == 3  # a stack that comes twice counts as its last entry says
    assert df.where("process_id = 12").first()["addrs"] == [0x9999, 0x410000] and df.count() == 4
    assert spark.read.format("pflw").option("headerOnly", "true").load(str(folder)).where("status = 'Success'").count() == 2
    assert spark.read.format("libmap").load(str(folder)).where("process_id = 12").count() == 4
    out = tmp_path / "out"
    df.write.format("pflw").mode("append").save(str(out))
    assert spark.read.format("pflw").option("duplicates", "all").load(str(out)).agg(F.sum("count")).first()[0] == 22


def test_builder_end_to_end(spark, folder):
    b = TreeBuilder(count_mode=SampleCountMode.Both, spark=spark)
    assert b.load_library_maps([(f"{folder}/perf_rank_0.libmap", 0), (f"{folder}/sub/none.libmap", 4)]) == 1
    assert b.build_from_files([(f"{folder}/perf_rank_0.pflw", 0), (f"{folder}/bad_rank_3.pflw", 3), (f"{folder}/gone.pflw", 5)]) == 1
    assert {r["status"] for r in b.file_status.collect()} == {"Success", "InvalidFormat", "FileOpen"}
    t = b.tree
    assert t.total_samples == 14 and t.process_count == 4 and {r["library_name"] for r in t.nodes.collect()} == {"[virtual]", "lib1", "lib2"}
    got = analyze_samples([(f"{folder}/sub/perf_rank_12.pflw", 1)], spark=spark)
    assert got["hotspots"].first()["function_name"] == "[unknown]" and got["balance"].first()["process_samples"] == [0, 5]


def lib_map(spark, process=0, rows=LIBS):
    return spark.createDataFrame([(process, i, *r) for i, r in enumerate(rows)], "process_id long, ord int, base long, end long, executable boolean, name string")


def test_resolution(spark):
    asked = [0x7F0000001500, 0x7F0000003500, 0x7F0000001800, 0x410000, 0x9999, 0x7F0000005500, 0x7F0000002000]
    df = spark.createDataFrame([(p, a) for p in (0, 7) for a in asked], "process_id long, address long")
    want = {0x7F0000001500: ("lib1", 0x500), 0x7F0000003500: ("lib2", 0x500), 0x7F0000001800: ("lib1", 0x800), 0x410000: ("/usr/bin/test", 0x410000), 0x9999: ("[unresolved]", 0x9999), 0x7F0000005500: ("[unresolved]", 0x7F0000005500), 0x7F0000002000: ("[unresolved]", 0x7F0000002000)}
    overlap = LIBS + [(0, 0x7FFFFFFFFFFF, True, "everything")]
    for limit in (1000, 0):
        got = {(r["process_id"], r["address"]): (r["library_name"], r["offset"]) for r in resolve_addresses(df, lib_map(spark), limit).collect()}
        assert {a: got[0, a] for a in asked} == want and all(got[7, a] == ("[unknown]", a) for a in asked)
        wide = {r["address"]: r["library_name"] for r in resolve_addresses(df.where("process_id = 0"), lib_map(spark, rows=overlap), limit).collect()}
        assert wide[0x7F0000001500] == "lib1" and wide[0x9999] == "everything"


def test_symbols(spark):
    samples = spark.createDataFrame([(0, 0, [0x7F0000001500, 0x9999], 2), (0, 1, [], 1), (5, 0, [0x10], 1)], "process_id long, entry_ord long, addrs array<long>, count long")
    symbols = spark.createDataFrame([("lib1", 0x500, "f", "f.c", 7), ("[unresolved]", 0x9999, "no", "", 0)], "library string, offset long, function_name string, filename string, line_number int")
    got = {(r["process_id"], r["entry_ord"]): [(f["function_name"], f["library_name"], f["line_number"]) for f in r["frames"]] for r in resolve_samples(samples, lib_map(spark), symbols, "leaf_first").collect()}
    assert got == {(0, 0): [("", "[unresolved]", 0), ("f", "lib1", 7)], (0, 1): [], (5, 0): [("[unknown]", "[unknown]", 0)]}
    c = OffsetConverter()
    c.add_map_snapshot(0, lib_map(spark))
    c.add_map_snapshot(0, lib_map(spark))
    assert c.snapshot_count == 1 and c.has_snapshot(0) and not c.has_symbol_table and c.convert(samples).count() == 3
    assert symbolize(spark.createDataFrame([("/no/such.so", 16)], "library_name string, offset long")).count() == 0
    assert parse_addr2line("f\n", "a:b.c:12 (discriminator 3)\n") == ("f", "a:b.c", 12) and parse_addr2line("??", "??:0") is None and parse_addr2line("f", "??:?") == ("f", "", 0) and parse_addr2line("??", "a.c:3") == ("", "a.c", 3)


def test_process_maps(spark, tmp_path):
    p = tmp_path / "maps"
    p.write_text("00400000-00401000 r-xp 00000000 08:01 1 /usr/bin/test\n00600000-00601000 rw-p 0 08:01 1 /usr/bin/test\nnonsense\n7f0000000000-7f0000001000 r-xp 00000000 00:00 0\n")
    got = [(r["ord"], r["base"], r["name"]) for r in files.read_process_maps(spark, str(p)).collect()]
    assert got == [(0, 0x400000, "/usr/bin/test"), (1, 0x7F0000000000, "[anonymous]")]


def test_writers(spark, tmp_path):
    b = TreeBuilder(count_mode=SampleCountMode.Both, spark=spark)
    b.insert_call_stack(["main", 'a"b'], 0, 3, library="lib").insert_call_stack(["main"], 1, 1, library="lib")
    t = b.tree
    text = open(W.export_tree_text(t, str(tmp_path / "t.txt"), 5)).read()
    assert text.endswith('#\n\n[4 samples, 0 self] [root]\n  [4 samples, 1 self] main (lib)\n    [3 samples, 3 self] a"b (lib)\n') and "# Process count: 2\n# Total samples: 4\n" in text
    dot = open(W.generate_dot(t, str(tmp_path / "t.dot"))).read()
    assert '  node0 [label="[root]\\n[4 samples, 100.0%]", fillcolor="#ff0000"];\n' in dot and '  node1 -> node2 [label="3"];' in dot and '[label="a\\"b\\n[3 samples, 75.0%]", fillcolor="#ffff00"]' in dot
    assert "node2" not in open(W.generate_dot(t, str(tmp_path / "u.dot"), max_depth=1)).read() and W.generate_pdf(t, str(tmp_path / "t.pdf"), tool="no-such-tool") is False
    nodes = W.read_tree(open(W.export_tree(t, str(tmp_path / "t.ptree")), "rb").read())
    assert [(n["node"], n["parent"], n["total"], n["self"], n["function"], n["samples"]) for n in nodes] == [(0, 0, 4, 0, "[root]", [3, 1]), (1, 0, 4, 1, "main", [3, 1]), (2, 1, 3, 3, 'a"b', [3, 0])]
    samples = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(STACKS)], "entry_ord long, addrs array<long>, count long")
    assert sorted((a, c) for _, a, c in parse_samples(open(W.export_samples(samples, str(tmp_path / "s.pflw")), "rb").read()).rows) == sorted(STACKS)
    lines = open(W.export_samples_text(samples, str(tmp_path / "s.txt"), 1)).read()
    assert "[50] Call Stack (depth: 1)\n  0x0000000000006000\n\n" in lines
    m = lib_map(spark)
    assert len(parse_map(open(W.export_map(m, str(tmp_path / "m.libmap"), 42), "rb").read()).rows) == 4
    assert "[0x0000000000400000 - 0x0000000000500000] (0x100000 bytes) [x] /usr/bin/test\n" in open(W.export_map_text(m, str(tmp_path / "m.txt"), 42)).read()
    assert "main" in W.hotspot_table(t, show_inclusive=True) and "Processes:        2" in W.balance_table(t)


def test_benchmark_output(spark, tmp_path):
    (tmp_path / "cg.C.4.1.out").write_text(" Time in seconds =                    4.86\n Mop/s total     =   12.5\n")
    (tmp_path / "ep.C.8.2.out").write_text("nothing")
    got = sorted(tuple(r)[1:] for r in files.read_benchmark_output(spark, str(tmp_path)).collect())
    assert got == [("cg", "C", 4, 1, 4.86, 12.5, 0.0), ("ep", "C", 8, 2, 0.0, 0.0, 0.0)]


def test_large_files_are_decoded_in_pieces(tmp_path):
    """Status first, then so many rows at a time; a cut in the last entry takes them all back."""
    libraries = [(i * 10, i * 10 + 5, i % 2 == 0, f"l{i}") for i in range(25_000)]
    entries = [([i, i + 1], i) for i in range(120_000)]
    for data, decode, most in ((pack_map(libraries, 3), files._decode_map, formats.MAP_ROWS), (pack_samples(entries), lambda p, f: files._decode(p, f, 128, False), files.PIECE_ROWS)):
        for cut, status in ((0, "Success"), (1, "FileRead")):
            name = str(tmp_path / f"x{cut}")
            with open(name, "wb") as f:
                f.write(data[: len(data) - cut])
            with pa.OSFile(name) as f:
                got = list(decode(name, f))
            assert got[0].num_rows == 1 and got[0].column("status").to_pylist() == [status] and all(b.num_rows <= most for b in got)
            rows = [r for b in got[1:] for r in b.to_pylist()]
            if cut:
                assert not rows
            elif decode is files._decode_map:
                assert [(r["base"], r["end"], r["executable"], r["name"]) for r in rows] == libraries and [r["ord"] for r in rows] == list(range(25_000))
            else:
                assert [(r["addrs"], r["count"]) for r in rows] == entries and [r["entry_ord"] for r in rows] == list(range(120_000))


def test_maps_do_not_pass_through_the_driver(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("rows went to the driver")

    m = spark.range(30_000).selectExpr("cast(30000 - id as int) ord", "id * 10 base", "id * 10 + 5 `end`", "id % 2 = 0 executable", "concat('l', id) name")
    monkeypatch.setattr(type(m), "toLocalIterator", never)
    p = parse_map(open(W.export_map(m, str(tmp_path / "m.libmap"), 42), "rb").read())
    assert p.header["process_id"] == 42 and p.rows == [(i, (29_999 - i) * 10, (29_999 - i) * 10 + 5, i % 2 == 1, f"l{29_999 - i}") for i in range(30_000)]
