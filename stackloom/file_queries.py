"""Queries over what operators write and read: sample files, maps, trees, graphs, logs, streams, executors.

Each writes the driver's tables in a format, to the folder that driver and executors share, reads them back and has SQL
over the tables for the same rows. Samples are the stacks of queries.py: two numbers of a line item, or one address of
the ranges there, by process l_linenumber - 1.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom import api, model
from stackloom import queries as Q
from stackloom.functions import callstack as C
from stackloom.functions.colors import color
from stackloom.model import ColorScheme, ResolveStrategy, SampleCountMode
from stackloom.operators import analysis as A
from stackloom.operators import benchmarks as N
from stackloom.operators import resolve as R
from stackloom.operators import samples as S
from stackloom.operators.symbol_store import SymbolStore
from stackloom.plans.builder import WorkflowBuilder, create_full_analysis_workflow
from stackloom.plans.executor import CachingExecutor, GraphExecutor, ParallelExecutor
from stackloom.plans.nodes import CustomNode, FilterNode, MergeNode, TransformNode, union_all
from stackloom.session import delete_on_exit, ready, scratch_dir
from stackloom.sinks import writers as W
from stackloom.sources import datasource, files, formats
from stackloom.sources.trees import read_trees
from stackloom.streaming.online import OnlineAnalysis

BOTH = SampleCountMode.Both


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the driver's JVM."""
    path = f"{scratch_dir(ready(spark))}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    return delete_on_exit(spark, path)


def put(path: str, data: bytes | str) -> str:
    with W.opened(path, "w" if isinstance(data, str) else "wb") as f:
        f.write(data)
    return path


def base_name(column: str):
    return F.element_at(F.split(column, "/"), -1)


def stored(spark, samples: DataFrame) -> str:
    """A folder with one sample file per process."""
    datasource.register(spark)
    path = folder(spark, "samples")
    samples.select("process_id", "addrs", "count").repartition("process_id").write.format("pflw").mode("append").save(path)
    return path


def _samples(spark, sf_dir) -> DataFrame:
    return Q._samples(spark, sf_dir, "true")


def _addressed(spark, sf_dir) -> DataFrame:
    return Q._addresses(spark, sf_dir).groupBy("process_id", "address").agg(F.count("*").alias("count")).select("process_id", F.array("address").alias("addrs"), "count")


def _maps(spark, sf_dir) -> str:
    """A folder with the library maps of processes 0 to 3."""
    path, ranges = folder(spark, "maps"), Q._ranges(spark, sf_dir)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(inheritable_thread_target(spark)(lambda p: W.export_map(ranges.where(F.col("process_id") == p), f"{path}/rank_{p}.libmap", p)), range(4)))
    return path


def _names(spark, path: str, glob: str) -> list[tuple[str, int]]:
    """(path, rank) of the files of a folder: one row for each of a few processes."""
    return [(r["path"], r["rank"]) for r in files.list_files(spark, path, glob).select("path", "rank").collect()]


def _read_back(spark, sf_dir):
    return Q._entries(files.read_samples(spark, stored(spark, _samples(spark, sf_dir)), glob="*.pflw")[0])


def _source(spark, sf_dir, order="root_first"):
    return Q._entries(spark.read.format("pflw").option("frame_order", order).load(stored(spark, _samples(spark, sf_dir))))


def _headers(spark, sf_dir):
    found = files.read_headers(spark, stored(spark, _samples(spark, sf_dir)), "*.pflw")
    return found.select(files.rank_of(F.col("file")).alias("process_id"), "status", "version", "compression", "entry_count", "max_depth")


def _repeated(spark, sf_dir):
    """Files in which a stack comes once for each return flag, in that order, as entries of their own; one of them is broken."""
    datasource.register(spark)
    rows = Q._table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("process_id"), F.array(F.col("l_suppkey"), F.col("l_partkey") % 4).alias("addrs"), "l_returnflag").agg(F.count("*").alias("count"))
    path = folder(spark, "repeated")
    rows.repartition("process_id").sortWithinPartitions("process_id", "l_returnflag").select("process_id", "addrs", "count").write.format("pflw").mode("append").save(path)
    put(f"{path}/rank_99.pflw", formats.pack_samples([([1], 1)])[:-1])
    return path


def _last_counts(spark, sf_dir):
    """By the source: last counts of repeated stacks, and the status of each file."""
    told = spark.read.format("pflw").option("badFiles", "report").load(_repeated(spark, sf_dir))
    return told.select("process_id", F.coalesce(F.array_join(F.transform("addrs", lambda a: a.cast("string")), ","), F.lit("")).alias("addrs"), F.coalesce("count", F.lit(0)).alias("count"), "status")


def _in_parts(spark, sf_dir):
    """The same files read by several tasks each, with a filter that the source takes whole."""
    found = files.entries_where(spark, _repeated(spark, sf_dir), F.col("process_id").between(1, 4), duplicates="all", splitBytes=str(64 << 10))
    return Q._entries(files.last_entries(files.number_entries(found)))


def _predicate(spark, sf_dir):
    """Nodes by a function of a node, asked of those alone that meet the other conditions."""
    node = FilterNode(min_samples=20, predicate=lambda n: n.depth % 2 == 1 and len(n.function_name) > 6)
    return node.execute({"tree": _tree(spark, sf_dir)})["nodes"].select("function_name", "depth", "total_samples", "is_leaf")


def _header_source(spark, sf_dir):
    path = stored(spark, _samples(spark, sf_dir))
    return spark.read.format("pflw").option("headerOnly", "true").load(path).select(files.rank_of(F.col("file")).alias("process_id"), "status", "entry_count")


def _overwritten(spark, sf_dir):
    """A second write that overwrites leaves its own rows alone."""
    path, samples = stored(spark, _samples(spark, sf_dir)), _samples(spark, sf_dir).where("process_id < 3")
    samples.select("process_id", "addrs", "count").repartition(2).write.format("pflw").mode("overwrite").save(path)
    return Q._entries(spark.read.format("pflw").load(path))


def _statuses(spark, sf_dir):
    """Good and broken sample files, made of the first stacks of process 0."""
    rows = [(r["addrs"], r["count"]) for r in _samples(spark, sf_dir).where("process_id = 0").orderBy("addrs").limit(5).collect()]
    good, path = formats.pack_samples(rows), folder(spark, "broken")
    deep = formats.pack_samples([(list(range(129)), 1)], max_depth=129)
    kernel = formats.pack_samples([([0xFFFFFFFFFF600010, 1], 3)])
    cases = {"good": good, "empty": formats.pack_samples([]), "short": good[:-1], "none": good[:10], "magic": b"X" * 80, "deep": deep, "kernel": kernel}
    cases["newer"] = good[:4] + b"\x02\x00" + good[6:]
    cases["packed"] = good[:6] + b"\x01" + good[7:]
    for name, data in cases.items():
        put(f"{path}/{name}_rank_1.pflw", data)
    samples, status = files.read_samples(spark, path, glob="*.pflw")
    count = samples.groupBy("file").agg(F.sum("count").alias("samples"))
    return status.join(count, "file", "left").select(F.split(base_name("file"), "_")[0].alias("name"), "status", "rows", F.coalesce("samples", F.lit(0)).alias("samples"))


_FIRST = f"WITH {Q._counted('true', 'a')}, f AS (SELECT CAST(sum(count) AS BIGINT) AS n FROM (SELECT count FROM a WHERE process_id = 0 ORDER BY CAST(split_part(addrs, ',', 1) AS BIGINT), CAST(split_part(addrs, ',', 2) AS BIGINT) LIMIT 5))"


def _map_rows(df: DataFrame) -> DataFrame:
    return df.select("process_id", "ord", F.col("base").alias("low"), F.col("end").alias("high"), "executable", "name")


_MAP_SQL = Q._RESOLVED + 'SELECT CAST(pid AS BIGINT) AS process_id, CAST(row_number() OVER (PARTITION BY pid ORDER BY ord) - 1 AS INTEGER) AS ord, base AS low, fin AS high, exe AS executable, name FROM ranges'


def _named_maps(spark, sf_dir):
    """Maps under each of the names that they may have, one rank with several, one without any."""
    path = folder(spark, "named")
    for name in ("rank_0.libmap", "process_0.libmap", "process_1.libmap", "1.libmap", "2.libmap", "rank_x.libmap"):
        put(f"{path}/{name}", formats.pack_map([], 7))
    for p in range(4):
        put(f"{path}/perf_rank_{p}.pflw", formats.pack_samples([([p], 1)]))
    listed = files.list_files(spark, path)
    pairs = files.pair_files(listed.where("file_type = 'sample_data'"), listed.where("file_type = 'library_map'"))
    return pairs.select(base_name("path").alias("sample"), "rank", base_name("map_path").alias("map"))


def _process_maps(spark, sf_dir):
    """Text of a process's maps from parts: executable or not, named or not, one kernel page, one line of nonsense."""
    p = Q._table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    low = F.col("p_partkey") * 8192 + F.when(F.col("p_partkey") % 2 == 0, F.lit(0x7F0000000000)).otherwise(0)
    line = F.concat(F.format_string("%x-%x r-", low, low + 4096), F.when(F.col("p_partkey") % 7 != 0, "xp").otherwise("-p"), F.lit(" 00000000 08:01 12 "), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("  /lib/a b "), F.col("p_partkey").cast("string"))))
    rows = [r[0] for r in p.orderBy("p_partkey").select(line).toLocalIterator()]
    path = put(f"{folder(spark, 'proc')}/maps", "\n".join([*rows, "nonsense", "ffffffffff600000-ffffffffff601000 --xp 00000000 00:00 0                  [vsyscall]", ""]))
    return _map_rows(files.read_process_maps(spark, path, 5))


def _kernel_addresses(spark, sf_dir):
    """Addresses around a range beyond 2^63 and one that crosses it; both ways of joining give the same."""
    signed = formats.signed
    rows = [(0, 0, 0x1000, 0x2000, True, "low"), (0, 1, signed(0xFFFFFFFFFF600000), signed(0xFFFFFFFFFF601000), True, "[vsyscall]"), (0, 2, (1 << 63) - 4096, signed((1 << 63) + 4096), True, "across")]
    maps = spark.createDataFrame(rows, model.LIB_MAP)
    asked = [0xFFF, 0x1000, 0xFFFFFFFFFF600000, 0xFFFFFFFFFF600FFF, 0xFFFFFFFFFF601000, (1 << 63) - 1, 1 << 63, (1 << 63) + 4095, (1 << 63) + 4096, (1 << 64) - 1]
    df = spark.createDataFrame([(0, signed(a)) for a in asked], "process_id long, address long")
    some = [R.resolve_addresses(df, maps, n).select(F.lit(n == 0).alias("bucketed"), C.hex_address(F.col("address"), 16).alias("address"), "library_name", C.hex_address(F.col("offset")).alias("offset")) for n in (2_000, 0)]
    return some[0].unionByName(some[1])


_KERNEL = "VALUES ('0x0000000000000fff', '[unresolved]', '0xfff'), ('0x0000000000001000', 'low', '0x1000'), ('0xffffffffff600000', '[vsyscall]', '0x0'), ('0xffffffffff600fff', '[vsyscall]', '0xfff'), ('0xffffffffff601000', '[unresolved]', '0xffffffffff601000'), ('0x7fffffffffffffff', 'across', '0xfff'), ('0x8000000000000000', 'across', '0x1000'), ('0x8000000000000fff', 'across', '0x1fff'), ('0x8000000000001000', '[unresolved]', '0x8000000000001000'), ('0xffffffffffffffff', '[unresolved]', '0xffffffffffffffff')"


def _builder(spark, sf_dir) -> api.TreeBuilder:
    b = api.TreeBuilder(count_mode=BOTH, spark=spark)
    b.load_library_maps(_names(spark, _maps(spark, sf_dir), "*.libmap"))
    b.build_from_files(_names(spark, stored(spark, _addressed(spark, sf_dir)), "*.pflw"))
    return b


def _flat(tree) -> DataFrame:
    return tree.nodes.select("function_name", "library_name", "depth", "total_samples", "self_samples")


_FLAT_SQL = Q._RESOLVED + """, c AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_partkey * 4096 + l_suppkey % 5000 + CASE WHEN l_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS address, count(*) AS n FROM lineitem GROUP BY ALL),
t AS (SELECT CASE WHEN library_name = '[unknown]' THEN '[unknown]' ELSE '' END AS function_name, library_name, CAST(sum(n) AS BIGINT) AS n FROM r JOIN c USING (process_id, address) GROUP BY ALL) """
_FLAT = _FLAT_SQL + "SELECT function_name, library_name, 1 AS depth, n AS total_samples, n AS self_samples FROM t UNION ALL SELECT '[root]', '[virtual]', 0, CAST(sum(n) AS BIGINT), 0 FROM t"


def _analyzed(spark, sf_dir):
    got = api.analyze_samples(_names(spark, stored(spark, _addressed(spark, sf_dir)), "*.pflw"), _names(spark, _maps(spark, sf_dir), "*.libmap"), 7, spark=spark)
    return got["hotspots"].select("function_name", "library_name", "self_samples")


def _online(spark, sf_dir, replace=False) -> OnlineAnalysis:
    """Samples first, maps after them; in replace mode each process has reported other samples before."""
    data, samples = folder(spark, "watched"), _addressed(spark, sf_dir).select("process_id", "addrs", "count")
    datasource.register(spark)
    o = OnlineAnalysis(spark, data, folder(spark, "state"), count_mode=BOTH, replace=replace)
    if replace:
        other = samples.select("process_id", F.array(*map(F.lit, (1, 2, 3))).cast("array<long>").alias("addrs"), F.lit(99).cast("long").alias("count")).distinct()
        other.repartition("process_id").write.format("pflw").mode("append").save(data)
        o.start(None).awaitTermination(300)
    samples.repartition("process_id").write.format("pflw").mode("overwrite").save(data)
    o.start(None).awaitTermination(300)
    for p in range(4):
        W.export_map(Q._ranges(spark, sf_dir).where(F.col("process_id") == p), f"{data}/process_{p}.libmap", 99)
    o.start(None).awaitTermination(300)
    return o


def _online_events(spark, sf_dir):
    told: list[tuple] = []
    data = folder(spark, "watched")
    o = OnlineAnalysis(spark, data, folder(spark, "state"))
    o.set_file_callback(lambda path, kind, new: told.append((path.rsplit("/", 1)[1], kind, new)))
    put(f"{data}/a_rank_0.pflw", formats.pack_samples([([1], 2)]))
    put(f"{data}/notes.md", "nothing")
    o.scan()
    put(f"{data}/rank_0.libmap", formats.pack_map([], 0))
    o.scan()
    o.scan()
    return spark.createDataFrame(told, "name string, kind string, is_new boolean")


def _online_summary(spark, sf_dir):
    s = _online(spark, sf_dir).summary()
    return spark.createDataFrame([(s["files"], s["processes"], s["samples"], s["nodes"])], "files long, processes long, samples long, nodes long")


def _online_metrics(spark, sf_dir):
    """What was observed of each batch: samples and a broken file, then samples in place of those of processes 0 and 1."""
    data, samples = folder(spark, "watched"), _addressed(spark, sf_dir).select("process_id", "addrs", "count")
    datasource.register(spark)
    o = OnlineAnalysis(spark, data, folder(spark, "state"), replace=True)
    samples.repartition("process_id").write.format("pflw").mode("append").save(data)
    put(f"{data}/rank_99.pflw", formats.pack_samples([([1], 1)])[:-1])
    o.start(None).awaitTermination(300)
    samples.where("process_id < 2").withColumn("count", F.col("count") * 3).repartition("process_id").write.format("pflw").mode("append").save(data)
    o.start(None).awaitTermination(300)
    return spark.createDataFrame([(m["batch_id"], m["files"], m["bad_files"], m["samples"], m["entries"]) for m in o.metrics], "batch_id long, files long, bad_files long, samples long, entries long")


def _tree(spark, sf_dir):
    return Q._tree(spark, sf_dir)


_RANKED = Q._ORDER + """, v AS (SELECT *, row_number() OVER (ORDER BY o) - 1 AS no, CASE WHEN depth = 0 THEN '[virtual]' ELSE split_part(string_split(path, '>')[depth], '@', 2) END AS lib,
  CASE WHEN depth = 0 THEN NULL ELSE array_to_string(string_split(path, '>')[1:depth - 1], '>') END AS up FROM chain) """


def _tree_file(spark, sf_dir):
    n = read_trees(spark, W.export_tree(_tree(spark, sf_dir), f"{folder(spark, 'tree')}/t.ptree"))
    time = F.aggregate("times", F.lit(0.0), lambda a, x: a + x)
    return n.select("node", "parent", F.col("total_samples").alias("total"), F.col("self_samples").alias("own"), F.col("function_name").alias("function"), F.col("library_name").alias("library"), F.col("child_count").cast("long").alias("children"), F.array_join(F.col("samples").cast("array<string>"), ",").alias("by_process"), time.alias("time_us"))


def _lines(spark, path: str, skip: int) -> DataFrame:
    """(no, line) of one small text file after its heading."""
    rows = spark.read.text(path).coalesce(1).withColumn("at", F.monotonically_increasing_id())
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1 - skip).cast("long").alias("no"), F.col("value").alias("line")).where("no >= 0")


def _tree_text(spark, sf_dir):
    return _lines(spark, W.export_tree_text(_tree(spark, sf_dir), f"{folder(spark, 'tree')}/t.txt", 0), 6)


def _dot(spark, sf_dir):
    return _lines(spark, W.generate_dot(_tree(spark, sf_dir), f"{folder(spark, 'tree')}/t.dot", ColorScheme.Grayscale), 4)


def _dot_nodes(spark, sf_dir):
    part = lambda i: F.regexp_extract("line", r'^  node(\d+) \[label="(.*)\\n\[(\d+) samples, [0-9.]+%\]", fillcolor="(.*)"\];$', i)
    return _dot(spark, sf_dir).where("line like '%fillcolor%'").select(part(1).cast("long").alias("node"), part(2).alias("name"), part(3).cast("long").alias("samples"), part(4).alias("fill"))


def _samples_text(spark, sf_dir):
    some = _samples(spark, sf_dir).where("process_id = 2").withColumn("entry_ord", F.col("addrs")[0] * 10 + F.col("addrs")[1])
    lines = _lines(spark, W.export_samples_text(some, f"{folder(spark, 'text')}/s.txt", 0), 11)
    return lines.where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


def _map_text(spark, sf_dir):
    return _lines(spark, W.export_map_text(Q._ranges(spark, sf_dir).where("process_id = 1"), f"{folder(spark, 'text')}/m.txt", 1, 0), 8)


def _hotspots_json(spark, sf_dir):
    stacks = Q.stacks(spark, sf_dir)
    total = stacks.agg(F.sum("count")).first()[0]
    path = W.export_hotspots_json(A.flat_hotspots(stacks), total, f"{folder(spark, 'json')}/run.json")
    return files.read_hotspots_json(spark, path).drop("run_id", "filename", "line_number")


def _overheads(spark, sf_dir) -> DataFrame:
    r = Q._runs(spark, sf_dir)
    rows = N.overhead(r.where("not base"), Q._whole_percent(N.baseline_times(r.where("base"))))
    return rows.select("benchmark", "class", "num_processes", F.col("iteration").cast("int").alias("iteration"), "execution_time_sec", F.lit(0.0).alias("baseline_time_sec"), F.when(F.col("iteration") % 5 != 0, F.col("overhead_percent")).alias("overhead_percent"), F.lit(1.5).alias("mop_total"), F.lit(0.25).alias("mop_per_sec"))


_OVERHEADS = Q._OVERHEAD + " SELECT benchmark, class, num_processes, CAST(iteration AS INTEGER) AS iteration, execution_time_sec, CASE WHEN iteration % 5 <> 0 THEN overhead_percent END AS overhead_percent, CAST(1.5 AS DOUBLE) AS mop_total, CAST(0.25 AS DOUBLE) AS mop_per_sec FROM o"


def _results(spark, sf_dir, kind):
    path = f"{folder(spark, 'results')}/{kind}"
    W.export_results(_overheads(spark, sf_dir), path, kind)
    back = files.read_results_csv(spark, path) if kind == "csv" else spark.read.json(path, schema=files.OVERHEAD_CSV)
    return back.drop("baseline_time_sec")


def _logs(spark, sf_dir):
    """A log of each nation's run; every fourth lacks its time."""
    path = folder(spark, "logs")
    for r in Q._table(spark, sf_dir, "nation").collect():
        time = "" if r["n_nationkey"] % 4 == 0 else f" Time in seconds =            {r['n_nationkey']}.25\n"
        put(f"{path}/cg.C.{r['n_nationkey'] + 1}.{r['n_regionkey']}.out", f" {r['n_name']}\n{time} Mop/s total     =      {r['n_nationkey'] * 2}.5\n Mop/s/process   =   1e1\n")
    return files.read_benchmark_output(spark, path).drop("file")


def _run_folders(spark, sf_dir):
    path = folder(spark, "runs")
    for r in Q._table(spark, sf_dir, "nation").collect():
        put_in = f"{path}/ft_C_np{r['n_nationkey'] + 1}_iter{r['n_regionkey']}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(put_in)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
        put(f"{put_in}/rank_0.pflw", formats.pack_samples([]))
    return files.find_runs(spark, path)


def _file_types(spark, sf_dir):
    path = folder(spark, "types")
    for name in ("a_rank_3.pflw", "rank_12.libmap", "t.ptree", "n.txt", "x.bin", "pflw", "b_rank_x.pflw"):
        put(f"{path}/{name}", "abc")
    return files.list_files(spark, path).select(base_name("path").alias("name"), "length", "file_type", "rank")


def _child(spark, sf_dir):
    t = _tree(spark, sf_dir).stored
    main = t.find_nodes_by_name("main").first()["node_id"]
    some = [t.find_child(main, "ASIA"), t.find_child(main, "ASIA", "libregion.so"), t.find_child(main, "ASIA", "libnation.so"), t.find_child(main, "no such")]
    out = [x.select(F.lit(i).alias("asked"), Q.path_text().alias("path"), "total_samples") for i, x in enumerate(some)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _colors(scheme):
    def run(spark, sf_dir):
        n = _tree(spark, sf_dir).nodes
        return n.select(Q.path_text().alias("path"), color((F.col("total_samples") * 37) % 1000, F.lit(999), scheme).alias("color"))

    return run


def _color_sql(red: str, green: str, blue: str) -> str:
    byte = lambda c: f"lpad(lower(to_hex(CAST(trunc({c}) AS BIGINT))), 2, '0')"
    return Q._nodes() + f", x AS (SELECT path, CAST(total_samples * 37 % 1000 AS DOUBLE) / 999 AS x FROM t), h AS (SELECT path, x, (1.0 - x) * CAST(270.0 AS DOUBLE) AS hue FROM x), y AS (SELECT *, (1.0 - abs(fmod(hue / 60.0, CAST(2.0 AS DOUBLE)) - 1.0)) * 255 AS ramp FROM h) SELECT path, '#' || {byte(red)} || {byte(green)} || {byte(blue)} AS color FROM y"


_HEAT = _color_sql("CASE WHEN x < 0.5 THEN 0.0 WHEN x < 0.75 THEN (x - 0.5) * 4 * 255 ELSE 255.0 END", "CASE WHEN x < 0.25 THEN x * 4 * 255 WHEN x < 0.75 THEN 255.0 ELSE (1.0 - x) * 4 * 255 END", "CASE WHEN x < 0.25 THEN 255.0 WHEN x < 0.5 THEN (0.5 - x) * 4 * 255 ELSE 0.0 END")
_RAINBOW = _color_sql("CASE WHEN hue < 60 THEN 255.0 WHEN hue < 120 THEN ramp WHEN hue < 240 THEN 0.0 ELSE ramp END", "CASE WHEN hue < 60 THEN ramp WHEN hue < 180 THEN 255.0 WHEN hue < 240 THEN ramp ELSE 0.0 END", "CASE WHEN hue < 120 THEN 0.0 WHEN hue < 180 THEN ramp ELSE 255.0 END")


def _places(spark, sf_dir):
    p = Q._table(spark, sf_dir, "part")
    file, line = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_brand")), F.when(F.col("p_partkey") % 4 == 0, F.lit(0)).otherwise(F.col("p_size"))
    return p.select("p_partkey", C.source_location(file, line).alias("place"), C.function_key(F.col("p_name"), file, line).alias("key"))


def _excluded(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in ("domain_solve", "main", "_start", "my_papi_call", "solve", "Main")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    p = Q._table(spark, sf_dir, "part").select(name.alias("name"))
    return p.select("name", A.excluded(F.col("name")).alias("loose"), A.excluded(F.col("name"), exact=True).alias("exact")).groupBy("name", "loose", "exact").agg(F.count("*").alias("n"))


def _graph(spark, sf_dir) -> WorkflowBuilder:
    w = WorkflowBuilder("Q").load_data(stacks=Q.stacks(spark, sf_dir), spark=spark).find_hotspots(10).find_hotspots(10, "total", "TotalHotspots").analyze_balance()
    w.add_node(MergeNode(["own", "all"], union_all)).connect("hotspotanalysis", "merge", source_port="hotspots", target_port="own").connect("totalhotspots", "merge", source_port="hotspots", target_port="all")
    w.add_node(TransformNode(lambda df: df.where("source = 'all'"))).connect("merge", "transform", source_port="merged", target_port="input")
    w.add_node(CustomNode(lambda x: {"counted": x["rows"].groupBy("library_name").agg(F.count("*").alias("n"))}, {"rows": "DataFrame"}, {"counted": "DataFrame"})).connect("transform", "custom", source_port="output", target_port="rows")
    return w


def _executed(executor, name, port, times=1):
    def run(spark, sf_dir):
        w, e = _graph(spark, sf_dir), executor()
        for _ in range(times):
            out = w.execute(e)
        return out[w.get_node(name).node_id][port]

    return run


def _cache_statistics(spark, sf_dir):
    w, e = _graph(spark, sf_dir), CachingExecutor(parallel=True, max_workers=4)
    w.execute(e)
    w.execute(e)
    s = e.get_cache_stats()
    e.clear_cache()
    return spark.createDataFrame([(s["size"], s["hits"], s["misses"], s["hit_rate"])], "size long, hits long, misses long, hit_rate double")


def _levels(spark, sf_dir):
    g = _graph(spark, sf_dir).build()
    rows = [(i, n.name, len(g.get_predecessors(n)), len(g.get_successors(n))) for i, group in enumerate(g.get_parallel_groups()) for n in group]
    return spark.createDataFrame(rows, "level long, name string, before long, after long")


def _visited(spark, sf_dir):
    seen: list[tuple] = []
    api.traverse_tree(_tree(spark, sf_dir), lambda r: (seen.append((r["function_name"], r["depth"], r["total_samples"], r["visit_rank"])), r["function_name"] != "ASIA")[1], "levelorder")
    return spark.createDataFrame(seen, "function_name string, depth int, total_samples long, visit_rank long")


def _traversal_node(spark, sf_dir):
    w = WorkflowBuilder("T").load_data(stacks=Q.stacks(spark, sf_dir), spark=spark).traverse(lambda r: (r["function_name"], r["visit_rank"]) if r["depth"] != 3 else None, "postorder", lambda r: r["function_name"] == "ASIA")
    out = w.execute()[w.get_node("treetraversal").node_id]
    return spark.createDataFrame([(*x, out["visited_count"]) for x in out["results"]], "function_name string, visit_rank long, visited long")


def _full_workflow(spark, sf_dir):
    out = create_full_analysis_workflow(None, None, 5, stacks=Q.stacks(spark, sf_dir), spark=spark).execute(GraphExecutor())
    return Q._hot(next(x["hotspots"] for k, x in out.items() if k.lower().startswith("totalhotspots")))


def _converted(spark, sf_dir):
    c, ranges = R.OffsetConverter(), Q._ranges(spark, sf_dir)
    for p in (0, 1, 2, 3, 3):  # the second of two snapshots replaces the first
        c.add_map_snapshot(p, ranges.where(F.col("process_id") == p))
    s = Q._addresses(spark, sf_dir).distinct().select("process_id", F.col("address").alias("entry_ord"), F.array("address").alias("addrs"), F.lit(1).cast("long").alias("count"))
    x = F.col("frames")[0]
    return c.convert(s).select("process_id", x["raw_address"].alias("address"), x["library_name"].alias("library_name"), x["offset"].alias("offset"))


def _asked(spark, sf_dir):
    x = Q._table(spark, sf_dir, "lineitem")
    return x.select(F.concat(F.lit("lib"), (F.col("l_suppkey") % 3).cast("string")).alias("library_name"), F.col("l_partkey").alias("offset"))


def _tool(spark) -> str:
    """A symbolizer that names every address, but knows those below 0x40 only with the first shift added."""
    path = os.path.join(tempfile.mkdtemp(), "tool")
    with open(path, "w") as f:
        f.write('#!/bin/sh\nwhile read a; do case $a in 0x?|0x[123]?) echo "??"; echo "??:0";; *) echo "f_$a"; echo "$4.c:7";; esac; done\n')
    os.chmod(path, 0o755)
    return path


def _symbolized(spark, sf_dir):
    return R.symbolize(_asked(spark, sf_dir), _tool(spark), statuses=True).withColumnRenamed("offset", "place")


def _fallback(spark, sf_dir):
    """Symbols of the table, and of the symbolizer where the table has none."""
    table = spark.createDataFrame([("lib0", i, "known", "k.c", 1) for i in range(100, 200)], model.SYMBOLS)
    found = R.find_symbols(_asked(spark, sf_dir), table, ResolveStrategy.AutoFallback, _tool(spark))
    return found.select("library", F.col("offset").alias("place"), "function_name")


def _stored_symbols(spark, sf_dir):
    """What a store that was filled in two runs knows of line items: symbols of even parts; of every tenth that it has none."""
    store = SymbolStore(spark, folder(spark, "symbols"))
    k = F.col("p_partkey")
    known = Q._table(spark, sf_dir, "part").where(k % 2 == 0).select(F.concat(F.lit("lib"), (k % 3).cast("string")).alias("library"), k.alias("offset"), F.when(k % 10 != 0, F.col("p_name")).alias("function_name"), F.col("p_brand").alias("filename"), F.col("p_size").alias("line_number"))
    store.add(known.where("line_number <= 25"))
    store.add(known.where("line_number > 20"))
    return store.symbols(_asked(spark, sf_dir), None).withColumnRenamed("offset", "place")


def _symbol_statistics(spark, sf_dir):
    s = _addressed(spark, sf_dir).withColumn("entry_ord", F.col("addrs")[0])
    return R.symbol_statistics(R.resolve_samples(s, Q._ranges(spark, sf_dir), Q._symbols(spark, sf_dir))).withColumn("hit_rate", F.round("hit_rate", 6))


def _symbol_lines(spark, sf_dir):
    cases = [("f", "a:b.c:12 (discriminator 3)"), ("??", "??:0"), ("f", "??:?"), ("??", "a.c:3"), ("g", "a.c:?"), ("", ""), ("h", "nothing")]
    rows = [(i, *(R.parse_addr2line(*c) or ("-", "-", -1))) for i, c in enumerate(cases)]
    return spark.createDataFrame(rows, "no long, function string, file string, line int")


def _table_lines(make):
    def run(spark, sf_dir):
        rows = [(i, x) for i, x in enumerate(make(_tree(spark, sf_dir)).splitlines())]
        return spark.createDataFrame(rows, "no long, line string")

    return run


def _scalars(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return spark.createDataFrame([(t.node_count, t.max_depth, t.total_samples, t.process_count, t.total_execution_time)], "nodes long, depth long, samples long, processes long, time_us double")


def _calls(spark, sf_dir):
    t = _tree(spark, sf_dir)
    rows = {r["function_name"]: r for r in t.nodes.where("depth <= 2").select("function_name", "node_id", "parent_id").collect()}
    out = [(n, t.call_count(rows["main"]["node_id"], rows[n]["node_id"]), t.node_samples(rows[n]["node_id"], 1)[0], t.node_samples(rows[n]["node_id"], 99)[0]) for n in ("ASIA", "EUROPE")]
    return spark.createDataFrame(out, "name string, calls long, in_one long, in_none long")


def _far_process(spark, sf_dir):
    """Balance with a process of id 2^32 - 1."""
    s = Q.event_stacks(spark, sf_dir)
    far = s.where("process_id = 1").limit(1).withColumn("process_id", F.lit(4294967295).cast("long")).withColumn("count", F.lit(3).cast("long"))
    b = A.balance(Q.build_tree(s.where("process_id <> 2").unionByName(far)))
    return b.select(F.round("mean_samples", 12).alias("mean_samples"), "min_samples", "max_samples", "most_loaded_process", "least_loaded_process", F.col("process_samples").isNull().alias("unlisted"))


def _upserted(spark, sf_dir):
    """Entries in place of old ones; of equal keys the last by order number counts, not the largest."""
    x = Q._table(spark, sf_dir, "lineitem").where(Q._NEW).select((F.col("l_linenumber") - 1).cast("long").alias("process_id"), F.array(F.col("l_suppkey"), F.col("l_partkey") % 4).alias("addrs"), F.col("l_quantity").cast("long").alias("count"), (F.col("l_orderkey") * 100 + F.col("l_quantity").cast("long")).alias("entry_ord"))
    return Q._entries(S.upsert(Q._samples(spark, sf_dir, Q._OLD), x))


def _leaf_first(spark, sf_dir):
    """Trees of samples whose leaf comes first."""
    s = _samples(spark, sf_dir).withColumn("addrs", F.reverse("addrs")).withColumn("entry_ord", F.xxhash64("addrs"))
    maps = spark.createDataFrame([(p, 0, 0, 1 << 40, True, "all") for p in range(7)], model.LIB_MAP)
    t = Q.build_tree(R.resolve_samples(s, maps, None, "leaf_first"), Q.CA, BOTH)
    return t.nodes.where("depth > 0").select(F.array_join(F.transform("path", lambda k: k["offset"].cast("string")), ",").alias("path"), "depth", "total_samples", "self_samples")


_PAIRS = f"WITH {Q._counted('true', 'a')}"
_LAST = "WITH y AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_suppkey || ',' || l_partkey % 4 AS addrs, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY ALL), z AS (SELECT process_id, addrs, CAST(arg_max(n, flag) AS BIGINT) AS count FROM y GROUP BY ALL)"
_VISIT = "row_number() OVER (ORDER BY depth, o) AS visit_rank"


def _all():
    q = Q._q
    rows_a = f"{_PAIRS} SELECT * FROM a"
    hot = Q._nodes() + f"SELECT {Q._HOT} FROM t WHERE depth > 0 ORDER BY total_samples DESC, path LIMIT "
    own_hot = Q._nodes() + f"SELECT {Q._HOT} FROM t WHERE depth > 0 AND self_samples > 0 ORDER BY self_samples DESC, path LIMIT 10"
    return dict(
        [
            q("pflw_files", _read_back, rows_a),
            q("pflw_source", _source, rows_a),
            q("pflw_leaf_first", lambda s, d: _source(s, d, "leaf_first"), f"{_PAIRS} SELECT process_id, split_part(addrs, ',', 2) || ',' || split_part(addrs, ',', 1) AS addrs, count FROM a"),
            q("pflw_headers", _headers, f"{_PAIRS} SELECT process_id, 'Success' AS status, 1 AS version, 0 AS compression, count(*) AS entry_count, CAST(128 AS BIGINT) AS max_depth FROM a GROUP BY process_id"),
            q("pflw_header_source", _header_source, f"{_PAIRS} SELECT process_id, 'Success' AS status, count(*) AS entry_count FROM a GROUP BY process_id"),
            q("pflw_repeated", _last_counts, f"{_LAST} SELECT process_id, addrs, count, 'Success' AS status FROM z UNION ALL SELECT 99, '', 0, 'FileRead'"),
            q("pflw_parts", _in_parts, f"{_LAST} SELECT * FROM z WHERE process_id BETWEEN 1 AND 4"),
            q("pflw_overwrite", _overwritten, f"{_PAIRS} SELECT * FROM a WHERE process_id < 3"),
            q("pflw_statuses", _statuses, f"{_FIRST} SELECT name, status, CAST(n AS BIGINT) AS \"rows\", CASE name WHEN 'good' THEN (SELECT n FROM f) WHEN 'kernel' THEN 3 ELSE 0 END AS samples FROM (VALUES ('good', 'Success', 5), ('empty', 'Success', 0), ('short', 'FileRead', 0), ('none', 'FileRead', 0), ('magic', 'InvalidFormat', 0), ('deep', 'Integrity', 0), ('kernel', 'Success', 1), ('newer', 'VersionMismatch', 0), ('packed', 'Compression', 0)) v(name, status, n)"),
            q("libmap_files", lambda s, d: _map_rows(files.read_maps(s, _maps(s, d), glob="*.libmap")), _MAP_SQL),
            q("libmap_source", lambda s, d: (datasource.register(s), _map_rows(s.read.format("libmap").load(_maps(s, d))))[1], _MAP_SQL),
            q("libmap_names", _named_maps, "SELECT 'perf_rank_' || r || '.pflw' AS sample, CAST(r AS BIGINT) AS rank, m AS map FROM (VALUES (0, 'rank_0.libmap'), (1, 'process_1.libmap'), (2, '2.libmap'), (3, NULL)) v(r, m)"),
            q("process_maps", _process_maps, "WITH p AS (SELECT p_partkey AS k, p_partkey * 8192 + CASE WHEN p_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS low FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 <> 0), o AS (SELECT low, low + 4096 AS high, CASE WHEN k % 5 = 0 THEN '[anonymous]' ELSE '/lib/a b ' || k END AS name, k FROM p UNION ALL SELECT -10485760, -10481664, '[vsyscall]', 9223372036854775807) SELECT CAST(5 AS BIGINT) AS process_id, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ord, low, high, true AS executable, name FROM o"),
            q("kernel_addresses", _kernel_addresses, f"SELECT bucketed, v.* FROM ({_KERNEL}) v(address, library_name, \"offset\"), (VALUES (true), (false)) b(bucketed)"),
            q("build_from_files", lambda s, d: _flat(_builder(s, d).tree), _FLAT),
            q("build_status", lambda s, d: _builder(s, d).file_status.groupBy("status").agg(F.count("*").alias("files"), F.sum("rows").alias("entries")), Q._RESOLVED + "SELECT 'Success' AS status, count(DISTINCT process_id) AS files, count(*) AS entries FROM a"),
            q("analyze_files", _analyzed, _FLAT_SQL + "SELECT function_name, library_name, n AS self_samples FROM t ORDER BY n DESC, function_name, library_name LIMIT 7"),
            q("online_tree", lambda s, d: _flat(_online(s, d).tree), _FLAT),
            q("online_replaced", lambda s, d: _flat(_online(s, d, True).tree), _FLAT),
            q("online_balance", lambda s, d: Q._balance(_online(s, d).balance()), Q._balance_sql("WITH counts AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS pid, count(*) AS c FROM lineitem GROUP BY 1)")),
            q("online_files", _online_events, "SELECT * FROM (VALUES ('a_rank_0.pflw', 'sample_data', true), ('rank_0.libmap', 'library_map', true)) v(name, kind, is_new)"),
            q("online_summary", _online_summary, _FLAT_SQL + "SELECT CAST(11 AS BIGINT) AS files, (SELECT max(process_id) + 1 FROM a) AS processes, CAST(sum(n) AS BIGINT) AS samples, count(*) + 1 AS nodes FROM t"),
            q("online_metrics", _online_metrics, "WITH a AS (SELECT l_linenumber - 1 AS p, l_partkey * 4096 + l_suppkey % 5000 + CASE WHEN l_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS address, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(0 AS BIGINT) AS batch_id, count(DISTINCT p) + 1 AS files, CAST(1 AS BIGINT) AS bad_files, CAST(sum(n) AS BIGINT) AS samples, count(*) AS entries FROM a UNION ALL SELECT 1, count(DISTINCT p), 0, CAST(2 * sum(n) AS BIGINT), 2 * count(*) FROM a WHERE p < 2"),
            q("tree_file", _tree_file, _RANKED + ", k AS (SELECT up, depth - 1 AS d, count(*) AS c FROM v WHERE depth > 0 GROUP BY ALL), y AS (SELECT path, depth, string_agg(CAST(coalesce(visits, 0) AS VARCHAR), ',' ORDER BY g.pid) AS s FROM (SELECT DISTINCT path, depth FROM n) x CROSS JOIN (SELECT DISTINCT pid FROM n) g LEFT JOIN n USING (path, depth, pid) GROUP BY ALL) SELECT v.no AS node, coalesce(p.no, 0) AS parent, v.total_samples AS total, v.self_samples AS own, v.function_name AS \"function\", v.lib AS library, coalesce(k.c, 0) AS children, y.s AS by_process, CAST(v.total_samples * 1000.0 AS DOUBLE) AS time_us FROM v LEFT JOIN v p ON p.path = v.up AND p.depth = v.depth - 1 LEFT JOIN k ON k.up = v.path AND k.d = v.depth LEFT JOIN y ON y.path = v.path AND y.depth = v.depth"),
            q("tree_text", _tree_text, _RANKED + "SELECT no, repeat('  ', depth) || '[' || total_samples || ' samples, ' || self_samples || ' self] ' || function_name || CASE WHEN depth = 0 THEN '' ELSE ' (' || lib || ')' END AS line FROM v"),
            q("dot_nodes", _dot_nodes, _RANKED + f"SELECT no AS node, function_name AS name, total_samples AS samples, '#' || repeat(lpad(lower(to_hex(CAST(trunc((1.0 - CAST(total_samples AS DOUBLE) / {Q._SUM}) * 255) AS BIGINT))), 2, '0'), 3) AS fill FROM v"),
            q("dot_edges", lambda s, d: _dot(s, d).where("line like '%->%'").select("line"), _RANKED + "SELECT '  node' || p.no || ' -> node' || v.no || ' [label=\"' || v.total_samples || '\"];' AS line FROM v JOIN v p ON p.path = v.up AND p.depth = v.depth - 1"),
            q("samples_text", _samples_text, f"{_PAIRS}, x AS (SELECT '[' || count || '] Call Stack (depth: 2)' AS line FROM a WHERE process_id = 2 UNION ALL SELECT '  0x' || lpad(lower(to_hex(CAST(unnest(string_split(addrs, ',')) AS BIGINT))), 16, '0') FROM a WHERE process_id = 2) SELECT line, count(*) AS n FROM x GROUP BY line"),
            q("map_text", _map_text, Q._RESOLVED + "SELECT row_number() OVER (ORDER BY ord) - 1 AS no, '[0x' || lpad(lower(to_hex(base)), 16, '0') || ' - 0x' || lpad(lower(to_hex(fin)), 16, '0') || '] (0x' || lower(to_hex(fin - base)) || ' bytes) ' || CASE WHEN exe THEN '[x]' ELSE '[ ]' END || ' ' || name AS line FROM ranges WHERE pid = 1"),
            q("hotspots_json", _hotspots_json, f"WITH {Q._STACKS}, x AS (SELECT c, f[-1] AS leaf, unnest(f) AS fn, unnest(l) AS lib FROM s) SELECT (SELECT CAST(sum(c) AS BIGINT) FROM s) AS total_samples, fn AS function_name, min(lib) AS library_name, CAST(sum(CASE WHEN leaf = fn THEN c ELSE 0 END) AS BIGINT) AS exclusive_samples, CAST(sum(c) AS BIGINT) AS inclusive_samples FROM x WHERE fn <> 'main' GROUP BY fn"),
            q("results_csv", lambda s, d: _results(s, d, "csv"), _OVERHEADS),
            q("results_json", lambda s, d: _results(s, d, "json"), _OVERHEADS),
            q("run_logs", _logs, "SELECT 'cg' AS benchmark, 'C' AS class, CAST(n_nationkey + 1 AS INTEGER) AS num_processes, CAST(n_regionkey AS INTEGER) AS iteration, CAST(CASE WHEN n_nationkey % 4 = 0 THEN 0 ELSE n_nationkey + 0.25 END AS DOUBLE) AS execution_time_sec, CAST(n_nationkey * 2 + 0.5 AS DOUBLE) AS mop_total, CAST(10 AS DOUBLE) AS mop_per_sec FROM nation"),
            q("run_folders", _run_folders, "SELECT 'ft_C_np' || (n_nationkey + 1) || '_iter' || n_regionkey AS run, 'ft' AS benchmark, 'C' AS class, CAST(n_nationkey + 1 AS INTEGER) AS num_processes, CAST(n_regionkey AS INTEGER) AS iteration FROM nation"),
            q("file_types", _file_types, "SELECT name, CAST(3 AS BIGINT) AS length, file_type, CAST(rank AS BIGINT) AS rank FROM (VALUES ('a_rank_3.pflw', 'sample_data', 3), ('rank_12.libmap', 'library_map', 12), ('t.ptree', 'performance_tree', -1), ('n.txt', 'text', -1), ('x.bin', 'unknown', -1), ('pflw', 'unknown', -1), ('b_rank_x.pflw', 'sample_data', -1)) v(name, file_type, rank)"),
            q("find_child", _child, Q._nodes() + "SELECT i AS asked, path, total_samples FROM t, (VALUES (0), (1)) a(i) WHERE parent = 'main@app' AND function_name = 'ASIA'"),
            q("color_heatmap", _colors(ColorScheme.Heatmap), _HEAT),
            q("color_rainbow", _colors(ColorScheme.Rainbow), _RAINBOW),
            q("source_places", _places, "WITH p AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS f, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS n FROM part), w AS (SELECT *, CASE WHEN f <> '' AND n > 0 THEN f || ':' || n ELSE '' END AS place FROM p) SELECT p_partkey, place, CASE WHEN place <> '' THEN p_name || ' (' || place || ')' ELSE p_name END AS key FROM w"),
            q("excluded_names", _excluded, "SELECT name, loose, exact, count(*) AS n FROM part JOIN (VALUES (0, 'domain_solve', true, false), (1, 'main', true, true), (2, '_start', true, true), (3, 'my_papi_call', true, false), (4, 'solve', false, false), (5, 'Main', false, false)) v(i, name, loose, exact) ON p_partkey % 6 = i GROUP BY ALL"),
            q("parallel_executor", lambda s, d: Q._hot(_executed(lambda: ParallelExecutor(4), "totalhotspots", "hotspots")(s, d)), hot + "10"),
            q("caching_executor", lambda s, d: Q._hot(_executed(CachingExecutor, "hotspotanalysis", "hotspots", 2)(s, d)), own_hot),
            q("merged_ports", lambda s, d: _executed(GraphExecutor, "merge", "merged")(s, d).select("source", Q.path_text().alias("path"), "total_samples"), Q._nodes() + "SELECT * FROM (SELECT 'own' AS source, path, total_samples FROM t WHERE depth > 0 AND self_samples > 0 ORDER BY self_samples DESC, path LIMIT 10) UNION ALL SELECT * FROM (SELECT 'all', path, total_samples FROM t WHERE depth > 0 ORDER BY total_samples DESC, path LIMIT 10)"),
            q("transformed_ports", lambda s, d: _executed(lambda: ParallelExecutor(2), "custom", "counted")(s, d), Q._nodes() + "SELECT library_name, count(*) AS n FROM (SELECT * FROM t WHERE depth > 0 ORDER BY total_samples DESC, path LIMIT 10) GROUP BY library_name"),
            q("cache_statistics", _cache_statistics, "SELECT CAST(7 AS BIGINT) AS size, CAST(7 AS BIGINT) AS hits, CAST(7 AS BIGINT) AS misses, CAST(0.5 AS DOUBLE) AS hit_rate"),
            q("graph_levels", _levels, "SELECT CAST(l AS BIGINT) AS level, name, CAST(b AS BIGINT) AS before, CAST(a AS BIGINT) AS after FROM (VALUES (0, 'LoadData', 0, 3), (1, 'HotspotAnalysis', 1, 1), (1, 'TotalHotspots', 1, 1), (1, 'BalanceAnalysis', 1, 0), (2, 'Merge', 2, 1), (3, 'Transform', 1, 1), (4, 'Custom', 1, 0)) v(l, name, b, a)"),
            q("visited_nodes", _visited, Q._ORDER + f", w AS (SELECT *, {_VISIT} FROM chain) SELECT function_name, depth, total_samples, visit_rank FROM w WHERE visit_rank <= (SELECT min(visit_rank) FROM w WHERE function_name = 'ASIA')"),
            q("traversal_node", _traversal_node, Q._ORDER + ", w AS (SELECT *, row_number() OVER (ORDER BY o || [{'p': 9223372036854775807, 'f': '', 'l': ''}]) AS visit_rank FROM chain), l AS (SELECT min(visit_rank) AS n FROM w WHERE function_name = 'ASIA') SELECT function_name, visit_rank, (SELECT n FROM l) AS visited FROM w WHERE visit_rank <= (SELECT n FROM l) AND depth <> 3"),
            q("filter_predicate", _predicate, Q._nodes() + "SELECT function_name, depth, total_samples, NOT EXISTS (SELECT 1 FROM t k WHERE k.parent = t.path AND k.depth = t.depth + 1) AS is_leaf FROM t WHERE total_samples >= 20 AND depth % 2 = 1 AND length(function_name) > 6"),
            q("full_workflow", _full_workflow, hot + "5"),
            q("converted_samples", _converted, Q._RESOLVED + "SELECT * FROM r"),
            q("symbolized", _symbolized, "SELECT DISTINCT 'lib' || l_suppkey % 3 AS library, l_partkey AS place, 'f_0x' || lower(to_hex(l_partkey + CASE WHEN l_partkey < 64 THEN 4096 ELSE 0 END)) AS function_name, 'lib' || l_suppkey % 3 || '.c' AS filename, 7 AS line_number, 'Success' AS status FROM lineitem"),
            q("stored_symbols", _stored_symbols, "SELECT DISTINCT 'lib' || l_partkey % 3 AS library, l_partkey AS place, p_name AS function_name, p_brand AS filename, CAST(p_size AS INTEGER) AS line_number FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 2 = 0 AND l_partkey % 10 <> 0 AND l_suppkey % 3 = l_partkey % 3"),
            q("symbol_fallback", _fallback, "WITH x AS (SELECT DISTINCT 'lib' || l_suppkey % 3 AS library, l_partkey AS place FROM lineitem), k AS (SELECT 'lib0' AS library, CAST(unnest(range(100, 200)) AS BIGINT) AS place) SELECT library, place, 'known' AS function_name FROM k UNION ALL SELECT library, place, 'f_0x' || lower(to_hex(place + CASE WHEN place < 64 THEN 4096 ELSE 0 END)) FROM x WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.library = x.library AND k.place = x.place)"),
            q("symbol_statistics", _symbol_statistics, Q._RESOLVED + ", d AS (SELECT library_name, \"offset\", count(*) AS n, max(CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END) AS y FROM r LEFT JOIN part ON library_name = 'lib' || p_partkey AND \"offset\" = p_partkey % 5000 WHERE library_name NOT IN ('[unknown]', '[unresolved]') GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS lookups, count(*) AS cached, CAST(sum(y) AS BIGINT) AS resolved, round(1 - CAST(count(*) AS DOUBLE) / sum(n), 6) AS hit_rate FROM d"),
            q("symbol_lines", _symbol_lines, "SELECT CAST(i AS BIGINT) AS no, f AS \"function\", p AS file, CAST(n AS INTEGER) AS line FROM (VALUES (0, 'f', 'a:b.c', 12), (1, '-', '-', -1), (2, 'f', '', 0), (3, '', 'a.c', 3), (4, 'g', 'a.c', 0), (5, '-', '-', -1), (6, 'h', '', 0)) v(i, f, p, n)"),
            q("hotspot_table", _table_lines(lambda t: "\n".join(x.split("%")[0].rsplit(" ", 1)[0].rstrip() for x in W.hotspot_table(t, 3, True).splitlines()[5:8])), Q._nodes() + ", h AS (SELECT *, row_number() OVER (ORDER BY total_samples DESC, path) AS i FROM t WHERE depth > 0) SELECT i - 1 AS no, rtrim(rpad(CAST(i AS VARCHAR), 6, ' ') || rpad(left(function_name, 38), 41, ' ') || total_samples) AS line FROM h WHERE i <= 3"),
            q("balance_table", _table_lines(lambda t: W.balance_table(t).splitlines()[3]), Q._nodes() + "SELECT CAST(0 AS BIGINT) AS no, '  Processes:        ' || count(DISTINCT pid) AS line FROM n"),
            q("tree_scalars", _scalars, Q._nodes() + "SELECT count(*) AS nodes, CAST(max(depth) AS BIGINT) AS depth, max(total_samples) AS samples, (SELECT max(pid) + 1 FROM n) AS processes, CAST(max(total_samples) * 1000.0 AS DOUBLE) AS time_us FROM t"),
            q("call_counts", _calls, Q._nodes() + "SELECT fn AS name, CAST(sum(visits) AS BIGINT) AS calls, CAST(sum(CASE WHEN pid = 1 THEN visits ELSE 0 END) AS BIGINT) AS in_one, CAST(0 AS BIGINT) AS in_none FROM n WHERE fn IN ('ASIA', 'EUROPE') GROUP BY fn"),
            q("balance_far_process", _far_process, "WITH c AS (SELECT user_id % 8 AS pid, count(*) AS n FROM events WHERE user_id % 8 <> 2 GROUP BY 1) SELECT round((sum(n) + 3) / 4294967296.0, 12) AS mean_samples, CAST(0 AS DOUBLE) AS min_samples, CAST(max(n) AS DOUBLE) AS max_samples, (SELECT pid FROM c ORDER BY n DESC, pid LIMIT 1) AS most_loaded_process, CAST(2 AS BIGINT) AS least_loaded_process, true AS unlisted FROM c"),
            q("upsert_last", _upserted, f"WITH {Q._counted(Q._OLD, 'a')}, b AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_suppkey || ',' || l_partkey % 4 AS addrs, CAST(arg_max(l_quantity, l_orderkey * 100 + l_quantity) AS BIGINT) AS count FROM lineitem WHERE {Q._NEW} GROUP BY ALL) SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.process_id = b.process_id AND a.addrs = b.addrs)"),
            q("leaf_first_tree", _leaf_first, f"{_PAIRS} SELECT split_part(addrs, ',', 1) AS path, 1 AS depth, CAST(sum(count) AS BIGINT) AS total_samples, CAST(0 AS BIGINT) AS self_samples FROM a GROUP BY ALL UNION ALL SELECT addrs, 2, CAST(sum(count) AS BIGINT), CAST(sum(count) AS BIGINT) FROM a GROUP BY addrs"),
            q("stack_equality", lambda s, d: _samples(s, d).groupBy("addrs").agg(F.count("*").alias("n"), F.countDistinct(C.stack_hash(F.col("addrs"))).alias("h")).agg(F.count("*").alias("stacks"), F.sum("n").alias("entries"), F.max("h").alias("hashes")), f"{_PAIRS} SELECT count(DISTINCT addrs) AS stacks, count(*) AS entries, CAST(1 AS BIGINT) AS hashes FROM a"),
            q("version", lambda s, d: s.createDataFrame([(__import__("stackloom").__version__,)], "version string"), "SELECT '0.1.0' AS version"),
        ]
    )


_ALL = _all()


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ALL.items()}
