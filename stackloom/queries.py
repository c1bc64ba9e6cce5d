"""Every operator over the driver's tables, with SQL that computes the same rows.

The tables hold no stacks, so a bridge makes them: a line item is a sample of the stack main / region / nation /
supplier (the last left out for returned items) in process l_linenumber - 1. Events give a second one: main / type in
process user_id mod 8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import callstack as C
from stackloom.functions.colors import color
from stackloom.model import ROOT, ColorScheme, SampleCountMode, TreeBuildMode
from stackloom.operators import analysis as A
from stackloom.operators import benchmarks as N
from stackloom.operators import samples as S
from stackloom.operators.resolve import resolve_addresses, resolve_samples
from stackloom.operators.tree import Tree, build_tree

CF, CA = TreeBuildMode.ContextFree, TreeBuildMode.ContextAware
BOTH, INC, EXC = SampleCountMode.Both, SampleCountMode.Inclusive, SampleCountMode.Exclusive


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(function, library, offset):
    return F.struct(offset.cast("long").alias("raw_address"), offset.cast("long").alias("offset"), library.alias("library_name"), function.alias("function_name"), F.lit("").alias("filename"), F.lit(0).alias("line_number"))


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge over line items; equal stacks are counted before the dimension joins."""
    t = lambda n: _table(spark, sf_dir, n)
    rows = t("lineitem").groupBy((F.col("l_linenumber") - 1).cast("long").alias("process_id"), "l_suppkey", (F.col("l_partkey") % 4).alias("part"), (F.col("l_returnflag") == "R").alias("returned")).agg(F.count("*").alias("count"))
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = s.select("s_suppkey", "s_name", "n_name", "n_nationkey", "r_name", "r_regionkey")
    lit = F.lit
    frames = [_frame(lit("main"), lit("app"), lit(0)), _frame(F.col("r_name"), lit("libregion.so"), F.col("r_regionkey")), _frame(F.col("n_name"), lit("libnation.so"), F.col("n_nationkey"))]
    deep = _frame(F.col("s_name"), lit("libsupplier.so"), F.col("part"))
    joined = rows.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select("process_id", lit(0).cast("long").alias("entry_ord"), F.when(F.col("returned"), F.array(*frames)).otherwise(F.array(*frames, deep)).alias("frames"), "count")


def event_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("process_id"), "event_type").agg(F.count("*").alias("count"))
    return rows.select("process_id", F.lit(0).cast("long").alias("entry_ord"), F.array(_frame(F.lit("main"), F.lit("app"), F.lit(0)), _frame(F.col("event_type"), F.lit("libevent.so"), F.lit(0))).alias("frames"), "count")


def _tree(spark, sf_dir, build=CF, count=BOTH) -> Tree:
    return build_tree(stacks(spark, sf_dir), build, count)


def path_text(path="path"):
    """A path as one string: levels joined by >, the parts of a level by @ and +."""
    return F.concat_ws(">", F.transform(path, lambda k: F.concat(k["function_name"], F.lit("@"), k["library_name"])))


def _path_ca():
    return F.concat_ws(">", F.transform("path", lambda k: F.concat(k["function_name"], F.lit("@"), k["library_name"], F.lit("+"), k["offset"].cast("string"))))


def _rows(nodes: DataFrame, *more, path=None) -> DataFrame:
    return nodes.select((path if path is not None else path_text()).alias("path"), "depth", "total_samples", "self_samples", *more)


# The bridge in SQL: one row per (process, stack) with its levels as lists.
_STACKS = """
raw AS (
  SELECT CAST(l_linenumber - 1 AS BIGINT) AS pid, r_name, n_name, s_name, r_regionkey, n_nationkey, l_partkey % 4 AS part, l_returnflag = 'R' AS ret, count(*) AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
), s AS (
  SELECT pid, c, ['main@app', r_name || '@libregion.so', n_name || '@libnation.so'] || CASE WHEN ret THEN [] ELSE [s_name || '@libsupplier.so'] END AS k,
    ['main', r_name, n_name] || CASE WHEN ret THEN [] ELSE [s_name] END AS f, ['app', 'libregion.so', 'libnation.so'] || CASE WHEN ret THEN [] ELSE ['libsupplier.so'] END AS l,
    ['main@app+0', r_name || '@libregion.so+' || r_regionkey, n_name || '@libnation.so+' || n_nationkey] || CASE WHEN ret THEN [] ELSE [s_name || '@libsupplier.so+' || part] END AS ka
  FROM raw
)"""


def _nodes(keys: str = "k", total: str = "visits", self_: str = "ends") -> str:
    """CTEs up to n: (pid, path, depth, fn, lib, parent, visits, ends) by process, and t: the same over all processes."""
    return f"""WITH {_STACKS}, e AS (
  SELECT pid, c, d, array_to_string({keys}[1:d], '>') AS path, array_to_string({keys}[1:d-1], '>') AS parent, CASE WHEN d = 0 THEN '[root]' ELSE f[d] END AS fn, CASE WHEN d = 0 THEN '[virtual]' ELSE l[d] END AS lib, d = len(k) AS leaf
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM s)
), n AS (
  SELECT pid, path, d AS depth, any_value(fn) AS fn, any_value(lib) AS lib, any_value(parent) AS parent, CAST(sum(c) AS BIGINT) AS visits, CAST(sum(CASE WHEN leaf THEN c ELSE 0 END) AS BIGINT) AS ends FROM e GROUP BY pid, path, d
), u AS (
  SELECT path, CAST(depth AS INTEGER) AS depth, any_value(fn) AS function_name, any_value(lib) AS library_name, any_value(parent) AS parent, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(ends) AS BIGINT) AS ends FROM n GROUP BY path, depth
), t AS (
  SELECT path, depth, function_name, library_name, parent, visits, CAST(CASE WHEN depth = 0 THEN visits ELSE {total} END AS BIGINT) AS total_samples, CAST({self_} AS BIGINT) AS self_samples FROM u
) """


_TREE = "SELECT path, depth, total_samples, self_samples FROM t"
_SUM = "(SELECT total_samples FROM t WHERE depth = 0)"
_HOT = f"path, function_name, library_name, total_samples, round(100.0 * total_samples / {_SUM}, 6) AS percentage, self_samples, round(100.0 * self_samples / {_SUM}, 6) AS self_percentage"


def _hot(df: DataFrame) -> DataFrame:
    return df.select(path_text().alias("path"), "function_name", "library_name", "total_samples", F.round("percentage", 6).alias("percentage"), "self_samples", F.round("self_percentage", 6).alias("self_percentage"))


def _balance(df: DataFrame) -> DataFrame:
    r = [F.round(c, 6).alias(c) for c in ("mean_samples", "std_dev_samples", "min_samples", "max_samples", "imbalance_factor")]
    return df.select(*r, "most_loaded_process", "least_loaded_process", F.array_join(F.transform("process_samples", lambda x: x.cast("long").cast("string")), ",").alias("process_samples"))


def _balance_sql(counts: str) -> str:
    return f"""{counts}, every AS (
  SELECT r.pid, CAST(coalesce(c, 0) AS BIGINT) AS c FROM (SELECT unnest(range(0, (SELECT max(pid) + 1 FROM counts))) AS pid) r LEFT JOIN counts USING (pid)
) SELECT round(avg(c), 6) AS mean_samples, round(stddev_pop(c), 6) AS std_dev_samples, CAST(min(c) AS DOUBLE) AS min_samples, CAST(max(c) AS DOUBLE) AS max_samples, round((max(c) - min(c)) / avg(c), 6) AS imbalance_factor,
  (SELECT pid FROM every ORDER BY c DESC, pid LIMIT 1) AS most_loaded_process, (SELECT pid FROM every ORDER BY c, pid LIMIT 1) AS least_loaded_process, string_agg(CAST(c AS VARCHAR), ',' ORDER BY pid) AS process_samples FROM every"""


def _runs(spark, sf_dir) -> DataFrame:
    """Benchmark runs from orders: priority as program, status as class, year as iteration, whole price as seconds."""
    o = _table(spark, sf_dir, "orders")
    n = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 4, 8)]), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(F.substring("o_orderpriority", 1, 1).alias("benchmark"), F.col("o_orderstatus").alias("class"), n.alias("num_processes"), F.col("o_orderkey").alias("iteration"), F.floor("o_totalprice").cast("double").alias("execution_time_sec"), (F.col("o_orderkey") % 3 == 0).alias("base"))


_RUNS = "WITH runs AS (SELECT substr(o_orderpriority, 1, 1) AS benchmark, o_orderstatus AS class, CAST([1, 2, 4, 8][o_custkey % 4 + 1] AS INTEGER) AS num_processes, o_orderkey AS iteration, floor(o_totalprice) AS execution_time_sec, o_orderkey % 3 = 0 AS base FROM orders)"
_OVERHEAD = (
    _RUNS
    + ", b AS (SELECT benchmark, class, num_processes, round(avg(execution_time_sec), 2) AS b FROM runs WHERE base GROUP BY ALL), q AS (SELECT r.*, CAST(CAST(execution_time_sec AS DECIMAL(24, 9)) - CAST(b AS DECIMAL(24, 9)) AS DOUBLE) / b AS x FROM runs r LEFT JOIN b USING (benchmark, class, num_processes) WHERE NOT base)"
    + ", o AS (SELECT benchmark, class, num_processes, iteration, execution_time_sec, round(sign(x) * floor(abs(x) * 10000 + 1e-6) / 10000 * 100.0, 2) AS overhead_percent FROM q)"
)
_KEYS = ["benchmark", "class", "num_processes"]


def _whole_percent(df: DataFrame) -> DataFrame:
    """Baselines in whole cents, so that both engines divide equal numbers."""
    return df.withColumn("baseline_time_sec", F.round("baseline_time_sec", 2))


def _hot_runs(spark, sf_dir) -> DataFrame:
    """Hotspots of each process as a run of its own."""
    s = stacks(spark, sf_dir)
    total = s.groupBy(F.col("process_id").alias("run_id")).agg(F.sum("count").alias("total_samples"))
    rows = s.withColumn("leaf", F.element_at("frames", -1)["function_name"]).select(F.col("process_id").alias("run_id"), "count", "leaf", F.explode("frames").alias("x"))
    by = rows.groupBy("run_id", F.col("x.function_name").alias("function_name")).agg(F.min("x.library_name").alias("library_name"), F.sum(F.when(F.col("leaf") == F.col("x.function_name"), F.col("count")).otherwise(0)).alias("exclusive_samples"), F.sum("count").alias("inclusive_samples"))
    return by.join(total, "run_id")


def _ranges(spark, sf_dir) -> DataFrame:
    """Address ranges from parts, every tenth left unmapped and every seventh not executable, for processes 0 to 3."""
    p = _table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    each = p.withColumn("process_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    base = F.col("p_partkey") * 4096 + F.when(F.col("p_partkey") % 2 == 0, F.lit(0x7F0000000000)).otherwise(0)
    return each.select("process_id", F.col("p_partkey").cast("int").alias("ord"), base.alias("base"), (base + 4096 + F.when(F.col("p_partkey") % 3 == 0, 2048).otherwise(0)).alias("end"), (F.col("p_partkey") % 7 != 0).alias("executable"), F.concat(F.lit("lib"), F.col("p_partkey").cast("string")).alias("name"))


def _addresses(spark, sf_dir) -> DataFrame:
    x = _table(spark, sf_dir, "lineitem")
    a = F.col("l_partkey") * 4096 + F.col("l_suppkey") % 5000 + F.when(F.col("l_partkey") % 2 == 0, F.lit(0x7F0000000000)).otherwise(0)
    return x.select((F.col("l_linenumber") - 1).cast("long").alias("process_id"), a.alias("address"))


_RESOLVED = """WITH ranges AS (
  SELECT pid, CAST(p_partkey AS INTEGER) AS ord, b AS base, b + 4096 + CASE WHEN p_partkey % 3 = 0 THEN 2048 ELSE 0 END AS fin, p_partkey % 7 <> 0 AS exe, 'lib' || p_partkey AS name
  FROM (SELECT p_partkey, p_partkey * 4096 + CASE WHEN p_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS b FROM part WHERE p_partkey % 10 <> 0), (SELECT unnest([0, 1, 2, 3]) AS pid)
), a AS (
  SELECT DISTINCT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_partkey * 4096 + l_suppkey % 5000 + CASE WHEN l_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS address FROM lineitem
), m AS (
  SELECT process_id, address, arg_min(name, ord) AS name, arg_min(base, ord) AS base FROM a JOIN ranges ON pid = process_id AND exe AND address >= base AND address < fin GROUP BY ALL
), r AS (
  SELECT a.process_id, a.address, coalesce(name, CASE WHEN a.process_id <= 3 THEN '[unresolved]' ELSE '[unknown]' END) AS library_name, CASE WHEN base IS NULL OR base < 268435456 THEN a.address ELSE a.address - base END AS "offset"
  FROM a LEFT JOIN m ON m.process_id = a.process_id AND m.address = a.address
) """


def _symbols(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.concat(F.lit("lib"), F.col("p_partkey").cast("string")).alias("library"), (F.col("p_partkey") % 5000).alias("offset"), F.col("p_name").alias("function_name"), F.col("p_brand").alias("filename"), F.col("p_size").alias("line_number"))


def _stopped(spark, sf_dir) -> DataFrame:
    return _rows(_tree(spark, sf_dir).traverse("preorder", F.col("function_name") == "ASIA"), "visit_rank")


def _ranked(order):
    return lambda s, d: _rows(_tree(s, d).traverse(order), "visit_rank")


def _samples(spark, sf_dir, where) -> DataFrame:
    """Stacks of two addresses, supplier and part group, counted."""
    x = _table(spark, sf_dir, "lineitem").where(where).select((F.col("l_linenumber") - 1).cast("long").alias("process_id"), F.array(F.col("l_suppkey"), F.col("l_partkey") % 4).alias("addrs"))
    return S.count_stacks(x)


def _entries(df: DataFrame) -> DataFrame:
    return df.select("process_id", F.array_join(F.transform("addrs", lambda a: a.cast("string")), ",").alias("addrs"), "count")


def _counted(where: str, name: str) -> str:
    return f"{name} AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_suppkey || ',' || l_partkey % 4 AS addrs, count(*) AS count FROM lineitem WHERE {where} GROUP BY ALL)"


_OLD, _NEW, _FEW = "l_returnflag <> 'R'", "l_returnflag = 'R'", "l_quantity >= 50"


def _workflow(spark, sf_dir, port):
    """What one step of a composed workflow returns."""
    from stackloom.plans.builder import WorkflowBuilder
    from stackloom.plans.nodes import AggregateNode

    w = WorkflowBuilder("Q").load_data(stacks=stacks(spark, sf_dir), spark=spark).find_hotspots(10).find_hotspots(10, "total", "TotalHotspots").analyze_balance()
    w.filter_nodes(min_samples=100, function_pattern="*IA*")
    w.add_node(AggregateNode([F.sum("self_samples").alias("self_samples"), F.count("*").alias("node_count")], [F.col("library_name")], F.col("depth") > 0))
    w.connect("load_data", "aggregate", "tree")
    out = w.execute()
    name, key = port
    return out[w.get_node(name).node_id][key]


# Siblings appear in order of their first process, then by key; so does SQL's order by the chain of such pairs.
_ORDER = f"""{_nodes()}, f AS (SELECT path, min(pid) AS p FROM n GROUP BY path), chain AS (
  SELECT t.path, t.depth, t.total_samples, t.self_samples, t.function_name, list({{'p': coalesce(f.p, 0), 'f': split_part(a.k, '@', 1), 'l': split_part(a.k, '@', 2)}} ORDER BY a.i) AS o
  FROM t, LATERAL (SELECT unnest(range(1, t.depth + 1)) AS i) x, LATERAL (SELECT x.i AS i, array_to_string(string_split(t.path, '>')[1:x.i], '>') AS p, string_split(t.path, '>')[x.i] AS k) a LEFT JOIN f ON f.path = a.p
  GROUP BY ALL
  UNION ALL SELECT path, depth, total_samples, self_samples, function_name, [] FROM t WHERE depth = 0
) """


def _q(name, fn, sql):
    return name, (fn, sql)


def _table_of_queries():
    t = _tree
    out = dict(
        [
            _q("tree_both_cf", lambda s, d: _rows(t(s, d).nodes), _nodes() + _TREE),
            _q("tree_both_ca", lambda s, d: _rows(t(s, d, CA).nodes, path=_path_ca()), _nodes("ka") + _TREE),
            _q("tree_inclusive", lambda s, d: _rows(t(s, d, count=INC).nodes), _nodes(self_="0") + _TREE),
            _q("tree_exclusive", lambda s, d: _rows(t(s, d, count=EXC).nodes), _nodes(total="ends") + _TREE),
            _q(
                "tree_stats",
                lambda s, d: t(s, d).nodes.agg(F.count("*").alias("node_count"), F.max("depth").alias("max_depth"), F.max(F.when(F.col("is_root"), F.col("total_samples"))).alias("total_samples"), F.sum(F.col("is_leaf").cast("long")).alias("leaf_count"), F.max(F.when(F.col("is_root"), F.col("total_time_us"))).alias("total_time_us")),
                _nodes() + f"SELECT count(*) AS node_count, max(depth) AS max_depth, {_SUM} AS total_samples, CAST(sum(CASE WHEN NOT EXISTS (SELECT 1 FROM t c WHERE c.parent = t.path AND c.depth = t.depth + 1) THEN 1 ELSE 0 END) AS BIGINT) AS leaf_count, CAST({_SUM} * 1000.0 AS DOUBLE) AS total_time_us FROM t",
            ),
            _q(
                "node_process",
                lambda s, d: (lambda x: x.node_process.join(x.nodes.select("node_id", "path"), "node_id").select(path_text().alias("path"), "process_id", "samples", "time_us"))(t(s, d)),
                _nodes() + "SELECT path, pid AS process_id, visits AS samples, CAST(visits * 1000.0 AS DOUBLE) AS time_us FROM n",
            ),
            _q(
                "node_process_exclusive",
                lambda s, d: (lambda x: x.node_process.join(x.nodes.select("node_id", "path"), "node_id").select(path_text().alias("path"), "process_id", "samples", "time_us"))(t(s, d, count=EXC)),
                _nodes() + "SELECT path, pid AS process_id, CASE WHEN depth = 0 THEN visits ELSE ends END AS samples, CAST(CASE WHEN depth = 0 THEN visits ELSE ends END * 1000.0 AS DOUBLE) AS time_us FROM n WHERE depth = 0 OR ends > 0",
            ),
            _q(
                "edges",
                lambda s, d: (lambda x: x.edges.join(x.nodes.select(F.col("node_id").alias("child_id"), "path"), "child_id").select(path_text().alias("child_path"), "call_count"))(t(s, d, count=EXC)),
                _nodes() + "SELECT path AS child_path, visits AS call_count FROM t WHERE depth > 0",
            ),
            _q("hotspots_self", lambda s, d: _hot(A.find_hotspots(t(s, d))), _nodes() + f"SELECT {_HOT} FROM t WHERE depth > 0 AND self_samples > 0 ORDER BY self_samples DESC, path LIMIT 10"),
            _q("hotspots_total", lambda s, d: _hot(A.find_total_hotspots(t(s, d))), _nodes() + f"SELECT {_HOT} FROM t WHERE depth > 0 ORDER BY total_samples DESC, path LIMIT 10"),
            _q("balance", lambda s, d: _balance(A.balance(t(s, d))), _balance_sql(f"WITH {_STACKS}, counts AS (SELECT pid, CAST(sum(c) AS BIGINT) AS c FROM s GROUP BY pid)")),
            _q("balance_events", lambda s, d: _balance(A.balance(build_tree(event_stacks(s, d)))), _balance_sql("WITH counts AS (SELECT user_id % 8 AS pid, count(*) AS c FROM events GROUP BY 1)")),
            _q("process_samples", lambda s, d: t(s, d).processes, f"WITH {_STACKS} SELECT pid AS process_id, CAST(sum(c) AS BIGINT) AS samples FROM s GROUP BY pid"),
            _q("filter_min_samples", lambda s, d: _rows(t(s, d).filter_by_samples(100)), _nodes() + _TREE + " WHERE total_samples >= 100"),
            _q("filter_min_self", lambda s, d: _rows(t(s, d).filter_by_self_samples(50)), _nodes() + _TREE + " WHERE self_samples >= 50"),
            _q("filter_pattern", lambda s, d: _rows(t(s, d).find_nodes_like("*IA*")), _nodes() + _TREE + " WHERE function_name LIKE '%IA%'"),
            _q("filter_pattern_edges", lambda s, d: _rows(t(s, d).find_nodes_like("A*A", strict=False)), _nodes() + _TREE + " WHERE starts_with(function_name, 'A') AND ends_with(function_name, 'A')"),
            _q("filter_combined", lambda s, d: _rows(t(s, d).filter_nodes((F.col("total_samples") >= 20) & (F.col("total_samples") <= 5000) & (F.col("self_samples") >= 10) & (F.col("library_name") == "libsupplier.so"))), _nodes() + _TREE + " WHERE total_samples BETWEEN 20 AND 5000 AND self_samples >= 10 AND library_name = 'libsupplier.so'"),
            _q("find_by_name", lambda s, d: _rows(t(s, d).find_nodes_by_name("ASIA")), _nodes() + _TREE + " WHERE function_name = 'ASIA'"),
            _q("find_by_library", lambda s, d: _rows(t(s, d).find_nodes_by_library("libnation.so")), _nodes() + _TREE + " WHERE library_name = 'libnation.so'"),
            _q("nodes_at_depth", lambda s, d: _rows(t(s, d).nodes_at_depth(3)), _nodes() + _TREE + " WHERE depth = 3"),
            _q("leaf_nodes", lambda s, d: _rows(t(s, d).leaf_nodes), _nodes() + _TREE + " WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.parent = t.path AND c.depth = t.depth + 1)"),
            _q(
                "siblings",
                lambda s, d: (lambda x: x.siblings(x.nodes_at_depth(2)).select("of_id", path_text().alias("sibling_path")).join(x.nodes.select(F.col("node_id").alias("of_id"), path_text().alias("path")), "of_id").select("path", "sibling_path"))(t(s, d)),
                _nodes() + "SELECT a.path, b.path AS sibling_path FROM t a JOIN t b ON a.parent = b.parent AND a.depth = b.depth AND a.path <> b.path WHERE a.depth = 2",
            ),
            _q("children_of", lambda s, d: (lambda x: _rows(x.children(x.find_nodes_by_name("ASIA"))))(t(s, d)), _nodes() + "SELECT c.path, c.depth, c.total_samples, c.self_samples FROM t c JOIN t p ON c.parent = p.path AND c.depth = p.depth + 1 WHERE p.function_name = 'ASIA'"),
            _q("paths", lambda s, d: t(s, d).paths.select(path_text().alias("path"), F.concat_ws("/", "names").alias("names")), _nodes() + "SELECT path, CASE WHEN depth = 0 THEN '[root]' ELSE '[root]/' || regexp_replace(replace(path, '>', '/'), '@[^/]*', '', 'g') END AS names FROM t"),
            _q("preorder_rank", _ranked("preorder"), _ORDER + "SELECT path, depth, total_samples, self_samples, row_number() OVER (ORDER BY o) AS visit_rank FROM chain"),
            _q("postorder_rank", _ranked("postorder"), _ORDER + "SELECT path, depth, total_samples, self_samples, row_number() OVER (ORDER BY o || [{'p': 9223372036854775807, 'f': '', 'l': ''}]) AS visit_rank FROM chain"),
            _q("levelorder_rank", _ranked("levelorder"), _ORDER + "SELECT path, depth, total_samples, self_samples, row_number() OVER (ORDER BY depth, o) AS visit_rank FROM chain"),
            _q("traversal_stop", _stopped, _ORDER + ", v AS (SELECT *, row_number() OVER (ORDER BY o) AS visit_rank FROM chain) SELECT path, depth, total_samples, self_samples, visit_rank FROM v WHERE visit_rank <= (SELECT min(visit_rank) FROM v WHERE function_name = 'ASIA')"),
            _q("agg_by_library", lambda s, d: A.samples_by_library(t(s, d)), _nodes() + "SELECT library_name, CAST(sum(self_samples) AS BIGINT) AS self_samples, count(*) AS node_count FROM t WHERE depth > 0 GROUP BY library_name"),
            _q("group_by_depth", lambda s, d: A.group_nodes(t(s, d), [F.col("depth")], [F.sum("self_samples").alias("self_samples"), F.max("total_samples").alias("max_total"), F.count("*").alias("n")], F.col("total_samples") >= 10), _nodes() + "SELECT depth, CAST(sum(self_samples) AS BIGINT) AS self_samples, max(total_samples) AS max_total, count(*) AS n FROM t WHERE total_samples >= 10 GROUP BY depth"),
            _q("library_hotness", lambda s, d: A.library_hotness(stacks(s, d)).withColumn("percentage", F.round("percentage", 6)), f"WITH {_STACKS} SELECT lib AS library_name, CAST(sum(c) AS BIGINT) AS samples, round(100.0 * sum(c) / (SELECT sum(c) FROM s), 6) AS percentage FROM (SELECT c, unnest(l) AS lib FROM s) GROUP BY lib"),
            _q("function_hotness", lambda s, d: A.function_hotness(stacks(s, d)).withColumn("percentage", F.round("percentage", 6)), f"WITH {_STACKS} SELECT fn AS function_key, CAST(sum(c) AS BIGINT) AS samples, round(100.0 * sum(c) / (SELECT sum(c) FROM s), 6) AS percentage FROM (SELECT c, unnest(f) AS fn FROM s) GROUP BY fn"),
            _q(
                "flat_hotspots",
                lambda s, d: A.flat_hotspots(stacks(s, d)).select("function_name", "library_name", "exclusive_samples", "inclusive_samples", F.round("exclusive_percentage", 6).alias("exclusive_percentage"), F.round("inclusive_percentage", 6).alias("inclusive_percentage")),
                f"WITH {_STACKS}, x AS (SELECT c, f[-1] AS leaf, unnest(f) AS fn, unnest(l) AS lib FROM s) SELECT fn AS function_name, min(lib) AS library_name, CAST(sum(CASE WHEN leaf = fn THEN c ELSE 0 END) AS BIGINT) AS exclusive_samples, CAST(sum(c) AS BIGINT) AS inclusive_samples, round(100.0 * sum(CASE WHEN leaf = fn THEN c ELSE 0 END) / (SELECT sum(c) FROM s), 6) AS exclusive_percentage, round(100.0 * sum(c) / (SELECT sum(c) FROM s), 6) AS inclusive_percentage FROM x WHERE fn <> 'main' GROUP BY fn",
            ),
            _q("hot_stacks", lambda s, d: A.hot_stacks(stacks(s, d)).select(F.concat_ws(">", "names").alias("names"), "samples"), f"WITH {_STACKS} SELECT array_to_string(f, '>') AS names, CAST(sum(c) AS BIGINT) AS samples FROM s GROUP BY f ORDER BY samples DESC, f LIMIT 10"),
            _q("top_root_children", lambda s, d: _rows(A.top_root_children(build_tree(event_stacks(s, d), count_mode=BOTH))), "SELECT 'main@app' AS path, 1 AS depth, count(*) AS total_samples, CAST(0 AS BIGINT) AS self_samples FROM events"),
            _q("range_resolve", lambda s, d: resolve_addresses(_addresses(s, d), _ranges(s, d)), _RESOLVED + "SELECT * FROM r"),
            _q("range_resolve_bucketed", lambda s, d: resolve_addresses(_addresses(s, d), _ranges(s, d), broadcast_ranges=0), _RESOLVED + "SELECT * FROM r"),
            _q(
                "symbol_join",
                lambda s, d: resolve_samples(_addresses(s, d).groupBy("process_id", "address").agg(F.count("*").alias("count")).select("process_id", F.col("address").alias("entry_ord"), F.array("address").alias("addrs"), "count"), _ranges(s, d), _symbols(s, d)).select("process_id", F.col("frames")[0]["raw_address"].alias("address"), F.col("frames")[0]["library_name"].alias("library_name"), F.col("frames")[0]["offset"].alias("offset"), F.col("frames")[0]["function_name"].alias("function_name"), F.col("frames")[0]["line_number"].alias("line_number"), "count"),
                _RESOLVED + """, c AS (SELECT CAST(l_linenumber - 1 AS BIGINT) AS process_id, l_partkey * 4096 + l_suppkey % 5000 + CASE WHEN l_partkey % 2 = 0 THEN 139637976727552 ELSE 0 END AS address, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT r.process_id, r.address, library_name, "offset", CASE WHEN library_name = '[unknown]' THEN '[unknown]' ELSE coalesce(p_name, '') END AS function_name, coalesce(p_size, 0) AS line_number, n AS count
FROM r JOIN c USING (process_id, address) LEFT JOIN part ON library_name = 'lib' || p_partkey AND "offset" = p_partkey % 5000""",
            ),
            _q("merge_trees", lambda s, d: (lambda x: _rows(build_tree(x.where("process_id % 2 = 0"), count_mode=BOTH).merged(build_tree(x.where("process_id % 2 = 1"), count_mode=BOTH)).nodes))(stacks(s, d)), _nodes() + _TREE),
            _q(
                "multi_run_rollup",
                lambda s, d: N.rollup_hotspots(_hot_runs(s, d)).select("function_name", "library_name", "exclusive_samples", "inclusive_samples", "runs", F.round("exclusive_percentage", 6).alias("exclusive_percentage"), F.round("inclusive_percentage", 6).alias("inclusive_percentage")),
                f"WITH {_STACKS}, x AS (SELECT pid, c, f[-1] AS leaf, unnest(f) AS fn, unnest(l) AS lib FROM s) SELECT fn AS function_name, min(lib) AS library_name, CAST(sum(CASE WHEN leaf = fn THEN c ELSE 0 END) AS BIGINT) AS exclusive_samples, CAST(sum(c) AS BIGINT) AS inclusive_samples, count(DISTINCT pid) AS runs, round(100.0 * sum(CASE WHEN leaf = fn THEN c ELSE 0 END) / (SELECT sum(c) FROM s), 6) AS exclusive_percentage, round(100.0 * sum(c) / (SELECT sum(c) FROM s), 6) AS inclusive_percentage FROM x GROUP BY fn",
            ),
            _q(
                "overhead_pct",
                lambda s, d: (lambda r: N.overhead(r.where("not base"), _whole_percent(N.baseline_times(r.where("base")))).select(*_KEYS, "iteration", "execution_time_sec", "overhead_percent"))(_runs(s, d)),
                _OVERHEAD + " SELECT * FROM o",
            ),
            _q("baseline_avg", lambda s, d: N.baseline_times(_runs(s, d)).withColumn("baseline_time_sec", F.round("baseline_time_sec", 4)), _RUNS + " SELECT benchmark, class, num_processes, round(avg(execution_time_sec), 4) AS baseline_time_sec FROM runs GROUP BY ALL"),
            _q("baseline_running", lambda s, d: N.baseline_times(_runs(s, d), running=True).withColumn("baseline_time_sec", F.round("baseline_time_sec", 4)), _RUNS + " SELECT benchmark, class, num_processes, round(list_reduce(list(execution_time_sec ORDER BY iteration), lambda a, x: (a + x) / 2), 4) AS baseline_time_sec FROM runs GROUP BY ALL"),
            _q("select_runs", lambda s, d: N.select_runs(_runs(s, d).where("base"), ("1", "2"), "O", (1, 2, 8)).groupBy(*_KEYS).agg(F.count("*").alias("runs")), _RUNS + " SELECT benchmark, class, num_processes, count(*) AS runs FROM runs WHERE base AND benchmark IN ('1', '2') AND class = 'O' AND num_processes IN (1, 2, 8) GROUP BY ALL"),
            _q("execution_time", lambda s, d: t(s, d).nodes.select(path_text().alias("path"), "total_time_us"), _nodes() + "SELECT path, CAST(total_samples * 1000.0 AS DOUBLE) AS total_time_us FROM t"),
            _q(
                "node_labels",
                lambda s, d: t(s, d).nodes.select(path_text().alias("path"), C.truncated(F.col("function_name"), 8, "...").alias("short"), C.hex_address(F.col("total_samples"), 16).alias("hex"), color(F.col("total_samples"), F.lit(100_000), ColorScheme.Grayscale).alias("gray")),
                _nodes() + "SELECT path, CASE WHEN length(function_name) > 8 THEN substr(function_name, 1, 8) || '...' ELSE function_name END AS short, '0x' || lpad(lower(to_hex(total_samples)), 16, '0') AS hex, '#' || repeat(lpad(lower(to_hex(CAST(trunc((1.0 - CAST(total_samples AS DOUBLE) / 100000) * 255) AS BIGINT))), 2, '0'), 3) AS gray FROM t",
            ),
            _q(
                "stack_functions",
                lambda s, d: stacks(s, d).select(F.transform("frames", lambda x: x["function_name"]).alias("a"), "count").select(F.concat_ws(">", C.pop(F.col("a"))).alias("popped"), F.concat_ws(">", C.push(F.col("a"), F.lit("x"), 4)).alias("pushed"), C.frame(F.col("a"), 1).alias("second"), C.depth(F.col("a")).alias("depth"), C.is_full(F.col("a"), 4).alias("full"), "count").groupBy("popped", "pushed", "second", "depth", "full").agg(F.sum("count").alias("samples")),
                f"WITH {_STACKS} SELECT array_to_string(f[1:len(f)-1], '>') AS popped, array_to_string(CASE WHEN len(f) < 4 THEN f || ['x'] ELSE f END, '>') AS pushed, f[2] AS second, CAST(len(f) AS INTEGER) AS depth, len(f) >= 4 AS full, CAST(sum(c) AS BIGINT) AS samples FROM s GROUP BY ALL",
            ),
            _q("count_stacks", lambda s, d: _entries(_samples(s, d, "true")), f"WITH {_counted('true', 'a')} SELECT * FROM a"),
            _q("upsert_stacks", lambda s, d: _entries(S.upsert(_samples(s, d, _OLD), _samples(s, d, _NEW), order="count")), f"WITH {_counted(_OLD, 'a')}, {_counted(_NEW, 'b')} SELECT * FROM b UNION ALL SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.process_id = b.process_id AND a.addrs = b.addrs)"),
            _q("add_stacks", lambda s, d: _entries(S.add(_samples(s, d, _OLD), _samples(s, d, _NEW))), f"WITH {_counted('true', 'a')} SELECT * FROM a"),
            _q("erase_stacks", lambda s, d: _entries(S.erase(_samples(s, d, _OLD), _samples(s, d, _FEW))), f"WITH {_counted(_OLD, 'a')}, {_counted(_FEW, 'b')} SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.process_id = b.process_id AND a.addrs = b.addrs)"),
            _q("find_stack", lambda s, d: _entries(S.find(_samples(s, d, "true"), [3, 1])), f"WITH {_counted('true', 'a')} SELECT * FROM a WHERE addrs = '3,1'"),
            _q("average_overhead", lambda s, d: (lambda r: N.average_overhead(N.overhead(r.where("not base"), _whole_percent(N.baseline_times(r.where("base"))))).select("benchmark", "num_processes", F.round("overhead_percent", 4).alias("overhead_percent"), F.round("execution_time_sec", 4).alias("execution_time_sec"), "runs"))(_runs(s, d)), _OVERHEAD + " SELECT benchmark, num_processes, round(avg(overhead_percent), 4) AS overhead_percent, round(avg(execution_time_sec), 4) AS execution_time_sec, count(*) AS runs FROM o WHERE overhead_percent IS NOT NULL GROUP BY ALL"),
            _q("workflow_hotspots", lambda s, d: _hot(_workflow(s, d, ("hotspotanalysis", "hotspots"))), _nodes() + f"SELECT {_HOT} FROM t WHERE depth > 0 AND self_samples > 0 ORDER BY self_samples DESC, path LIMIT 10"),
            _q("workflow_total", lambda s, d: _hot(_workflow(s, d, ("totalhotspots", "hotspots"))), _nodes() + f"SELECT {_HOT} FROM t WHERE depth > 0 ORDER BY total_samples DESC, path LIMIT 10"),
            _q("workflow_balance", lambda s, d: _balance(_workflow(s, d, ("balance", "balance"))), _balance_sql(f"WITH {_STACKS}, counts AS (SELECT pid, CAST(sum(c) AS BIGINT) AS c FROM s GROUP BY pid)")),
            _q("workflow_filter", lambda s, d: _rows(_workflow(s, d, ("filter", "nodes"))), _nodes() + _TREE + " WHERE total_samples >= 100 AND function_name LIKE '%IA%'"),
            _q("workflow_aggregate", lambda s, d: _workflow(s, d, ("aggregate", "aggregated")), _nodes() + "SELECT library_name, CAST(sum(self_samples) AS BIGINT) AS self_samples, count(*) AS node_count FROM t WHERE depth > 0 GROUP BY library_name"),
            _q("tree_events", lambda s, d: _rows(build_tree(event_stacks(s, d), count_mode=BOTH).nodes), "SELECT '' AS path, 0 AS depth, count(*) AS total_samples, CAST(0 AS BIGINT) AS self_samples FROM events UNION ALL SELECT 'main@app', 1, count(*), 0 FROM events UNION ALL SELECT 'main@app>' || event_type || '@libevent.so', 2, count(*), count(*) FROM events GROUP BY event_type"),
        ]
    )
    assert ROOT == "[root]"
    return out


_ALL = _table_of_queries()


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _ALL.items() if v[1]}
