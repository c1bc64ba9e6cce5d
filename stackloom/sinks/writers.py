"""Writers: trees, samples and maps as text, graphs and files; tables on the console.

Text lines are made by column expressions and leave in order; text, DOT, binary trees and maps are written by executors in ranges
of that order (stackloom.sinks.ordered). The samples of one process are streamed a partition at a time.
Samples of many processes are written by executors: df.write.format("pflw") (stackloom.sources.datasource).
"""

from __future__ import annotations

import json
import struct
import subprocess
import time
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.functions.callstack import distance, hex_address, truncated
from stackloom.functions.colors import color
from stackloom.model import MAX_DEPTH, UNKNOWN, VIRTUAL, ColorScheme, SampleCountMode
from stackloom.operators import analysis
from stackloom.operators.tree import Tree
from stackloom.session import written
from stackloom.sinks.ordered import opened, write_ordered
from stackloom.sources.formats import TREE_HEADER, TREE_MAGIC, TREE_NODE, VERSION, WORD, map_header, pack_entry, pack_library, sample_header


def _write(path: str, head: list[str], lines: DataFrame, place: list[str], tail: str = "") -> str:
    """Text of head and of ordered lines, by executors."""
    return write_ordered(lines, path, place, head="".join(x + "\n" for x in head).encode(), tail=tail.encode())


#: The largest number of 16 bits, and processes that a tree file lists for each node.
SHORT, VECTOR = 0xFFFF, 1 << 20


def tree_lines(tree: Tree) -> DataFrame:
    """(visit_rank, line): an indented line per node in pre-order."""
    where = F.when((F.col("filename") != "") & (F.col("line_number") > 0), F.format_string(" [%s:%d]", "filename", "line_number")).otherwise("")
    library = F.when((F.col("library_name") != "") & (F.col("library_name") != VIRTUAL), F.concat(F.lit(" ("), "library_name", F.lit(")"))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.format_string("[%d samples, %d self] %s", "total_samples", "self_samples", "function_name"), library, where)
    return tree.traverse("preorder").select("visit_rank", line.alias("line"))


def export_tree_text(tree: Tree, path: str, generated: int | None = None) -> str:
    tree = tree.stored
    head = ["# Performance Tree (Text Format)", f"# Generated: {int(time.time()) if generated is None else generated}", f"# Process count: {tree.process_count}", f"# Total samples: {tree.total_samples}", "#", ""]
    return _write(path, head, tree_lines(tree), ["visit_rank"])


def dot_lines(tree: Tree, scheme: ColorScheme = ColorScheme.Heatmap, max_depth: int = 0) -> DataFrame:
    """(visit_rank, part, line): a node line per node and an edge line per edge; max_depth 0 is without limit."""
    tree = tree.stored
    n = tree.traverse("preorder")
    if max_depth:
        n = n.where(F.col("depth") <= max_depth)
    samples = F.col("self_samples" if tree.count_mode is SampleCountMode.Exclusive else "total_samples")
    total = tree.stacks.agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("most"))
    n = n.crossJoin(F.broadcast(total)).withColumn("samples", F.when(F.col("is_root") & F.lit(tree.count_mode is not SampleCountMode.Exclusive), F.col("total_samples")).otherwise(samples))
    name = F.when(F.col("function_name").isin("", UNKNOWN), hex_address(F.col("raw_address"))).otherwise(F.col("function_name"))
    share = F.when(F.col("most") > 0, F.col("samples") * 100.0 / F.col("most")).otherwise(0.0)
    label = F.regexp_replace(F.concat(name, F.format_string("\\n[%d samples, %.1f%%]", "samples", share)), '"', '\\\\"')
    nodes = n.select("visit_rank", F.lit(0).alias("part"), F.format_string('  node%d [label="%s", fillcolor="%s"];', F.col("visit_rank") - 1, label, color(F.col("samples"), F.col("most"), scheme)).alias("line"))
    p = n.select(F.col("node_id").alias("parent_id"), F.col("visit_rank").alias("parent_rank"))
    calls = F.when(F.col("call_count") > 0, F.format_string(' [label="%d"]', "call_count")).otherwise("")
    edges = n.where("not is_root").join(p, "parent_id").select("visit_rank", F.lit(1).alias("part"), F.concat(F.format_string("  node%d -> node%d", F.col("parent_rank") - 1, F.col("visit_rank") - 1), calls, F.lit(";")).alias("line"))
    return nodes.unionByName(edges)


def generate_dot(tree: Tree, path: str, scheme: ColorScheme = ColorScheme.Heatmap, max_depth: int = 0) -> str:
    head = ["digraph PerformanceTree {", "  rankdir=TB;", "  node [shape=box, style=filled];", ""]
    return _write(path, head, dot_lines(tree, scheme, max_depth), ["visit_rank", "part"], "}\n")


def generate_pdf(tree: Tree, path: str, scheme: ColorScheme = ColorScheme.Heatmap, max_depth: int = 0, tool: str = "dot") -> bool:
    """A PDF by Graphviz where it is installed; False otherwise. Arguments never pass a shell."""
    dot = generate_dot(tree, path.removesuffix(".pdf") + ".dot", scheme, max_depth)
    try:
        return subprocess.run([tool, "-Tpdf", dot, "-o", path], check=False, capture_output=True, timeout=300).returncode == 0
    except (OSError, subprocess.SubprocessError):
        return False


def _pack_nodes(count: int, batches) -> Iterator[bytes]:
    """Records of nodes from rows in the order of visit_rank: a row of the node itself, then one for each process."""
    head, samples, times = None, None, None
    for b in batches:
        for r in b.to_pylist():
            if r["process_id"] is not None:
                samples[r["process_id"]], times[r["process_id"]] = r["samples"], r["time_us"]
                continue
            if head:
                yield head + samples.tobytes() + times.tobytes()
            # Lengths and the number of children have 16 bits in the format: longer names are cut, more children say 65,535.
            names = [(r[c] or "").encode()[:SHORT].decode(errors="ignore").encode() for c in ("function_name", "library_name", "filename")]
            fixed = TREE_NODE.pack(r["visit_rank"] - 1, r["parent_no"] or 0, r["total_samples"], r["self_samples"], r["raw_address"] & WORD, r["offset"] & WORD, r["line_number"], *map(len, names), min(r["child_count"], SHORT), 0)
            head, samples, times = fixed + b"".join(names), np.zeros(count, "<u8"), np.zeros(count, "<f8")
    if head:
        yield head + samples.tobytes() + times.tobytes()


def export_tree(tree: Tree, path: str, timestamp: int = 0) -> str:
    """The binary tree file: nodes in pre-order with ids from 0, the root's parent being 0. Executors write it."""
    tree = tree.stored  # nodes, their processes and the number of processes come from it
    count = tree.process_count
    if count > VECTOR:
        raise ValueError(f"a tree file lists every process from 0 on for each node; {count} processes are more than {VECTOR}")
    n = written(tree.traverse("preorder").select("node_id", "parent_id", "visit_rank", "total_samples", "self_samples", "raw_address", "offset", "line_number", "function_name", "library_name", "filename", "child_count"), "nodes")
    p = n.select(F.col("node_id").alias("parent_id"), (F.col("visit_rank") - 1).alias("parent_no"))
    nodes = n.join(p, "parent_id", "left").drop("node_id", "parent_id")
    per = n.select("node_id", "visit_rank").join(tree.node_process, "node_id").select("visit_rank", "process_id", "samples", "time_us")
    head = TREE_HEADER.pack(TREE_MAGIC, VERSION, 0, 0, n.count(), count, 0, timestamp, b"")
    return write_ordered(nodes.unionByName(per, allowMissingColumns=True), path, ["visit_rank", "process_id"], partial(_pack_nodes, count), head)


def read_tree(data: bytes) -> list[dict]:
    """Nodes of a binary tree file, which makes the format round-trip."""
    _, _, _, _, nodes, count, _, _, _ = TREE_HEADER.unpack_from(data)
    at, out = TREE_HEADER.size, []
    for _ in range(nodes):
        node, parent, total, own, raw, offset, line, a, b, c, children, _ = TREE_NODE.unpack_from(data, at)
        at += TREE_NODE.size
        names = []
        for size in (a, b, c):
            names.append(data[at : at + size].decode())
            at += size
        per = struct.unpack_from(f"<{count}Q{count}d", data, at)
        at += 16 * count
        out.append({"node": node, "parent": parent, "total": total, "self": own, "raw": raw, "offset": offset, "line": line, "function": names[0], "library": names[1], "file": names[2], "children": children, "samples": list(per[:count]), "times": list(per[count:])})
    return out


def export_samples(samples: DataFrame, path: str, timestamp: int = 0, max_depth: int = MAX_DEPTH) -> str:
    """The samples of one process as a sample file; equal stacks are added first."""
    rows = samples.groupBy(F.slice("addrs", 1, max_depth).alias("addrs")).agg(F.sum("count").alias("count")).orderBy("addrs")
    entries = 0
    with opened(path) as f:
        f.write(sample_header(0, timestamp, max_depth))
        for r in rows.toLocalIterator():
            f.write(pack_entry(r["addrs"], r["count"]))
            entries += 1
        f.seek(0)
        f.write(sample_header(entries, timestamp, max_depth))
    return path


def sample_lines(samples: DataFrame) -> DataFrame:
    """(entry_ord, line): count and depth, then an address per line, for every entry."""
    frames = F.transform("addrs", lambda a: F.concat(F.lit("  "), hex_address(a, 16)))
    line = F.concat(F.format_string("[%d] Call Stack (depth: %d)\n", "count", F.size("addrs")), F.concat_ws("\n", frames), F.when(F.size("addrs") > 0, F.lit("\n")).otherwise(""))
    return samples.select("entry_ord", line.alias("line"))


def export_samples_text(samples: DataFrame, path: str, generated: int | None = None, max_depth: int = MAX_DEPTH) -> str:
    head = ["# Performance Data (Text Format)", f"# Generated: {int(time.time()) if generated is None else generated}", f"# Entry count: {samples.count()}", f"# Max stack depth: {max_depth}", "#", "# Format: [Sample Count] Call Stack (depth: N)", "#   Address1", "#   Address2", "#   ...", "#", ""]
    return _write(path, head, sample_lines(samples), ["entry_ord", "line"])


def _pack_libraries(batches) -> Iterator[bytes]:
    for b in batches:
        yield b"".join(pack_library(*r) for r in zip(*(b.column(c).to_pylist() for c in ("base", "end", "executable", "name"))))


def export_map(lib_map: DataFrame, path: str, process_id: int, timestamp: int = 0) -> str:
    """The map of one process as a file, in the order of ord. Executors write it."""
    rows = lib_map.select("ord", "base", "end", "executable", "name")
    return write_ordered(rows, path, ["ord"], _pack_libraries, lambda n: map_header(n, process_id, timestamp))


def map_lines(lib_map: DataFrame) -> DataFrame:
    """(ord, line): range, size, mark and name of every library."""
    mark = F.when(F.col("executable"), "[x]").otherwise("[ ]")
    line = F.concat(F.lit("["), hex_address(F.col("base"), 16), F.lit(" - "), hex_address(F.col("end"), 16), F.lit("] ("), hex_address(distance(F.col("end"), F.col("base"))), F.lit(" bytes) "), mark, F.lit(" "), F.col("name"))
    return lib_map.select("ord", line.alias("line"))


def export_map_text(lib_map: DataFrame, path: str, process_id: int, generated: int | None = None) -> str:
    head = ["# Library Map (Text Format)", f"# Generated: {int(time.time()) if generated is None else generated}", f"# Process ID: {process_id}", f"# Library count: {lib_map.count()}", "#", "# Format: [Base Address - End Address] (Size) Library Name", "#", ""]
    return _write(path, head, map_lines(lib_map), ["ord", "line"])


def export_hotspots_json(hotspots: DataFrame, total_samples: int, path: str) -> str:
    """Flat hotspots of a run as JSON, names escaped."""
    rows = hotspots.orderBy(F.desc("exclusive_samples"), "function_name").toLocalIterator()
    names = {"function_name": "function", "library_name": "library"}
    with opened(path, "w") as f:
        json.dump({"total_samples": total_samples, "hotspots": [{names.get(k, k): v for k, v in r.asDict().items()} for r in rows]}, f, indent=2, ensure_ascii=False)
    return path


def export_results(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Benchmark results as CSV (null overhead is N/A) or JSON lines."""
    if kind == "csv":
        df.write.mode("overwrite").option("nullValue", "N/A").csv(path, header=True)
    else:
        df.write.mode("overwrite").json(path)


def hotspot_table(tree: Tree, top_n: int = 10, show_inclusive: bool = False) -> str:
    """The top hotspots as a table of text."""
    if show_inclusive:
        found, samples, share = analysis.find_total_hotspots(tree, top_n), "total_samples", "percentage"
    else:
        found, samples, share = analysis.find_hotspots(tree, top_n), "self_samples", "self_percentage"
    rows = found.select(truncated(F.col("function_name"), 38).alias("f"), samples, share).collect()
    kind = "Inclusive/Total" if show_inclusive else "Exclusive/Self"
    out = [f"\nTop {len(rows)} Hotspots ({kind} Time):", "-" * 70, f"{'Rank':<5} {'Function':<40} {'Samples':<12} {'%':<8}", "-" * 70]
    out += [f"{i:<5} {f:<40} {n:<12} {p:.1f}%" for i, (f, n, p) in enumerate(rows, 1)]
    return "\n".join([*out, "-" * 70])


def balance_table(tree: Tree) -> str:
    b = analysis.balance(tree).first()
    rows = [("Processes:", tree.process_count if b["process_samples"] is None else len(b["process_samples"])), ("Mean samples:", f"{b['mean_samples']:.1f}"), ("Std deviation:", f"{b['std_dev_samples']:.1f}"), ("Min samples:", f"{b['min_samples']:.0f} (process {b['least_loaded_process']})"), ("Max samples:", f"{b['max_samples']:.0f} (process {b['most_loaded_process']})"), ("Imbalance factor:", f"{b['imbalance_factor']:.2f}")]
    return "\n".join(["\nWorkload Balance Analysis:", "-" * 40, *[f"  {k:<17} {v}" for k, v in rows], "-" * 40])


def summary_report(averages: DataFrame, hotspots: DataFrame | None = None, top_n: int = 10) -> str:
    """Overheads by benchmark and scale and the leading functions, as text."""
    out = ["Benchmark  Processes  Time (s)  Overhead (%)"]
    out += [f"{r['benchmark']:<10} {r['num_processes']:<10} {r['execution_time_sec']:<9.2f} {r['overhead_percent']:.2f}" for r in averages.orderBy("benchmark", "num_processes").toLocalIterator()]
    if hotspots is not None:
        out += ["", "Function                            Exclusive (%)"]
        out += [f"{r['f']:<35} {r['exclusive_percentage']:.2f}" for r in hotspots.orderBy(F.desc("exclusive_samples"), "function_name").limit(top_n).select(truncated(F.col("function_name"), 32, "...").alias("f"), "exclusive_percentage").collect()]
    return "\n".join(out)


def chart_overhead(averages: DataFrame, path: str) -> bool:
    """A bar chart of mean overheads where matplotlib is installed; False otherwise."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        import matplotlib.pyplot as plt
    except ImportError:
        return False
    rows = averages.orderBy("benchmark", "num_processes").collect()
    fig, ax = plt.subplots()
    ax.bar([f"{r['benchmark']} {r['num_processes']}" for r in rows], [r["overhead_percent"] for r in rows])
    ax.set_ylabel("overhead (%)")
    fig.savefig(path)
    plt.close(fig)
    return True
