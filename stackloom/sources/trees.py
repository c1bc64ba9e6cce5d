"""Binary tree files as tables: one pass hops from node to node for places, then tasks decode stretches of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import from_arrow_schema

from stackloom.session import ready
from stackloom.sources.formats import TREE_HEADER, TREE_MAGIC, TREE_NODE, VERSION, signed
from stackloom.sources.staging import store_of

#: Nodes that a task decodes from one place.
STRETCH = 1 << 14
#: Bytes of decoded vectors in one batch.
BATCH = 16 << 20
NODES = pa.schema({
    "file": pa.string(), "node": pa.int64(), "parent": pa.int64(), "total_samples": pa.int64(), "self_samples": pa.int64(), "raw_address": pa.int64(), "offset": pa.int64(), "line_number": pa.int64(),
    "function_name": pa.string(), "library_name": pa.string(), "filename": pa.string(), "child_count": pa.int32(), "samples": pa.list_(pa.int64()), "times": pa.list_(pa.float64()),
})
_MARKS = "file string, at long, nodes long, processes long"


def _header(f, path: str) -> tuple[int, int]:
    """Numbers of nodes and of processes of a file."""
    raw = f.read(TREE_HEADER.size)
    if len(raw) < TREE_HEADER.size:
        raise ValueError(f"{path}: no whole header")
    magic, version, compression, _, nodes, processes, *_ = TREE_HEADER.unpack(raw)
    if magic != TREE_MAGIC or version > VERSION or compression:
        raise ValueError(f"{path}: not a tree file that can be read")
    return nodes, processes


def _marks(stretch: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of every stretch of nodes, by reading what tells a node's length alone."""
    for b in batches:
        for path in b.column("file").to_pylist():
            store, inner, _ = store_of(path)
            out, size = [], store.get_file_info(inner).size
            with store.open_input_file(inner) as f:
                nodes, processes = _header(f, path)
                at = TREE_HEADER.size
                for i in range(nodes):
                    if i % stretch == 0:
                        out.append({"file": path, "at": at, "nodes": min(stretch, nodes - i), "processes": processes})
                    f.seek(at)
                    raw = f.read(TREE_NODE.size)
                    at += TREE_NODE.size + sum(TREE_NODE.unpack(raw)[7:10]) + 16 * processes if len(raw) == TREE_NODE.size else size
                    if at > size or len(raw) < TREE_NODE.size:
                        raise ValueError(f"{path}: ends within node {i}")
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("at", pa.int64()), ("nodes", pa.int64()), ("processes", pa.int64())]))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for m in b.to_pylist():
            store, inner, _ = store_of(m["file"])
            n = m["processes"]
            rows = []
            with store.open_input_file(inner) as f:
                f.seek(m["at"])
                for _ in range(m["nodes"]):
                    node, parent, total, own, raw, offset, line, *sizes, children, _ = TREE_NODE.unpack(f.read(TREE_NODE.size))
                    names = [f.read(s).decode(errors="replace") for s in sizes]
                    values = f.read(16 * n)
                    rows.append((m["file"], node, parent, total, own, signed(raw), signed(offset), line, *names, children, np.frombuffer(values, "<i8", n), np.frombuffer(values, "<f8", n, 8 * n)))
                    if len(rows) * (16 * n + 200) > BATCH:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), NODES, strict=True)], schema=NODES)


def read_trees(spark: SparkSession, *paths: str, stretch: int = STRETCH) -> DataFrame:
    """Nodes (NODES) of tree files, samples and times by process from 0 on; a file that isn't whole fails the read.

    A file without nodes gives none.
    """
    files = ready(spark).createDataFrame([(p,) for p in paths], "file string")
    marks = files.repartition(max(1, min(len(paths), 1_000)), "file").mapInArrow(partial(_marks, stretch), _MARKS)
    return marks.repartition("file", "at").mapInArrow(_decode, from_arrow_schema(NODES))
