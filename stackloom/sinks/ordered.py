"""One file of ordered rows, written by executors.

Rows are cut into ranges of their order. Each task writes its range as a part; the parts' sizes give the place of every part
in the file, and tasks copy them there. The driver sees names and sizes alone. This needs a file that tasks can write in the
middle of: one on the shared folder (spark.checkpoint.dir is a file: path), or any local one under a local master. Other
paths (a disk of the driver's own, an object store) get the parts one after the other through the driver, in pieces.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from stackloom.session import delete_on_exit, ready, scratch_dir, written
from stackloom.sources.staging import Staging, store_of

#: Bytes copied at a time.
PIECE = 8 << 20
Pack = Callable[[Iterator[pa.RecordBatch]], Iterable[bytes]]


@contextmanager
def opened(path: str, mode: str = "wb") -> Iterator:
    """A file to write. Paths with a scheme go to their store when all is written; others are local."""
    scheme = re.match(r"([a-zA-Z][\w+.-]+):", path)
    text = {} if "b" in mode else {"encoding": "utf-8"}
    if not scheme or scheme[1] == "file":
        with open(re.sub(r"^file:(//)?", "", path), mode, **text) as f:
            yield f
        return
    spark = SparkSession.active()
    with tempfile.TemporaryDirectory() as local:
        with open(os.path.join(local, "whole"), mode, **text) as f:
            yield f
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        p(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, p(f"file://{local}/whole"), p(path))


def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    """Texts of the column line, each with a line end."""
    for b in batches:
        if b.num_rows:
            yield ("\n".join(b.column("line").to_pylist()) + "\n").encode()


def _write_part(stage: Staging, pack: Pack, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, file, size = store_of(stage.path)[0], f"{stage.task_folder()}/part", 0
    with store.open_output_stream(file) as f:
        for some in pack(batches):
            size += f.write(some)
    yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "file": file, "size": size}] if size else [], pa.schema([("part", pa.int32()), ("file", pa.string()), ("size", pa.int64())]))


def _copy_parts(folder: str, whole: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copy parts to their places in a file of full length; doing it again does no harm."""
    store = store_of(folder)[0]
    for b in batches:
        for r in b.to_pylist():
            with store.open_input_stream(r["file"]) as f, open(whole, "r+b") as to:
                to.seek(r["at"])
                shutil.copyfileobj(f, to, PIECE)
        yield b.select(["size"])


def seen_by_tasks(spark: SparkSession, path: str) -> str | None:
    """The plain name of a file that tasks may open where they run, or None."""
    if re.match(r"[a-zA-Z][\w+.-]+:", path) and not path.startswith("file:"):
        return None
    plain, shared = os.path.abspath(re.sub(r"^file:(//)?", "", path)), scratch_dir(spark)
    if re.match(r"local($|\[)", spark.sparkContext.master):
        return plain
    return plain if shared.startswith("file:") and plain.startswith(os.path.abspath(re.sub(r"^file:(//)?", "", shared)) + os.sep) else None


def write_ordered(rows: DataFrame, path: str, place: list[str], pack: Pack = lines, head: bytes | Callable[[int], bytes] = b"", tail: bytes = b"") -> str:
    """head, the rows in the order of place as pack turns them into bytes, and tail, as one file; returns path.

    A head that tells the number of rows is a function of it.     Rows equal in the first column of place stay in one part. No rows: head and tail alone. An existing file is replaced
    when all parts are in.
    """
    spark = ready(rows.sparkSession)
    kept = written(rows, "lines")  # once: a cut by ranges reads its rows twice
    head = head(kept.count()) if callable(head) else head
    folder = delete_on_exit(spark, f"{scratch_dir(spark)}/stackloom-parts-{uuid.uuid4().hex}")
    stage = Staging(folder)
    try:
        cut = kept.repartitionByRange(place[0]).sortWithinPartitions(*place)
        parts = sorted(cut.mapInArrow(partial(_write_part, stage, pack), "part int, file string, size long").collect())
        at = list(accumulate((p["size"] for p in parts), initial=len(head)))
        plain = seen_by_tasks(spark, path)
        if plain is None:
            store = store_of(folder)[0]
            with opened(path) as to:
                to.write(head)
                for p in parts:
                    with store.open_input_stream(p["file"]) as f:
                        shutil.copyfileobj(f, to, PIECE)
                to.write(tail)
            return path
        whole = os.path.join(os.path.dirname(plain), f".{os.path.basename(plain)}.{stage.job}")
        try:
            with open(whole, "wb") as to:
                to.write(head)
                to.seek(at[-1])
                to.write(tail)
                to.truncate(at[-1] + len(tail))
            if parts:
                places = spark.createDataFrame([(p["file"], p["size"], a) for p, a in zip(parts, at, strict=False)], "file string, size long, at long")
                copied = places.repartition(min(len(parts), 1_000), "at").mapInArrow(partial(_copy_parts, folder, whole), "size long")
                if sum(r[0] for r in copied.collect()) != sum(p["size"] for p in parts):
                    raise OSError(f"parts of {path} were lost")
            os.replace(whole, plain)
        finally:
            if os.path.exists(whole):
                os.remove(whole)
        return path
    finally:
        stage.discard()
