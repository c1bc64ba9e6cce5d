"""spark.read.format("pflw") and ("libmap"): Python data sources over the same decoders, and a writer of sample files.

Local paths are opened as such, others (hdfs://, s3://, gs://) by Arrow's file systems, on the driver and on executors
alike; stackloom.sources.files reads through binaryFile whatever else Spark reaches. Small files share a task. A file of more than splitBytes is read by several
tasks if duplicates=all: each finds for itself where entries begin. The writer's tasks leave files in a hidden folder,
which the commit moves into place, so retried tasks and failed jobs leave nothing.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import datasource as D
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stackloom.model import MAX_DEPTH, FileStatus
from stackloom.session import ready
from stackloom.sources.formats import MAP_HEADER, SAMPLE_HEADER, Entries, Fault, find_boundary, pack_entries, parse_samples, read_header, read_map_header, sample_header, walk_entries, walk_map
from stackloom.sources.staging import Staging, store_of

#: Bytes and number of files that share a task, bytes of a file beyond which several tasks may read it, bytes of a file
#: whose entries are held until all are known to be good (larger ones are read twice).
TASK_BYTES, TASK_FILES, SPLIT, HOLD = 32 << 20, 256, 128 << 20, 32 << 20
#: Bytes of a file's entries that wait before they are written as a part, and those of all files of a task.
PART_BYTES, WAITING = 8 << 20, 64 << 20
#: Bits of entry_ord that number the entries of one part of a split file; its upper bits number the parts.
PART_BITS = 40


def _rank(path: str) -> int:
    m = re.search(r"rank_(\d+)", os.path.basename(path))
    return int(m[1]) if m else -1


def _listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder at any depth, or of the one file; hidden folders are passed over."""
    from pyarrow import fs

    store, inner, prefix = store_of(path)
    if (info := store.get_file_info(inner)).type != fs.FileType.Directory:
        return [(path, info.size or 0)]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p.removeprefix(inner).split("/"))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not hidden(f.path))


def _paths(path: str, ending: str) -> list[str]:
    return [p for p, _ in _listed(path, ending)]


def _test(f: D.Filter, known: tuple[str, ...]):
    """The filter as a test of the known columns of a file, or None if it tells more than names can."""
    if isinstance(f, D.Not):
        child = _test(f.child, known)
        return child and (lambda row: not child(row))
    if getattr(f, "attribute", ("",))[0] not in known or len(f.attribute) != 1:
        return None
    name, value = f.attribute[0], getattr(f, "value", None)
    comparable = lambda x: x.encode() if isinstance(x, str) else x  # noqa: E731  # Spark orders texts by their bytes
    tests = {
        D.EqualTo: lambda x: x == value, D.EqualNullSafe: lambda x: x == value, D.In: lambda x: x in value, D.IsNotNull: lambda x: True, D.IsNull: lambda x: False,
        D.GreaterThan: lambda x: comparable(x) > comparable(value), D.GreaterThanOrEqual: lambda x: comparable(x) >= comparable(value),
        D.LessThan: lambda x: comparable(x) < comparable(value), D.LessThanOrEqual: lambda x: comparable(x) <= comparable(value),
        D.StringStartsWith: lambda x: x.startswith(value), D.StringEndsWith: lambda x: x.endswith(value), D.StringContains: lambda x: value in x,
    }
    one = tests.get(type(f))
    if one is None or value is None and type(f) not in (D.IsNull, D.IsNotNull, D.EqualNullSafe):
        return None
    return lambda row: one(row[name])


@dataclass
class _Files(InputPartition):
    """Whole files, or with part one part of a file: from the first entry at or after a byte to that of the next part."""

    paths: list[str]
    part: int | None = None
    size: int = 0


class _Reader(DataSourceReader):
    known: tuple[str, ...] = ("file",)

    def __init__(self, options: dict, ending: str) -> None:
        self.options, self.ending, self.filters = options, ending, []

    def option(self, name: str, default: str) -> str:
        return self.options.get(name, self.options.get(name.lower(), default))

    def fits(self, path: str) -> bool:
        tests = [_test(f, self.known) for f in self.filters]
        return all(t({"file": path, "process_id": _rank(path)}) for t in tests)

    def splits(self, size: int) -> int:
        return 1

    def partitions(self):
        out, held, total = [], [], 0
        for path, size in _listed(self.options["path"], self.ending):
            if not self.fits(path):
                continue
            if (parts := self.splits(size)) > 1:
                out += [_Files([path], i, size) for i in range(parts)]
                continue
            if held and (total + size > TASK_BYTES or len(held) >= TASK_FILES):
                out.append(_Files(held))
                held, total = [], 0
            held, total = [*held, path], total + size
        return [*out, _Files(held)] if held or not out else out

    def _opened(self, path: str):
        store, inner, _ = store_of(path)
        return store.open_input_file(inner)


class SampleReader(_Reader):
    known = ("file", "process_id")

    def __init__(self, options: dict, ending: str) -> None:
        super().__init__(options, ending)
        self.depth, self.reverse = int(self.option("max_depth", str(MAX_DEPTH))), self.option("frame_order", "root_first") == "leaf_first"
        self.last, self.bad = self.option("duplicates", "last") != "all", self.option("badFiles", "skip")
        self.split = max(4_096, int(self.option("splitBytes", str(SPLIT))))
        if self.bad not in ("skip", "fail", "report"):
            raise ValueError("badFiles is skip, fail or report")

    def splits(self, size: int) -> int:
        return 1 if self.last else max(1, -(-(size - SAMPLE_HEADER.size) // self.split))

    def read(self, partition: _Files):
        for path in partition.paths:
            try:
                yield from self._part(path, partition) if partition.part is not None else self._file(path)
            except (Fault, OSError) as e:
                status = e.status if isinstance(e, Fault) else FileStatus.FileOpen
                if self.bad == "fail" or partition.part is not None:  # what other parts have given can't be taken back
                    raise ValueError(f"{path}: {status.value}") from e
                if self.bad == "report":
                    yield self._batch(path, None, status)

    def _file(self, path: str):
        with self._opened(path) as f:
            entries = read_header(f.read(SAMPLE_HEADER.size))["entry_count"]
            walk = lambda: walk_entries(f.read, entries, self.depth)
            held, hashes = [] if f.size() <= HOLD else None, []
            for some in walk():
                if self.last:
                    hashes.append(some.hashes())
                if held is not None:
                    held.append(some)
            if held is None:
                f.seek(SAMPLE_HEADER.size)
            twice = np.zeros(0, np.uint64)
            if hashes:
                kinds, n = np.unique(np.concatenate(hashes), return_counts=True)
                twice = kinds[n > 1]
            repeated: dict[bytes, list[int]] = {}
            for some in walk() if held is None else held:
                if len(twice):
                    again = np.isin(some.hashes(), twice)
                    ends = np.cumsum(some.depths)
                    for i in np.flatnonzero(again).tolist():
                        stack = some.addrs[ends[i] - some.depths[i] : ends[i]].tobytes()
                        repeated.setdefault(stack, [some.first + i, 0])[1] = int(some.counts[i])
                    yield self._batch(path, some, FileStatus.Success, ~again)
                else:
                    yield self._batch(path, some, FileStatus.Success)
            if repeated:
                stacks = [np.frombuffer(k, "<i8") for k in repeated]
                some = Entries(0, np.array([n for _, n in repeated.values()], np.int64), np.array([len(x) for x in stacks], np.int64), np.concatenate(stacks))
                yield self._batch(path, some, FileStatus.Success, order=np.array([o for o, _ in repeated.values()], np.int64))

    def _part(self, path: str, partition: _Files):
        words, step = (partition.size - SAMPLE_HEADER.size) // 8, self.split // 8
        with self._opened(path) as f:
            read_header(f.read(SAMPLE_HEADER.size))

            def read_at(word: int, n: int) -> bytes:
                f.seek(SAMPLE_HEADER.size + 8 * word)
                return f.read(8 * n)

            start = find_boundary(read_at, words, partition.part * step, self.depth)
            if start is None:  # the part before reads on to the next boundary
                return
            stop, part = None, partition.part
            while stop is None:
                part += 1
                stop = find_boundary(read_at, words, part * step, self.depth)
            if stop <= start:
                return
            f.seek(SAMPLE_HEADER.size + 8 * start)
            for some in walk_entries(f.read, None, self.depth, stop - start):
                some.first += partition.part << PART_BITS
                yield self._batch(path, some, FileStatus.Success)

    def _batch(self, path: str, some: Entries | None, status: FileStatus, keep: np.ndarray | None = None, order: np.ndarray | None = None) -> pa.RecordBatch:
        if some is None:
            columns = [pa.array([path]), pa.array([_rank(path)], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.int64())]
        else:
            n, ends = len(some.counts), np.cumsum(some.depths)
            addrs = some.addrs
            if self.reverse:
                addrs = addrs[np.repeat(ends - 1 + (ends - some.depths), some.depths) - np.arange(len(addrs))]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(addrs, pa.int64()))
            order = np.arange(some.first, some.first + n) if order is None else order
            columns = [pa.array([path] * n, pa.string()), pa.array(np.full(n, _rank(path)), pa.int64()), pa.array(order, pa.int64()), lists, pa.array(some.counts, pa.int64())]
            if keep is not None:
                columns = [c.filter(pa.array(keep)) for c in columns]
        names = ["file", "process_id", "entry_ord", "addrs", "count"]
        if self.bad == "report":
            columns, names = [*columns, pa.array([status.value] * len(columns[0]), pa.string())], [*names, "status"]
        return pa.RecordBatch.from_arrays(columns, names=names)


class HeaderReader(_Reader):
    """Reads the first bytes of each file alone."""

    def read(self, partition: _Files):
        for path in partition.paths:
            try:
                with self._opened(path) as f:
                    p = parse_samples(f.read(SAMPLE_HEADER.size), header_only=True)
            except OSError:
                yield path, FileStatus.FileOpen.value, None, None, None, None
                continue
            h = p.header if p.status is FileStatus.Success else {}
            yield path, p.status.value, h.get("version"), h.get("entry_count"), h.get("max_depth"), h.get("timestamp")


class _Pushed:
    """Takes filters on what names tell. Spark 4.1 keeps the filtered files of a relation for its later scans, also for those
    without that filter, so only files.entries_where reads this way, which lets no other filter come near."""

    def pushFilters(self, filters):
        for f in filters:
            if _test(f, self.known) is not None:
                self.filters.append(f)
            else:
                yield f


class PushedSampleReader(_Pushed, SampleReader):
    pass


class PushedHeaderReader(_Pushed, HeaderReader):
    pass


class MapReader(_Reader):
    def read(self, partition: _Files):
        for path in partition.paths:
            try:
                with self._opened(path) as f:
                    p = read_map_header(f.read(MAP_HEADER.size))
                    if p.status is not FileStatus.Success:
                        continue
                    for _ in walk_map(f.read, p.header["library_count"]):  # rows leave when all are known to be good
                        pass
            except (Fault, OSError):
                continue
            with self._opened(path) as f:
                f.seek(MAP_HEADER.size)
                for some in walk_map(f.read, p.header["library_count"]):
                    yield from ((p.header["process_id"], *row) for row in some)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _packed(b: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(process, entries, their bytes) of a batch (process_id, addrs, count); the entries of a process stay in order."""
    b = b.select(["process_id", "addrs", "count"])
    if any(b.column(c).null_count for c in range(3)):
        raise ValueError("samples without a process, a stack or a count can't be written")
    process = b.column(0).cast(pa.int64()).to_numpy()
    order = np.argsort(process, kind="stable")
    process, lists = process[order], b.column(1).take(pa.array(order))
    counts, flat = b.column(2).cast(pa.int64()).to_numpy()[order], lists.flatten()
    if flat.null_count:
        raise ValueError("a stack holds no address")
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    addrs, depths = flat.cast(pa.int64()).to_numpy(), np.diff(ends)
    if (depths > MAX_DEPTH).any():
        addrs = addrs[np.arange(len(addrs)) - np.repeat(ends[:-1], depths) < MAX_DEPTH]
        depths = np.minimum(depths, MAX_DEPTH)
        ends = np.concatenate([[0], np.cumsum(depths)])
    cuts = [0, *(np.flatnonzero(np.diff(process)) + 1).tolist(), len(process)] if len(process) else [0]
    for i, j in zip(cuts, cuts[1:]):
        yield int(process[i]), j - i, pack_entries(depths[i:j], counts[i:j], addrs[ends[i] : ends[j]])


class _Body:
    """Entries of one file to be: what waits in memory, and parts that are written."""

    def __init__(self, name: str) -> None:
        self.name, self.held, self.size, self.entries, self.parts = name, [], 0, 0, 0

    def add(self, store, entries: int, body: bytes) -> int:
        """Takes entries; returns how many bytes no longer wait."""
        self.held.append(body)
        self.size, self.entries = self.size + len(body), self.entries + entries
        return self.spill(store) if self.size > PART_BYTES else 0

    def spill(self, store) -> int:
        if not self.held:
            return 0
        with store.open_output_stream(f"{self.name}.{self.parts}") as out:
            for some in self.held:
                out.write(some)
        size, self.held, self.size, self.parts = self.size, [], 0, self.parts + 1
        return size

    def close(self, store) -> None:
        """The whole file: its header tells how many entries follow, so it comes when all are known."""
        with store.open_output_stream(self.name) as out:
            out.write(sample_header(self.entries))
            for i in range(self.parts):
                with store.open_input_stream(f"{self.name}.{i}") as part:
                    while some := part.read(1 << 20):
                        out.write(some)
                store.delete_file(f"{self.name}.{i}")
            for some in self.held:
                out.write(some)


class SampleWriter(DataSourceArrowWriter):
    """One file per task and process, rank_P-part-N.pflw; entries are packed a batch at a time and written as they come."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite
        self.staging = Staging(self.path)

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, job = TaskContext.get(), self.staging.job
        store, _, _ = store_of(self.path)
        folder = self.staging.task_folder()
        files: dict[int, _Body] = {}
        waiting = 0
        for b in batches:
            for process, n, body in _packed(b):
                if process not in files:
                    files[process] = _Body(f"{folder}/rank_{process}-part-{context.partitionId():05d}-{job[:8]}.pflw")
                waiting += len(body) - files[process].add(store, n, body)
            if waiting > WAITING:
                for f in files.values():
                    f.spill(store)
                waiting = 0
        for f in files.values():
            f.close(store)
        return _Written([f.name for f in files.values()])

    def commit(self, messages) -> None:
        old = [store_of(p)[1] for p in _paths(self.path, ".pflw")] if self.overwrite else []
        self.staging.publish([f for m in messages if m is not None for f in m.files], old)

    def abort(self, messages) -> None:
        self.staging.discard()


class SampleSource(DataSource):
    """Entries of sample files. Options: frame_order (root_first, leaf_first), max_depth, headerOnly, and

    - duplicates: last (a stack that comes twice in a file counts as its last entry says, in the place of its first), or all
      (every entry), by which alone files of more than splitBytes are read by several tasks. entry_ord then numbers the entries
      of a part in its lower 40 bits and the parts in its upper ones; files.number_entries counts them through. Such a file
      ends with its last entry, and a fault in it is an error.
    - pushdown: true lets filters on file and process_id be settled from the names before a file is opened; for
      files.entries_where alone.
    - badFiles: skip (a file with a fault gives no rows), report (it gives one row with its status; a column status is
      added), or fail.
    """

    @classmethod
    def name(cls) -> str:
        return "pflw"

    @property
    def _headers(self) -> bool:
        return self.options.get("headeronly", self.options.get("headerOnly", "false")).lower() == "true"

    def schema(self) -> str:
        if self._headers:
            return "file string, status string, version int, entry_count long, max_depth long, timestamp long"
        report = self.options.get("badfiles", self.options.get("badFiles", "skip")) == "report"
        return "file string, process_id long, entry_ord long, addrs array<long>, count long" + ", status string" * report

    def reader(self, schema):
        pushed = self.options.get("pushdown", "false") == "true"
        kinds = (PushedHeaderReader, PushedSampleReader) if pushed else (HeaderReader, SampleReader)
        return kinds[not self._headers](dict(self.options), ".pflw")

    def writer(self, schema, overwrite):
        return SampleWriter(dict(self.options), overwrite)


class MapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "libmap"

    def schema(self) -> str:
        return "process_id long, ord int, base long, end long, executable boolean, name string"

    def reader(self, schema):
        return MapReader(dict(self.options), ".libmap")


def register(spark) -> None:
    """Make the formats known to a session, and let it push filters to them."""
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SampleSource)
    spark.dataSource.register(MapSource)
