"""Readers of sample files, library maps, process maps and benchmark output, as DataFrames.

Spark's binaryFile source lists binary files. Tasks open them by Arrow and decode them in pieces, so that memory doesn't grow
with a file; those of a store that only Spark reads come whole, as contents of that source. A file that can't be read
gives a status row instead of failing the job (one without any byte gives none: the source passes over it).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from stackloom.model import ANONYMOUS, LIB_MAP, MAX_DEPTH, SAMPLES, FileStatus, FileType
from stackloom.session import ready
from stackloom.sources.datasource import HOLD, PART_BITS, register
from stackloom.sources.formats import MAP_HEADER, SAMPLE_HEADER, Entries, Fault, parse_samples, read_header, read_map_header, unpack_libraries, walk_entries, walk_libraries
from stackloom.sources.staging import store_of

#: Rows that leave a decoder at once.
PIECE_ROWS = 50_000

SAMPLE_GLOB, MAP_GLOB = "*.pflw", "*.libmap"
# Names that the map of a rank R may have, the first being preferred (fixed values): ...rank_R..., process_R.libmap, R.libmap.
MAP_PATTERNS = (r"rank_(\d+)", r"process_(\d+)\.libmap$", r"^(\d+)\.libmap$")


def rank_of(path: Column) -> Column:
    """Digits after rank_ in a file's own name, -1 without; names of folders don't count."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.regexp_extract(name, r"rank_(\d+)", 1)
    return F.when(digits != "", digits.cast("long")).otherwise(F.lit(-1).cast("long"))


def map_rank_of(path: Column) -> Column:
    """(preference, rank) that the name of a library map tells by one of its patterns; rank -1 without."""
    name = F.element_at(F.split(path, "/"), -1)
    out = F.struct(F.lit(len(MAP_PATTERNS)).alias("preference"), F.lit(-1).cast("long").alias("rank"))
    for i, pattern in reversed(list(enumerate(MAP_PATTERNS))):
        digits = F.regexp_extract(name, pattern, 1)
        out = F.when(digits != "", F.struct(F.lit(i).alias("preference"), digits.try_cast("long").alias("rank"))).otherwise(out)
    return out


def file_type(path: Column) -> Column:
    ends = ((".pflw", FileType.SampleData), (".libmap", FileType.LibraryMap), (".ptree", FileType.PerformanceTree), (".txt", FileType.Text))
    out = F.lit(FileType.Unknown.value)
    for end, kind in ends:
        out = F.when(path.endswith(end), kind.value).otherwise(out)
    return out


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, modified, length, file_type, rank) of files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), "length", file_type(F.col("path")).alias("file_type"), rank_of(F.col("path")).alias("rank"))


def arrow_opens(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open the files of a path by Arrow: those of a file system, and of stores in which the driver finds it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if whole.startswith("file:"):
        return True
    try:
        store, inner, _ = store_of(whole)
        return store.get_file_info(inner).type != pa.fs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def binary(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """(path) of files, or (path, content) where Arrow can't open them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    schemes = {re.sub(r"^((\w[\w+.-]*:)(//[^/]*)?)?.*", r"\1", p): p for p in ([paths] if isinstance(paths, str) else paths)}
    return files.select("path") if all(arrow_opens(spark, p) for p in schemes.values()) else files.select("path", "content")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.NativeFile | None]]:
    """(path, open file) of rows (path) or (path, content); None if a file can't be opened."""
    for b in batches:
        for i, path in enumerate(b.column(0).to_pylist()):
            if b.num_columns > 1:
                yield path, pa.BufferReader(b.column(1)[i].as_buffer() or b"")
                continue
            store, inner, _ = store_of(path)
            try:
                f = store.open_input_file(inner)
            except OSError:
                f = None
            yield path, f


def _batch(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """n rows of a schema; single values are repeated, columns that are not given are null."""
    of = lambda f: columns.get(f.name)
    arrays = [x.cast(f.type) if isinstance(x := of(f), pa.Array) else pa.repeat(pa.scalar(x, f.type), n) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_DECODED = pa.schema(
    [("file", pa.string()), ("status", pa.string()), ("version", pa.int32()), ("compression", pa.int32()), ("entry_count", pa.int64()), ("max_depth", pa.int64()), ("header_process_id", pa.int64()), ("timestamp", pa.int64())]
    + [("rows", pa.int64()), ("process_id", pa.int64()), ("entry_ord", pa.int64()), ("addrs", pa.list_(pa.int64())), ("count", pa.int64())]
)


def _walked(f: pa.NativeFile | None, max_depth: int, header_only: bool, each: Callable[[Entries], None]) -> tuple[FileStatus, dict, int]:
    """(status, columns that tell of the header, entries) of a file whose entries all go to each, a piece at a time."""
    header, n, status = {}, 0, FileStatus.Success
    try:
        if f is None:
            raise Fault(FileStatus.FileOpen)
        head = f.read(SAMPLE_HEADER.size)
        header = parse_samples(head, header_only=True).header
        if not header:
            raise Fault(parse_samples(head, header_only=True).status)
        if not header_only:
            read_header(head)
            for some in walk_entries(f.read, header["entry_count"], max_depth):
                n += len(some.counts)
                each(some)
    except (Fault, OSError) as e:
        status, n = e.status if isinstance(e, Fault) else FileStatus.FileOpen, 0
    return status, {k: header.get(k) for k in ("version", "compression", "entry_count", "max_depth", "timestamp")}, n


def _rows(schema: pa.Schema, some: Entries, ahead: int = 0, **more) -> Iterator[pa.RecordBatch]:
    """Entries as rows, numbered from ahead on."""
    rows, ends = len(some.counts), pa.array(np.concatenate([[0], np.cumsum(some.depths)]), pa.int32())
    first = ahead + some.first
    whole = _batch(schema, rows, entry_ord=pa.array(np.arange(first, first + rows)), addrs=pa.ListArray.from_arrays(ends, pa.array(some.addrs, pa.int64())), count=pa.array(some.counts, pa.int64()), **more)
    yield from (whole.slice(i, PIECE_ROWS) for i in range(0, rows, PIECE_ROWS))


def _decode(path: str, f: pa.NativeFile | None, max_depth: int, header_only: bool) -> Iterator[pa.RecordBatch]:
    """The status row of a file and then its entries, once all of them are known to be good; large files are read twice."""
    held: list[Entries] = []
    hold = f is not None and f.size() <= HOLD
    status, told, n = _walked(f, max_depth, header_only, held.append if hold else lambda _: None)
    yield _batch(_DECODED, 1, file=path, status=status.value, rows=n, **told)
    if n and not hold:
        f.seek(SAMPLE_HEADER.size)
    for some in (held if hold else walk_entries(f.read, n, max_depth)) if n else ():
        yield from _rows(_DECODED, some, file=path, status=status.value)


def decode_samples(files: DataFrame, max_depth: int = MAX_DEPTH, header_only: bool = False) -> DataFrame:
    """One row per entry of every readable file and one status row per file (entry_ord null), from (path) or (path, content)."""

    def run(batches):
        for path, f in _opened(batches):
            yield from _decode(path, f, max_depth, header_only)
            if f is not None:
                f.close()

    return _fed(files).mapInArrow(run, from_arrow_schema(_DECODED))


_INDEXED = pa.schema([f for f in _DECODED if f.name not in ("process_id", "entry_ord", "addrs", "count")] + [("at", pa.int64()), ("first", pa.int64()), ("entries", pa.int64())])
_ENTRIES = pa.schema([("process_id", pa.int64()), ("file_no", pa.int64()), ("entry_ord", pa.int64()), ("addrs", pa.list_(pa.int64())), ("count", pa.int64())])


def _index(path: str, f: pa.NativeFile | None, max_depth: int) -> Iterator[pa.RecordBatch]:
    """The status row of a file, and a row for each piece of its entries if all of them are good: place, first entry, entries."""
    held: list[tuple[int, int, int]] = []
    at = SAMPLE_HEADER.size

    def keep(some: Entries) -> None:
        nonlocal at
        held.append((at, some.first, len(some.counts)))
        at += 8 * (2 * len(some.counts) + len(some.addrs))

    status, told, n = _walked(f, max_depth, False, keep)
    yield _batch(_INDEXED, 1, file=path, status=status.value, rows=n, **told)
    if n:
        columns = {c: pa.array(x, pa.int64()) for c, x in zip(("at", "first", "entries"), zip(*held))}
        yield _batch(_INDEXED, len(held), file=path, status=status.value, **columns)


def index_samples(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One status row per file (at null) and one row for each piece of the entries of a readable one, from (path).

    A file is walked by one task, which keeps a few numbers for 8 MB of it; entries_of decodes the pieces in as many as there are.
    """

    def run(batches):
        for path, f in _opened(batches):
            yield from _index(path, f, max_depth)
            if f is not None:
                f.close()

    return _fed(files).mapInArrow(run, from_arrow_schema(_INDEXED))


#: Bits that number the entries of a file where entries of several files are told apart by one number.
ENTRY_BITS = 40
#: Tasks that decode pieces of files at most.
DECODERS = 4_096


def entries_of(index: DataFrame, process_ids: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Entries (process_id, file_no, entry_ord, addrs, count) of indexed files, by process_ids (file, file_no, process_id).

    entry_ord has the file's number in its upper bits.
    """
    pieces = index.where("at is not null").join(process_ids, "file").select("file", "at", "first", "entries", "file_no", "process_id")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                store, inner, _ = store_of(r["file"])
                with store.open_input_file(inner) as f:
                    f.seek(r["at"])
                    for some in walk_entries(f.read, r["entries"], max_depth):
                        yield from _rows(_ENTRIES, some, (r["file_no"] << ENTRY_BITS) + r["first"], process_id=r["process_id"], file_no=r["file_no"])

    dealt = pieces.repartition(max(1, min(pieces.count(), DECODERS)))
    return dealt.mapInArrow(run, from_arrow_schema(_ENTRIES))


def _fed(files: DataFrame) -> DataFrame:
    ready(files.sparkSession)
    return files.select("path", *(c for c in files.columns if c == "content"))


def status_of(decoded: DataFrame) -> DataFrame:
    """(file, status, version, compression, entry_count, max_depth, timestamp, rows): one row per file, of decoded or indexed ones."""
    return decoded.where(F.col("at" if "at" in decoded.columns else "entry_ord").isNull()).select("file", "status", "version", "compression", "entry_count", "max_depth", F.timestamp_seconds("timestamp").alias("created"), "rows")


def samples_of(decoded: DataFrame, process_ids: DataFrame | None = None, duplicates: str = "last") -> DataFrame:
    """Samples (file, process_id, entry_ord, addrs, count) of decoded files.

    process_ids (file, process_id) names the process of a file; without it the rank in the file's name does. A stack
    that comes twice in one file counts as its last entry says, or adds up with duplicates='sum'.
    """
    rows = decoded.where("entry_ord is not null")
    if process_ids is not None:
        rows = rows.drop("process_id").join(process_ids, "file")
    else:
        rows = rows.withColumn("process_id", rank_of(F.col("file")))
    total = F.sum("count") if duplicates == "sum" else F.max_by("count", "entry_ord")
    by = rows.groupBy("file", "process_id", "addrs").agg(F.min("entry_ord").alias("entry_ord"), total.alias("count"))
    return by.select(*SAMPLES.fieldNames())


def read_samples(spark: SparkSession, paths: str | list[str], max_depth: int = MAX_DEPTH, glob: str | None = None, duplicates: str = "last") -> tuple[DataFrame, DataFrame]:
    """(samples, file statuses) of files or folders. Files that fail give no samples."""
    decoded = decode_samples(binary(spark, paths, glob), max_depth)
    return samples_of(decoded, duplicates=duplicates), status_of(decoded)


def number_entries(entries: DataFrame) -> DataFrame:
    """format("pflw") with duplicates=all: entry_ord counted through the parts of split files, as one task would."""
    part = F.shiftright("entry_ord", PART_BITS)
    sizes = entries.groupBy("file", part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each part
    starts = sizes.select("file", "part", before.alias("before"))
    low = F.col("entry_ord").bitwiseAND((1 << PART_BITS) - 1)
    return entries.withColumn("part", part).join(starts, ["file", "part"]).withColumn("entry_ord", F.col("before") + low).select(*entries.columns)


def entries_where(spark: SparkSession, path: str, condition: Column, **options: str) -> DataFrame:
    """format("pflw") of the entries that meet a condition; what it says of file and process_id is settled from the names.

    Files that don't meet it are never opened. Later filters stay above this one: the rows pass an observation
    (stackloom_entries, their number), through which Spark pushes none, because relations of Python sources take the filters
    of one scan over to others.
    """
    register(spark)
    rows = spark.read.format("pflw").options(pushdown="true", **options).load(path)
    return rows.where(F.col("file").isNotNull() & condition).observe(f"stackloom_entries_{uuid.uuid4().hex}", F.count(F.lit(1)).alias("entries"))


def last_entries(entries: DataFrame) -> DataFrame:
    """format("pflw") with duplicates=all: the rows of duplicates=last, by a shuffle instead of one task a file."""
    by = entries.groupBy("file", "process_id", "addrs").agg(F.min("entry_ord").alias("entry_ord"), F.max_by("count", "entry_ord").alias("count"))
    return by.select(*SAMPLES.fieldNames())


def read_headers(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """Headers alone; a file with the right magic number counts as Success whatever its version."""
    return status_of(decode_samples(binary(spark, paths, glob), header_only=True))


_MAPPED = pa.schema([("file", pa.string()), ("status", pa.string()), ("header_process_id", pa.int64()), ("ord", pa.int32()), ("base", pa.int64()), ("end", pa.int64()), ("executable", pa.bool_()), ("name", pa.string())])


def _decode_map(path: str, f: pa.NativeFile | None) -> Iterator[pa.RecordBatch]:
    """The status row of a map and then its libraries; the map is read twice, so that rows leave when all are known to be good."""
    header, status = {}, FileStatus.FileOpen
    try:
        if f is not None:
            p = read_map_header(f.read(MAP_HEADER.size))
            header, status = p.header, p.status
            if status is FileStatus.Success:
                for _ in walk_libraries(f.read, header["library_count"]):
                    pass
    except (Fault, OSError) as e:
        status = e.status if isinstance(e, Fault) else FileStatus.FileOpen
    told = {"file": path, "status": status.value, "header_process_id": header.get("process_id")}
    yield _batch(_MAPPED, 1, **told)
    if status is FileStatus.Success:
        f.seek(MAP_HEADER.size)
        for first, held, at in walk_libraries(f.read, header["library_count"]):
            base, end, executable, name = unpack_libraries(held, at)
            columns = {"ord": pa.array(np.arange(first, first + len(at)), pa.int32()), "base": pa.array(base), "end": pa.array(end), "executable": pa.array(executable), "name": name}
            yield _batch(_MAPPED, len(at), **told, **columns)


def decode_maps(files: DataFrame) -> DataFrame:
    """One row per library of every readable map and one status row per file (ord null), from (path) or (path, content)."""

    def run(batches):
        for path, f in _opened(batches):
            yield from _decode_map(path, f)
            if f is not None:
                f.close()

    return _fed(files).mapInArrow(run, from_arrow_schema(_MAPPED))


def maps_of(decoded: DataFrame, process_ids: DataFrame | None = None) -> DataFrame:
    """Library maps; process_ids (file, process_id) overrules the process in the header."""
    rows = decoded.where("ord is not null")
    if process_ids is not None:
        rows = rows.join(process_ids, "file")
    else:
        rows = rows.withColumn("process_id", F.col("header_process_id"))
    return rows.select(*LIB_MAP.fieldNames())


def read_maps(spark: SparkSession, paths: str | list[str], process_ids: DataFrame | None = None, glob: str | None = None) -> DataFrame:
    return maps_of(decode_maps(binary(spark, paths, glob)), process_ids)


def count_ok(statuses: DataFrame) -> int:
    return statuses.where(F.col("status") == FileStatus.Success.value).count()


def read_process_maps(spark: SparkSession, path: str | list[str], process_id: int = 0) -> DataFrame:
    """Library map of /proc/*/maps text: executable lines in order, malformed ones left out, unnamed ones [anonymous]."""
    text = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    line = r"^([0-9a-fA-F]+)-([0-9a-fA-F]+)\s+(\S{4})\s+[0-9a-fA-F]+\s+\S+\s+\d+\s*(.*)$"
    part = lambda i: F.regexp_extract("value", line, i)
    rows = text.where(part(1) != "").where(F.substring(part(3), 3, 1) == "x")
    num = lambda i: F.conv(part(i), 16, -10).cast("long")  # noqa: E731  # signed: the bits of addresses of 2^63 and more
    name = F.when(F.trim(part(4)) == "", ANONYMOUS).otherwise(F.trim(part(4)))
    # A process has a few hundred maps at most, so that their order may come from one task.
    return rows.select(F.lit(process_id).cast("long").alias("process_id"), (F.row_number().over(Window.orderBy("at")) - 1).alias("ord"), num(1).alias("base"), num(2).alias("end"), F.lit(True).alias("executable"), name.alias("name"))


def pair_files(samples: DataFrame, maps: DataFrame) -> DataFrame:
    """Sample files with the map file of their rank, null without; both from list_files. Of several maps the name decides."""
    m = maps.select("path", map_rank_of(F.col("path")).alias("told")).where("told.rank >= 0").groupBy("told.rank").agg(F.min_by("path", F.struct("told.preference", "path")).alias("map_path"))
    return samples.join(m, "rank", "left").select("path", "rank", "map_path")


def read_benchmark_output(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, benchmark, class, num_processes, iteration, execution_time_sec, mop_total, mop_per_sec) of run logs.

    File names are benchmark.class.procs.iteration or run folders benchmark_class_npN_iterM; figures that a log lacks are 0.
    """
    text = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), "value")
    value = lambda label: F.coalesce(F.regexp_extract("value", rf"(?im)^\s*{label}\s*=\s*([0-9.eE+-]+)", 1).try_cast("double"), F.lit(0.0))
    run = r"([a-z]+)[._]([A-Z])[._](?:np)?(\d+)[._](?:iter)?(\d+)"
    part = lambda i: F.regexp_extract("file", run, i)
    return text.select("file", part(1).alias("benchmark"), part(2).alias("class"), part(3).try_cast("int").alias("num_processes"), part(4).try_cast("int").alias("iteration"), value("Time in seconds").alias("execution_time_sec"), value("Mop/s total").alias("mop_total"), value("Mop/s/process").alias("mop_per_sec"))


def find_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(run, benchmark, class, num_processes, iteration) of the run folders below a folder."""
    files = list_files(spark, folder).select(F.regexp_extract("path", r"([^/]+_[A-Z]_np\d+_iter\d+)/", 1).alias("run")).where("run <> ''").distinct()
    part = lambda i: F.regexp_extract("run", r"^(.+)_([A-Z])_np(\d+)_iter(\d+)$", i)
    return files.select("run", part(1).alias("benchmark"), part(2).alias("class"), part(3).cast("int").alias("num_processes"), part(4).cast("int").alias("iteration"))


BASELINE_CSV = "benchmark string, class string, num_processes int, iteration int, execution_time_sec double, mop_total double, mop_per_sec double"
OVERHEAD_CSV = "benchmark string, class string, num_processes int, iteration int, execution_time_sec double, baseline_time_sec double, overhead_percent double, mop_total double, mop_per_sec double"
HOTSPOT_JSON = "total_samples long, hotspots array<struct<function:string,library:string,filename:string,line_number:int,exclusive_samples:long,inclusive_samples:long,exclusive_percentage:double,inclusive_percentage:double>>"


def read_results_csv(spark: SparkSession, paths: str | list[str], kind: str = "overhead") -> DataFrame:
    """Baseline or overhead results; N/A is null."""
    return spark.read.csv(paths, header=True, schema=OVERHEAD_CSV if kind == "overhead" else BASELINE_CSV, nullValue="N/A")


def read_hotspots_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Hotspots of runs, one row per function: run_id, total_samples, function_name, library_name, ..."""
    rows = spark.read.json(paths, schema=HOTSPOT_JSON, multiLine=True).select(F.input_file_name().alias("run_id"), "total_samples", F.explode("hotspots").alias("h"))
    return rows.select("run_id", "total_samples", F.col("h.function").alias("function_name"), F.col("h.library").alias("library_name"), "h.filename", "h.line_number", "h.exclusive_samples", "h.inclusive_samples")
