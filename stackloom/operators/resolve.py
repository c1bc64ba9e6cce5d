"""Addresses to libraries, offsets and symbols."""

from __future__ import annotations

import subprocess
from itertools import islice
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.callstack import SIGN, distance, root_first, unsigned
from stackloom.model import UNKNOWN, UNRESOLVED, ResolveStrategy
from stackloom.operators.stabbing import add_many, keyed, stab
from stackloom.session import ready
from stackloom.sources.formats import WORD

if TYPE_CHECKING:
    from stackloom.operators.symbol_store import SymbolStore

#: Below this base a library is taken as loaded at fixed addresses, and offsets are the addresses themselves.
STATIC_BASE = 0x10000000
#: Ranges that go to every task at most, some 10 MB of them; beyond, ranges and addresses meet in slices of their order.
BROADCAST_RANGES = 100_000

# Distances that a linker may have put between segments and offsets (fixed values), tried in this order.
SEGMENT_SHIFTS = (0, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x8000, 0xA000, 0x10000)


def offset_of(address: Column, base: Column) -> Column:
    return F.when(unsigned(base) < STATIC_BASE + SIGN, address).otherwise(distance(address, base))


def resolve_addresses(addresses: DataFrame, lib_map: DataFrame, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """addresses (process_id, address) with library_name and offset.

    The first executable range in file order (ord) that holds the address decides. A process without any map gives
    [unknown], an address outside all ranges [unresolved]; the offset is then the address. Work is done once per
    different address of a process. Addresses count as unsigned: those of 2^63 and more are negative longs. Planning runs
    a job that reads up to ``broadcast_ranges`` ranges and one more; where there are more, it writes addresses in slices.
    """
    found = stab(addresses, lib_map, broadcast_ranges)
    known = lib_map.select("process_id", F.lit(True).alias("mapped")).distinct()
    address, base = F.col("address"), F.col("base")
    return found.join(known, "process_id", "left").select(
        "process_id", "address", F.coalesce("name", F.when(F.col("mapped"), F.lit(UNRESOLVED)).otherwise(F.lit(UNKNOWN))).alias("library_name"),
        F.coalesce(offset_of(address, base), address).alias("offset"),
    )


def latest_maps(lib_map: DataFrame, order: str = "loaded") -> DataFrame:
    """Where a process has several maps, the rows of the one loaded last (column ``order``)."""
    last = lib_map.groupBy("process_id").agg(F.max(order).alias("_last"))
    return lib_map.join(last, "process_id").where(F.col(order) == F.col("_last")).drop("_last")


def resolve_samples(samples: DataFrame, lib_map: DataFrame, symbols: DataFrame | None = None, frame_order: str = "root_first", time_per_sample: float = 1000.0, key: tuple[str, ...] = ("process_id", "entry_ord")) -> DataFrame:
    """Stacks, root first, of samples (process_id, entry_ord, addrs, count); entry_ord, or all of key, tells the samples of a process apart.

    A process without a map keeps [unknown] as library and function; with one, functions come from symbols (library,
    offset), else stay empty. Symbols are looked up for resolved addresses alone.
    """
    s = samples.withColumn("addrs", root_first(F.col("addrs"), frame_order)).select(*key, "addrs", "count")
    each = s.select("process_id", F.explode(F.array_distinct("addrs")).alias("address")).distinct()
    frames = resolve_addresses(each, lib_map)
    if symbols is not None:
        y = symbols.groupBy(F.col("library").alias("library_name"), "offset").agg(F.min(F.struct("function_name", "filename", "line_number")).alias("y"))
        frames = frames.join(y.hint("merge"), ["library_name", "offset"], "left")
        frames = frames.select("process_id", "address", "library_name", "offset", F.when(~F.col("library_name").isin(UNKNOWN, UNRESOLVED), F.col("y")).alias("y"))
    else:
        frames = frames.withColumn("y", F.lit(None).cast("struct<function_name:string,filename:string,line_number:int>"))
    name = F.when(F.col("library_name") == UNKNOWN, F.lit(UNKNOWN)).otherwise(F.coalesce("y.function_name", F.lit("")))
    frame = F.struct(F.col("address").alias("raw_address"), "offset", "library_name", name.alias("function_name"), F.coalesce("y.filename", F.lit("")).alias("filename"), F.coalesce("y.line_number", F.lit(0)).alias("line_number"))
    frames = frames.select("process_id", "address", frame.alias("frame"))
    # By a shuffle whatever Spark takes the frames for: sizes of compressed sources have made it send millions of them to the driver.
    placed = s.select(*key, "count", F.posexplode_outer("addrs").alias("pos", "address")).join(frames.hint("merge"), ["process_id", "address"], "left")
    found = F.collect_list(F.when(F.col("frame").isNotNull(), F.struct("pos", "frame")))
    whole = placed.groupBy(*key).agg(F.transform(F.array_sort(found), lambda x: x["frame"]).alias("frames"), F.first("count").alias("count"))
    return whole.select(*key, "frames", "count", (F.col("count") * F.lit(float(time_per_sample))).alias("time_us"))


def last_counts(entries: DataFrame) -> DataFrame:
    """Samples of entries of files: a stack that comes twice in one file counts as its last entry says, in the place of its first."""
    by = entries.groupBy("process_id", "file_no", "addrs").agg(F.min("entry_ord").alias("entry_ord"), F.max_by("count", "entry_ord").alias("count"))
    return by.select("process_id", "entry_ord", "addrs", "count")


def resolve_added(entries: DataFrame, lib_map: DataFrame, frame_order: str = "root_first", time_per_sample: float = 1000.0, by_offset: bool = False, few: int = BROADCAST_RANGES) -> DataFrame:
    """resolve_samples of entries of files (process_id, file_no, entry_ord, addrs, count) without symbols, for a tree: the same sums
    of equal stacks of a process, in fewer rows. Entries are read several times (``written``). A stack that comes twice in one file counts as its last entry says.

    With more than ``few`` ranges, samples of one frame go through the slices of the ranges whole: what a slice finds equal (in
    library, and in offset if by_offset) leaves it as one row with the first entry_ord, and no sample is put together again from its frames.
    Deeper samples take the way of resolve_samples. Empty ones, which count nowhere in a tree, are left out.
    """
    ready(entries.sparkSession)
    ranges = keyed(lib_map)
    if ranges.limit(few + 1).count() <= few:
        return resolve_samples(last_counts(entries), lib_map, None, frame_order, time_per_sample)
    known = lib_map.select("process_id", F.lit(True).alias("mapped")).distinct()
    address, base = F.col("address"), F.col("base")
    single = entries.where("size(addrs) = 1").select("process_id", "file_no", F.col("addrs")[0].alias("address"), "entry_ord", "count")
    found = add_many(single, ranges, by_offset).join(known, "process_id", "left")
    library = F.coalesce("name", F.when(F.col("mapped"), F.lit(UNRESOLVED)).otherwise(F.lit(UNKNOWN)))
    function = F.when(library == UNKNOWN, F.lit(UNKNOWN)).otherwise(F.lit(""))
    frame = F.struct(address.alias("raw_address"), F.coalesce(offset_of(address, base), address).alias("offset"), library.alias("library_name"), function.alias("function_name"), F.lit("").alias("filename"), F.lit(0).alias("line_number"))
    out = found.select("process_id", "entry_ord", F.array(frame).alias("frames"), "count", (F.col("count") * F.lit(float(time_per_sample))).alias("time_us"))
    deep = entries.where("size(addrs) > 1")
    return out.unionByName(resolve_samples(last_counts(deep), lib_map, None, frame_order, time_per_sample)) if deep.limit(1).count() else out


def parse_addr2line(function: str, location: str) -> tuple[str, str, int] | None:
    """(function, file, line) of addr2line's two lines, or None if nothing is known; ?? stands for unknown."""
    function, location = function.rstrip("\r\n "), location.rstrip("\r\n ")
    if function in ("", "??"):
        function = ""
    path, colon, number = location.rpartition(":")
    if not colon or path in ("", "??"):
        return (function, "", 0) if function else None
    digits = number.split(" ")[0]
    return function, path, int(digits) if digits.isdigit() else 0


#: Offsets that a symbolizer gets at once on its standard input, and seconds that it may take for them.
ASKED, SECONDS = 20_000, 300


def _ask(tool: str, library: str, offsets: list[int]) -> tuple[list[tuple[str, str, int] | None], str]:
    """(what the tool knows of each offset, status) of one call; arguments never pass a shell."""
    try:
        out = subprocess.run([tool, "-f", "-C", "-e", library], input="".join(f"{x & WORD:#x}\n" for x in offsets), capture_output=True, text=True, errors="replace", timeout=SECONDS, check=False)
    except subprocess.TimeoutExpired:
        return [], "Timeout"
    except OSError as e:
        return [], f"NotRun: {e.strerror or e}"
    lines = out.stdout.splitlines()
    if out.returncode:
        return [], f"Failed: {(out.stderr.strip().splitlines() or [out.returncode])[-1]}"
    if len(lines) < 2 * len(offsets):
        return [], "ShortOutput"
    return [parse_addr2line(lines[2 * i], lines[2 * i + 1]) for i in range(len(offsets))], "Success"


def symbolize(frames: DataFrame, tool: str = "addr2line", statuses: bool = False, unknown: bool = False) -> DataFrame:
    """symbols (library, offset, function_name, filename, line_number) of frames by a symbolizer on the executors.

    Different (library, offset) pairs are asked for in chunks on standard input, whatever their number. A chunk that fails
    (library or tool absent, time out, short output) costs no other chunk its symbols; with statuses, a further
    column status tells of each symbol Success, and each failed chunk gives a row with its status and no offset. With unknown, offsets
    that the tool was asked for and knows nothing of come too, without a name (status Unknown).
    """
    ready(frames.sparkSession)
    asked = frames.select(F.col("library_name").alias("library"), "offset").distinct()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for library, group in pdf.groupby("library"):
                left = iter(sorted(int(x) for x in group["offset"]))
                while chunk := list(islice(left, ASKED)):
                    for shift in SEGMENT_SHIFTS:
                        found, status = _ask(tool, str(library), [x + shift for x in chunk])
                        if status != "Success":
                            rows.append((library, None, None, None, None, status))
                            break
                        rows += [(library, x, *y, status) for x, y in zip(chunk, found) if y]
                        chunk = [x for x, y in zip(chunk, found) if not y]
                        if not chunk:
                            break
                    else:
                        rows += [(library, x, None, None, None, "Unknown") for x in chunk if unknown]
            yield pd.DataFrame(rows, columns=["library", "offset", "function_name", "filename", "line_number", "status"]).astype({"offset": "Int64", "line_number": "Int32"})

    out = asked.mapInPandas(run, "library string, offset long, function_name string, filename string, line_number int, status string")
    return out if statuses else out.where("offset is not null").drop("status")


def find_symbols(frames: DataFrame, symbols: DataFrame | None = None, strategy: ResolveStrategy = ResolveStrategy.AutoFallback, tool: str = "addr2line", store: SymbolStore | None = None) -> DataFrame | None:
    """Symbols for frames (library_name, offset) by a strategy: of the table, of the symbolizer, or of the symbolizer for
    what the table lacks. None where the strategy leaves nothing to look in. A store keeps what the symbolizer answers."""
    ask = (lambda x: store.symbols(x, tool)) if store else (lambda x: symbolize(x, tool))
    if strategy is ResolveStrategy.TableOnly:
        return symbols
    known = frames.where(~F.col("library_name").isin(UNKNOWN, UNRESOLVED))
    if strategy is ResolveStrategy.Addr2LineOnly or symbols is None:
        return ask(known)
    have = symbols.select(F.col("library").alias("library_name"), "offset").distinct()
    lack = known.select("library_name", "offset").distinct().join(have, ["library_name", "offset"], "left_anti")
    return symbols.unionByName(ask(lack))


def symbol_statistics(stacks: DataFrame) -> DataFrame:
    """One row: frames looked up, different (library, offset) pairs among them, how many of those have a symbol, and the
    share of look-ups that found their pair already seen."""
    seen = stacks.select(F.explode("frames").alias("x")).where(~F.col("x.library_name").isin(UNKNOWN, UNRESOLVED))
    pairs = seen.groupBy("x.library_name", "x.offset").agg(F.count("*").alias("n"), F.max(F.col("x.function_name") != "").alias("named"))
    row = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lookups"), F.count("*").alias("cached"), F.coalesce(F.sum(F.col("named").cast("long")), F.lit(0)).alias("resolved"))
    return row.withColumn("hit_rate", F.when(F.col("lookups") > 0, 1 - F.col("cached") / F.col("lookups")).otherwise(F.lit(0.0)))


class OffsetConverter:
    """Maps by process, and how symbols are found: a registry of DataFrames for resolve_samples."""

    def __init__(self, symbols: DataFrame | None = None, strategy: ResolveStrategy = ResolveStrategy.TableOnly, tool: str = "addr2line", store: SymbolStore | None = None) -> None:
        self._maps: dict[int, DataFrame] = {}
        self.store = store
        self._symbols, self.strategy, self.tool = symbols, strategy, tool

    def add_map_snapshot(self, process_id: int, lib_map: DataFrame) -> None:
        """A map for a process; a second one replaces the first."""
        self._maps[process_id] = lib_map.withColumn("process_id", F.lit(process_id).cast("long"))

    def has_snapshot(self, process_id: int) -> bool:
        return process_id in self._maps

    @property
    def snapshot_count(self) -> int:
        return len(self._maps)

    def clear(self) -> None:
        self._maps.clear()

    def set_symbol_table(self, symbols: DataFrame | None) -> None:
        self._symbols = symbols

    @property
    def has_symbol_table(self) -> bool:
        return self._symbols is not None

    def lib_map(self, like: DataFrame) -> DataFrame:
        """All maps as one table; an empty one with like's session if there are none."""
        from stackloom.model import LIB_MAP

        out = like.sparkSession.createDataFrame([], LIB_MAP)
        for m in self._maps.values():
            out = out.unionByName(m.select(*out.columns))
        return out

    def convert(self, samples: DataFrame, frame_order: str = "root_first") -> DataFrame:
        lib_map, symbols = self.lib_map(samples), self._symbols
        if self.strategy is not ResolveStrategy.TableOnly:
            asked = samples.select("process_id", F.explode(F.array_distinct("addrs")).alias("address"))
            symbols = find_symbols(resolve_addresses(asked, lib_map), symbols, self.strategy, self.tool, self.store)
        return resolve_samples(samples, lib_map, symbols, frame_order)
