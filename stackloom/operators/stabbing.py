"""The first range in file order that holds an address, for ranges and addresses of any number.

Ranges of a process may overlap; the smallest ord decides. A sweep over range boundaries with a heap on ord turns ranges
into stretches that one range decides each, and a binary search finds an address's stretch. Few ranges go to all tasks.
Many are cut into slices of the order (process, address), each of so many boundaries and addresses at most, so that a task
holds the same however many there are; a process with most of the ranges or addresses has many slices. A range goes to the slices of its two ends; of those that cover all
of a slice only the smallest ord matters there, as of those that reach into it up to the same end.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions.callstack import SIGN, unsigned
from stackloom.session import ready, written

LOW, HIGH = SIGN, -SIGN - 1
FOUND = "process_id long, address long, base long, name string"
#: Boundaries and addresses of a slice are at most 2 to this power.
SLICE_BITS = 16


def stretches(first: list[int], last: list[int], ord_: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, place of the deciding range or -1) of the stretches that ranges [first, last] make; equal ords: the earlier place."""
    order = sorted(range(len(first)), key=first.__getitem__)
    points = sorted({*first, *(x + 1 for x in last if x < HIGH)})
    open_: list[tuple[int, int]] = []
    starts, decides, i = [], [], 0
    for at in points:
        while i < len(order) and first[order[i]] == at:
            heapq.heappush(open_, (ord_[order[i]], order[i]))
            i += 1
        while open_ and last[open_[0][1]] < at:
            heapq.heappop(open_)
        now = open_[0][1] if open_ else -1
        if not decides or decides[-1] != now:
            starts.append(at)
            decides.append(now)
    return np.array(starts, np.int64), np.array(decides, np.int64)


class Ranges:
    """Stretches by process of a table (process_id, first, last, ord, base, name), first and last as signed keys."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("process_id", "ascending"), ("ord", "ascending"), ("base", "ascending"), ("name", "ascending")]).combine_chunks()
        self.base, self.name = table["base"], table["name"]
        process = table["process_id"].to_numpy()
        columns = [table[c].to_pylist() for c in ("first", "last", "ord")]
        cuts = [0, *(np.flatnonzero(process[1:] != process[:-1]) + 1).tolist(), len(process)] if len(process) else [0]
        self.held = {}
        for i, j in zip(cuts, cuts[1:]):
            starts, decides = stretches(*(c[i:j] for c in columns))
            self.held[int(process[i])] = starts, np.where(decides < 0, -1, decides + i)

    def places(self, process: pa.Array, address: pa.Array) -> np.ndarray:
        """The deciding range of each address, -1 where there is none or where it or its process is null."""
        p, a = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (process, address))
        k = a ^ np.int64(SIGN)
        hit = np.full(len(p), -1, np.int64)
        order = np.argsort(p, kind="stable")
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(p[order])) + 1, [len(p)]]) if len(p) else np.zeros(1, np.int64)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            starts, decides = self.held.get(int(p[order[i]]), (None, None))
            if starts is not None:
                at = np.searchsorted(starts, k[order[i:j]], side="right") - 1
                hit[order[i:j]] = np.where(at < 0, -1, decides[at])
        known = pc.and_(pc.is_valid(process), pc.is_valid(address)).to_numpy(zero_copy_only=False)
        return np.where(known, hit, -1)

    def find(self, process: pa.Array, address: pa.Array) -> list[pa.Array]:
        """Columns of FOUND; base and name are null where no range holds the address, or it or its process is null."""
        return [process, address, *self.at(self.places(process, address))]

    def at(self, hit: np.ndarray) -> list[pa.Array]:
        """Bases and names of ranges by their places, null for -1."""
        place = pa.array(hit, mask=hit < 0)
        whole = lambda x: x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
        return [whole(x.take(place)) for x in (self.base, self.name)]


def keyed(lib_map: DataFrame) -> DataFrame:
    """Executable ranges (process_id, first, last, ord, base, name) that hold an address at all; first and last order as unsigned."""
    first, end = unsigned(F.col("base")), unsigned(F.col("end"))
    kept = lib_map.where(F.col("executable") & (first < end) & F.col("process_id").isNotNull() & F.col("ord").isNotNull())
    return kept.select(F.col("process_id").cast("long").alias("process_id"), first.alias("first"), (end - 1).alias("last"), F.col("ord").cast("long").alias("ord"), "base", "name")


def stab_few(addresses: DataFrame, ranges: pa.Table) -> DataFrame:
    """FOUND for different (process_id, address), by ranges whose stretches are made once and go to every task."""
    held = addresses.sparkSession.sparkContext.broadcast(Ranges(ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(held.value.find(b.column(0), b.column(1)), names=["process_id", "address", "base", "name"])

    return addresses.distinct().mapInArrow(run, FOUND)


def pieces(ranges: DataFrame, lows: list[tuple[int, int, int]]) -> DataFrame:
    """Ranges cut by slices (process, first key, slice): (slice, process_id, first, last, of: ord, base and name)."""
    shared = ranges.sparkSession.sparkContext.broadcast((lows, [(p, k) for p, k, _ in lows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, keys = shared.value
        for b in batches:
            p, first, last, ord_ = (b.column(i).to_pylist() for i in range(4))
            at, row, lo, hi = [], [], [], []
            covers: dict[tuple[int, int], int] = {}
            best = np.full(len(keys) + 1, -1, np.int64)
            # The larger ords first, so that the smallest stays; (process, slice) has one process where a range covers it all.
            for i in sorted(range(len(p)), key=ord_.__getitem__, reverse=True):
                f, t = max(bisect_left(keys, (p[i], first[i])) - 1, 0), bisect_right(keys, (p[i], last[i])) - 1
                if t < f:
                    continue
                best[f + 1 : t] = i
                for s, x, y in {(f, first[i], last[i] if f == t else HIGH), (t, first[i] if f == t else LOW, last[i])}:
                    at.append(s)
                    row.append(i)
                    lo.append(x)
                    hi.append(y)
            for s in np.flatnonzero(best >= 0).tolist():
                covers[s, p[best[s]]] = int(best[s])
            at += [s for s, _ in covers]
            row += covers.values()
            lo += [LOW] * len(covers)
            hi += [HIGH] * len(covers)
            kept = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([slices[s][2] for s in at], pa.int64()), kept.column(0), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), kept.column(3), kept.column(4), kept.column(5)],
                names=["slice", "process_id", "first", "last", "ord", "base", "name"],
            )

    cut = ranges.mapInArrow(run, "slice long, process_id long, first long, last long, ord long, base long, name string")
    return cut.groupBy("slice", "process_id", "first", "last").agg(F.min(F.struct("ord", "base", "name")).alias("of")).select("slice", "process_id", "first", "last", "of.*")


def sliced(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(process_id, address, asked, slice): addresses (asked) and ends of ranges in slices of their order, written once."""
    ends = ranges.select("process_id", F.explode(F.array(unsigned(F.col("first")), unsigned(F.col("last")))).alias("address"), F.lit(False).alias("asked"))
    points = addresses.withColumn("asked", F.lit(True)).unionByName(ends).groupBy("process_id", "address").agg(F.max("asked").alias("asked"))
    key = unsigned(F.col("address"))
    # Rows of a sorted part are numbered in their order, with the part in the upper bits: so many in a row are a slice.
    points = points.repartitionByRange("process_id", key).sortWithinPartitions("process_id", key)
    return written(points.withColumn("slice", F.shiftright(F.monotonically_increasing_id(), SLICE_BITS)), "points")


def lows_of(points: DataFrame) -> list[tuple[int, int, int]]:
    """(process, first key, slice) of slices in their order."""
    bounds = points.where("process_id is not null and address is not null").groupBy("slice").agg(F.min(F.struct("process_id", unsigned(F.col("address")).alias("k"))).alias("low"))
    return sorted((r["low"]["process_id"], r["low"]["k"], r["slice"]) for r in bounds.collect())


def stab_many(addresses: DataFrame, ranges: DataFrame) -> DataFrame:
    """FOUND for different (process_id, address), slice by slice.

    A slice has 65,536 boundaries and addresses at most; the bounds of slices, two numbers each, are all that the driver
    sees. Addresses and boundaries are written once, in slices, to the session's scratch folder.
    """
    points = sliced(addresses, ranges)
    lows = lows_of(points)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked = asked.combine_chunks()
        process, address = (pa.concat_arrays(asked[c].chunks) if asked[c].num_chunks else pa.array([], pa.int64()) for c in ("process_id", "address"))
        return pa.Table.from_arrays(Ranges(held).find(process, address), names=["process_id", "address", "base", "name"])

    left = points.where("asked").select("slice", "process_id", "address")
    return left.groupBy("slice").cogroup(pieces(ranges, lows).groupBy("slice")).applyInArrow(run, FOUND)


ADDED = "process_id long, entry_ord long, address long, base long, name string, count long"


def add_found(ranges: Ranges, rows: pa.Table, by_address: bool) -> pa.Table:
    """ADDED of entries (process_id, address, entry_ord, count): those of a process and range, and of an address if
    by_address, are one row with the sum of their counts and the rest from the first by entry_ord."""
    rows = rows.combine_chunks()
    whole = lambda c: pa.concat_arrays(rows[c].chunks) if rows[c].num_chunks else pa.array([], pa.int64())
    process, address, entry, count = (whole(c) for c in ("process_id", "address", "entry_ord", "count"))
    hit = ranges.places(process, address)
    p, a, e, n = (x.to_numpy(zero_copy_only=False) for x in (process, address, entry, count))
    order = np.lexsort((e, *([a] if by_address else []), hit, p))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (p, hit, *([a] if by_address else [])):
        new[1:] |= np.diff(x[order]) != 0
    first = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], first) if len(first) else n
    of = order[first]
    return pa.Table.from_arrays([pa.array(p[of]), pa.array(e[of]), pa.array(a[of]), *ranges.at(hit[of]), pa.array(sums)], names=["process_id", "entry_ord", "address", "base", "name", "count"])


def _ahead(process: Column, k: Column) -> Column:
    """A number that never falls in the order (process, k), k being an unsigned address's key: by it alone most pairs sort."""
    address = unsigned(k)
    low = F.when((address < 0) | (address >= 1 << 47), F.lit((1 << 47) - 1)).otherwise(address)
    return F.when(process < 0, F.lit(LOW)).when(process >= 1 << 15, F.lit(HIGH)).otherwise(F.shiftleft(process, 47) + low)


def add_many(entries: DataFrame, ranges: DataFrame, by_address: bool) -> DataFrame:
    """ADDED of entries (process_id, file_no, address, entry_ord, count; no nulls), slice by slice; the last one counts where
    an address comes several times in a file.

    Entries go through the slices themselves, so addresses aren't told apart first nor joined with what is found, and the
    shuffle into the order of slices brings the entries of a file's address together. Those of several files may be cut into
    slices; what is one row in each of several slices is left to a later aggregation.
    """
    ends = ranges.select("process_id", F.explode(F.array("first", "last")).alias("k"))
    asked = entries.select("process_id", unsigned(F.col("address")).alias("k"), "file_no", "entry_ord", "count")
    points = asked.unionByName(ends, allowMissingColumns=True).repartitionByRange("process_id", "k", "file_no")
    points = points.groupBy("process_id", "k", "file_no").agg(F.min("entry_ord").alias("entry_ord"), F.max_by("count", "entry_ord").alias("count"))
    points = points.select("process_id", unsigned(F.col("k")).alias("address"), "entry_ord", "count", "k").sortWithinPartitions(_ahead(F.col("process_id"), F.col("k")), "process_id", "k", "entry_ord").drop("k")
    points = written(points.withColumn("slice", F.shiftright(F.monotonically_increasing_id(), SLICE_BITS)), "points")
    lows = lows_of(points)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        return add_found(Ranges(held), asked, by_address)

    left = points.where("entry_ord is not null").select("slice", "process_id", "address", "entry_ord", "count")
    return left.groupBy("slice").cogroup(pieces(ranges, lows).groupBy("slice")).applyInArrow(run, ADDED)


def stab(addresses: DataFrame, lib_map: DataFrame, few: int) -> DataFrame:
    """FOUND for the different (process_id, address) of addresses; at most ``few`` ranges are sent to every task."""
    ready(addresses.sparkSession)
    keys = addresses.select(F.col("process_id").cast("long").alias("process_id"), F.col("address").cast("long").alias("address"))
    ranges = keyed(lib_map)
    some = ranges.limit(few + 1).toArrow()
    return stab_few(keys, some) if some.num_rows <= few else stab_many(keys, ranges)
