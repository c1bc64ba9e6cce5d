"""Binary layouts of sample files, library maps and tree files: little-endian, packed."""

from __future__ import annotations

import heapq
import io
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from stackloom.model import MAX_DEPTH, FileStatus

# Headers, entries and magic numbers (fixed values of the file formats).
SAMPLE_MAGIC, MAP_MAGIC, TREE_MAGIC = 0x50464C57, 0x504C4D50, 0x50545245
VERSION = 1
SAMPLE_HEADER = struct.Struct("<IHBBQIIQ32s")
SAMPLE_ENTRY = struct.Struct("<IIQ")
MAP_HEADER = struct.Struct("<IHHIIQ40s")
MAP_ENTRY = struct.Struct("<QQB7sII")
TREE_HEADER = struct.Struct("<IHBBQIIQ32s")
TREE_NODE = struct.Struct("<QQQQQQIHHHHI")
#: Where a library's row tells the length of its name.
LENGTH_AT = 24
#: Longest library name that a map may hold.
MAX_NAME = 4096
SIGNED, WORD = 1 << 63, (1 << 64) - 1


def signed(x: int) -> int:
    """An unsigned 64-bit number as a long of the same bits, which is how tables hold addresses."""
    return x - (1 << 64) if x >= SIGNED else x


@dataclass
class Parsed:
    """What a file held, or why it was not read; rows are empty unless the status is Success."""

    status: FileStatus
    header: dict = field(default_factory=dict)
    rows: list = field(default_factory=list)


def parse_samples(data: bytes, max_depth: int = MAX_DEPTH, header_only: bool = False) -> Parsed:
    """(entry_ord, addresses, count) rows of a sample file. Any fault fails the whole file.

    Addresses are unsigned; those of 2^63 and more (kernel, vsyscall) come as negative longs of the same bits.

    header_only checks the magic number alone, so files of newer versions show their headers too.
    """
    if len(data) < SAMPLE_HEADER.size:
        return Parsed(FileStatus.FileRead)
    magic, version, compression, _, entries, depth, _, timestamp, _ = SAMPLE_HEADER.unpack_from(data)
    header = {"version": version, "compression": compression, "entry_count": entries, "max_depth": depth, "timestamp": timestamp}
    if magic != SAMPLE_MAGIC:
        return Parsed(FileStatus.InvalidFormat)
    if header_only:
        return Parsed(FileStatus.Success, header)
    if version > VERSION:
        return Parsed(FileStatus.VersionMismatch, header)
    if compression:
        return Parsed(FileStatus.Compression, header)
    rows, at = [], SAMPLE_HEADER.size
    for i in range(entries):
        if at + SAMPLE_ENTRY.size > len(data):
            return Parsed(FileStatus.FileRead, header)
        n, _, count = SAMPLE_ENTRY.unpack_from(data, at)
        at += SAMPLE_ENTRY.size
        if n > max_depth:
            return Parsed(FileStatus.Integrity, header)
        if at + 8 * n > len(data):
            return Parsed(FileStatus.FileRead, header)
        addrs = list(struct.unpack_from(f"<{n}q", data, at))
        at += 8 * n
        if count >= SIGNED:
            return Parsed(FileStatus.Integrity, header)
        rows.append((i, addrs, count))
    return Parsed(FileStatus.Success, header, rows)


class Fault(Exception):
    """Why entries of a sample file could not be read."""

    def __init__(self, status: FileStatus) -> None:
        super().__init__(status.value)
        self.status = status


def read_header(data: bytes) -> dict:
    """The header of a sample file whose entries may be read."""
    p = parse_samples(data[: SAMPLE_HEADER.size], header_only=True)
    if p.status is not FileStatus.Success:
        raise Fault(p.status)
    if p.header["version"] > VERSION:
        raise Fault(FileStatus.VersionMismatch)
    if p.header["compression"]:
        raise Fault(FileStatus.Compression)
    return p.header


@dataclass
class Entries:
    """Consecutive entries: number of the first, counts, depths, and all addresses in a row."""

    first: int
    counts: np.ndarray
    depths: np.ndarray
    addrs: np.ndarray

    def hashes(self) -> np.ndarray:
        """A hash of each stack; equal stacks have equal ones."""
        ends = np.cumsum(self.depths)
        place = np.arange(len(self.addrs)) - np.repeat(ends - self.depths, self.depths)
        mixed = (self.addrs.view(np.uint64) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed ^ mixed >> np.uint64(29), dtype=np.uint64)])
        return sums[ends] - sums[ends - self.depths] + self.depths.astype(np.uint64)


#: Words (8 bytes) of a file that are decoded at once, and that the search for a boundary looks through.
CHUNK, SEARCH = 1 << 20, 1 << 19


def walk_entries(read: Callable[[int], bytes], entries: int | None, max_depth: int = MAX_DEPTH, words: int | None = None) -> Iterator[Entries]:
    """Entries of a body that read(n bytes) gives piece by piece: so many of them, or as many as lie in so many words.

    Raises a Fault at the first entry that is cut off, too deep, or counts 2^63 and more.
    """
    held, done, at, ended = np.zeros(0, "<i8"), 0, 0, False
    while (entries is None or done < entries) and (words is None or at < words):
        if not ended:
            piece = read(8 * CHUNK)
            ended = len(piece) < 8 * CHUNK
            held = np.concatenate([held, np.frombuffer(piece, "<i8", len(piece) // 8)])
        depth = held & 0xFFFFFFFF
        after = (np.arange(2, len(held) + 2) + depth).tolist()
        places, here, most = [], 0, len(held) if words is None else min(len(held), words - at)
        left = len(held) if entries is None else entries - done
        while here + 2 <= most and len(places) < left and after[here] <= len(held):
            places.append(here)
            here = after[here]
        found = np.array(places, np.int64)
        depths, counts = depth[found], held[found + 1]
        if (depths > max_depth).any() or (counts < 0).any():
            raise Fault(FileStatus.Integrity)
        if len(found):
            ends = np.cumsum(depths)
            yield Entries(done, counts, depths, held[np.repeat(found + 2 - (ends - depths), depths) + np.arange(ends[-1])])
        done, at, held = done + len(found), at + here, held[here:]
        if (entries is None or done < entries) and (words is None or at < words):
            if here + 2 <= len(depth) and depth[here] > max_depth:
                raise Fault(FileStatus.Integrity)
            if ended:
                raise Fault(FileStatus.FileRead)


def find_boundary(read_at: Callable[[int, int], bytes], words: int, at: int, max_depth: int = MAX_DEPTH) -> int | None:
    """Word at or after `at` where an entry begins, or where the body of so many words ends; None if that can't be proven.

    An entry begins at one of the first max_depth + 2 words. All of these are followed from entry to entry, in step; false
    ones come upon an impossible depth or count, or meet the true one. What is left when one remains is a boundary.
    read_at(word, number of words) reads the body.
    """
    if at == 0 or at >= words:
        return min(at, words)
    heap = list(range(at, min(at + max_depth + 2, words)))
    waiting, held, end = set(heap), np.zeros(0, "<i8"), False
    while heap:
        p = heapq.heappop(heap)
        waiting.discard(p)
        if not heap and not end and p >= min(at + max_depth + 2, words):
            return p
        if p + 2 - at > len(held):
            if len(held) >= SEARCH:
                return None
            more = min(1 << 13 if len(held) < 1 << 13 else SEARCH, words - at - len(held))
            held = np.concatenate([held, np.frombuffer(read_at(at + len(held), more), "<i8")])
        if p + 2 - at > len(held):
            continue
        depth, count = int(held[p - at]) & 0xFFFFFFFF, int(held[p - at + 1])
        after = p + 2 + depth
        if depth > max_depth or count < 0 or after > words:
            continue
        if after == words:
            end = True
        elif after not in waiting:
            waiting.add(after)
            heapq.heappush(heap, after)
    return words if end else None


#: Bytes of a map that are read at once, and rows that are given at once.
MAP_PIECE, MAP_ROWS = 1 << 20, 10_000


def read_map_header(data: bytes) -> Parsed:
    """The header of a library map, and whether its rows may be read."""
    if len(data) < MAP_HEADER.size:
        return Parsed(FileStatus.FileRead)
    magic, version, _, process, libraries, timestamp, _ = MAP_HEADER.unpack_from(data)
    header = {"version": version, "process_id": process, "library_count": libraries, "timestamp": timestamp}
    if magic != MAP_MAGIC:
        return Parsed(FileStatus.InvalidFormat)
    return Parsed(FileStatus.VersionMismatch if version > VERSION else FileStatus.Success, header)


def walk_libraries(read: Callable[[int], bytes], libraries: int) -> Iterator[tuple[int, bytes, list[int]]]:
    """(number of the first, bytes, places in them) of libraries of a body that read(n bytes) gives piece by piece, some thousands at a time.

    Raises a Fault at the first row that is cut off or has too long a name.
    """
    held, at, i, length_of = b"", 0, 0, struct.Struct("<I").unpack_from
    while i < libraries:
        places: list[int] = []
        left, last = min(libraries - i, MAP_ROWS), len(held) - MAP_ENTRY.size
        while len(places) < left and at <= last:
            (length,) = length_of(held, at + LENGTH_AT)
            if length > MAX_NAME:
                raise Fault(FileStatus.Integrity)
            if at + length > last:
                break
            places.append(at)
            at += MAP_ENTRY.size + length
        if places:
            yield i, held, places
            i += len(places)
        if len(places) < left:
            piece = read(MAP_PIECE)
            if not piece:
                raise Fault(FileStatus.FileRead)
            held, at = held[at:] + piece, 0


def unpack_libraries(held: bytes, places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(base, end, executable, name) of libraries at places in bytes, by columns."""
    data, at = np.frombuffer(held, np.uint8), np.array(places, np.int64)
    fixed = data[at[:, None] + np.arange(MAP_ENTRY.size)]
    whole = lambda i, kind: np.ascontiguousarray(fixed[:, i : i + np.dtype(kind).itemsize]).view(kind).ravel()
    sizes = whole(LENGTH_AT, "<u4").astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    text = data[np.arange(ends[-1]) + np.repeat(at + MAP_ENTRY.size - ends[:-1], sizes)]
    raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
    try:
        name = raw.cast(pa.string())
    except pa.ArrowInvalid:  # not UTF-8
        name = pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())
    return whole(0, "<i8"), whole(8, "<i8"), whole(16, "u1") != 0, name


def walk_map(read: Callable[[int], bytes], libraries: int) -> Iterator[list[tuple]]:
    """(ord, base, end, executable, name) rows of a body, as walk_libraries finds them."""
    for first, held, places in walk_libraries(read, libraries):
        base, end, executable, name = (x.tolist() for x in unpack_libraries(held, places))
        yield list(zip(range(first, first + len(places)), base, end, executable, name))


def parse_map(data: bytes) -> Parsed:
    """(ord, base, end, executable, name) rows of a library map."""
    p = read_map_header(data)
    if p.status is FileStatus.Success:
        try:
            p.rows = [r for some in walk_map(io.BytesIO(memoryview(data)[MAP_HEADER.size :]).read, p.header["library_count"]) for r in some]
        except Fault as e:
            p.status = e.status
    return p


def sample_header(entries: int, timestamp: int = 0, max_depth: int = MAX_DEPTH) -> bytes:
    return SAMPLE_HEADER.pack(SAMPLE_MAGIC, VERSION, 0, 0, entries, max_depth, 0, timestamp, b"")


def pack_entry(addrs: list[int], count: int) -> bytes:
    return SAMPLE_ENTRY.pack(len(addrs), 0, count) + struct.pack(f"<{len(addrs)}Q", *[a & WORD for a in addrs])


def pack_entries(depths: np.ndarray, counts: np.ndarray, addrs: np.ndarray) -> bytes:
    """Entries as pack_entry gives them, one after the other; addresses of all in a row."""
    if (counts < 0).any():
        raise ValueError("an entry can't count less than nothing")
    n, ends = len(depths), np.cumsum(depths)
    out = np.empty(2 * n + len(addrs), "<i8")
    at = ends - depths + 2 * np.arange(n)
    out[at], out[at + 1] = depths, counts
    out[np.arange(len(addrs)) + 2 * np.repeat(np.arange(1, n + 1), depths)] = addrs
    return out.tobytes()


def pack_samples(rows: list[tuple[list[int], int]], timestamp: int = 0, max_depth: int = MAX_DEPTH) -> bytes:
    return b"".join([sample_header(len(rows), timestamp, max_depth), *(pack_entry(addrs[:max_depth], count) for addrs, count in rows)])


def map_header(libraries: int, process_id: int, timestamp: int = 0) -> bytes:
    return MAP_HEADER.pack(MAP_MAGIC, VERSION, 0, process_id & 0xFFFFFFFF, libraries, timestamp, b"")


def pack_library(base: int, end: int, executable: bool, name: str) -> bytes:
    raw = name.encode()
    return MAP_ENTRY.pack(base & WORD, end & WORD, executable, b"", len(raw), 0) + raw


def pack_map(rows: list[tuple[int, int, bool, str]], process_id: int, timestamp: int = 0) -> bytes:
    return b"".join([map_header(len(rows), process_id, timestamp), *(pack_library(*r) for r in rows)])
