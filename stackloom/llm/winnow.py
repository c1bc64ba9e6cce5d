"""Content-defined anchors of token or byte sequences, on whole Arrow batches with numpy.

For windows of ``size`` consecutive units the rightmost smallest hash among its grams of ``gram`` units is
the window's anchor (winnowing): equal windows choose equal anchors, so every repeated window is
found by joining anchors, of which there are about 2 / (size - gram + 2) per unit. The windows that
share an anchor are consecutive; ``first`` .. ``last`` are their starts and ``cls`` hashes all that they cover.
"""

from __future__ import annotations

import sys

import numpy as np

U = np.uint64
#: Odd multipliers of the rolling hashes (fixed values; any odd numbers do).
B1, B2, B3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
_MOD = 1 << 64
#: Units of a batch that are hashed at once; bounds the memory of a task.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the worker's life."""
    kept = sys.__dict__.setdefault("_stackloom_powers", {})
    have = kept.get((int(base), inverse))
    if have is None or len(have) <= n:
        b = pow(int(base), -1, _MOD) if inverse else int(base)
        steps = np.full(max(n + 1, 1 << 16), b, U)
        steps[0] = 1
        kept[int(base), inverse] = have = np.cumprod(steps, dtype=U)
    return have


class Rolling:
    """Hashes of any stretch of a sequence of 64-bit values, from one pass over it."""

    def __init__(self, values: np.ndarray, base: np.uint64) -> None:
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(values * powers(base, n)[:n], out=self.sums[1:], dtype=U)
        self.down = powers(base, n, inverse=True)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_values(data: np.ndarray, salt: int) -> np.ndarray:
    """Random 64-bit values for bytes."""
    return mix(np.arange(1, 257, dtype=U) * B3 + U(salt))[data]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes other than ASCII white space; documents part words."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    blank = SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[ends[:-1]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    start = np.flatnonzero(~blank & (before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    end = np.flatnonzero(~blank & (after | first[1:])) + 1
    if len(end) < len(start):  # the last document ends at the last byte
        end = np.append(end, len(data))
    return start, end, np.searchsorted(ends, start, side="right") - 1


def lines(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, place in the document) of each line that holds more than white space; \\n parts lines."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 4
    full = np.flatnonzero(ends[1:] > ends[:-1])
    brk = np.flatnonzero(data == 10)
    start = np.concatenate([ends[:-1][full], brk + 1])
    end = np.concatenate([brk, ends[1:][full]])
    start.sort()
    end.sort()
    doc = np.repeat(full, np.searchsorted(brk, ends[1:][full]) - np.searchsorted(brk, ends[:-1][full]) + 1)
    place = np.arange(len(start)) - np.searchsorted(doc, doc, side="left")
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    keep = solid[end] > solid[start]
    return start[keep], end[keep], doc[keep], place[keep]


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0, base: np.uint64 = B1) -> np.ndarray:
    """64-bit hash of each stretch of bytes, computed in slices so that memory stays bounded."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK)))
        low, high = int(start[i]), int(end[j - 1])
        out[i:j] = Rolling(byte_values(data[low:high], salt), base).of(start[i:j] - low, end[i:j] - low) + mix((end[i:j] - start[i:j]).astype(U))
        i = j
    return out


def _rightmost_min(key: np.ndarray, width: int) -> np.ndarray:
    """Position of the rightmost smallest key of every window of that width, by the upper halves of the keys.

    The same bits count however many keys there are, so equal windows choose alike in every batch.
    """
    low = U((1 << 32) - 1)
    # The place, counted from the end, stands in the lower half, so one minimum finds both.
    least, span = (key | low) - np.arange(len(key), dtype=U), 1
    while span * 2 <= width:
        least = np.minimum(least[span:], least[: len(least) - span])
        span *= 2
    if span < width:
        n = len(key) - width + 1
        least = np.minimum(least[width - span : width - span + n], least[:n])
    return (low - (least & low)).astype(np.int64)


def anchors(get, n: int, size: int, gram: int) -> dict[str, np.ndarray]:
    """Anchors of one sequence of n units; get(i, j) gives the values and the document of units i to j - 1, and, where
    64 bits are too few to tell units apart, other values of theirs, from which classes are hashed.

    Documents are contiguous and no window crosses two. Returns arrays anchor, cls (hashes as int64), first
    and last (starts of the anchor's windows). Only CHUNK units are held at a time: where a document is longer,
    an anchor at the seam may come twice, with two classes, and each of its windows still comes once.
    """
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at + size <= n:
        v, d, *other = get(at, min(n, at + CHUNK + size - 1))
        m = len(v) - size + 1
        starts = np.flatnonzero(d[:m] == d[size - 1 :])
        if len(starts):
            one, two = Rolling(v, B2), Rolling(other[0] if other else v, B3)
            grams = one.of(np.arange(len(v) - gram + 1), np.arange(gram, len(v) + 1))
            best = _rightmost_min(grams, size - gram + 1)[starts]
            new = np.empty(len(starts), bool)
            new[0] = True
            new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
            lead = np.flatnonzero(new)
            first, last, p = starts[lead], starts[np.append(lead[1:], len(starts)) - 1], best[lead]
            cls = mix(two.of(first, last + size) + mix((p - first).astype(U) * B1 + (last - first).astype(U)))
            found.append((mix(grams[p] + B1), cls, first + at, last + at))
        at += CHUNK
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
    return {"anchor": parts[0].astype(U).view(np.int64), "cls": parts[1].astype(U).view(np.int64), "first": parts[2], "last": parts[3]}
