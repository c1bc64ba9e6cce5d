"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes if a string of ``size`` bytes over it also starts anywhere else in the corpus. Candidates come from
content-defined anchors (repeats.py). Their stretches are cut into small blocks, each with its own suffix array,
from which its transform is made: the mapping from each suffix to the one that starts a symbol later. What a block itself
repeats are neighbours in its order; one suffix of each such group goes on. The blocks are then merged by their transforms
alone. The interleave tells for each place which block the next suffix comes from; suffixes of a block keep their order.
A round looks w symbols ahead by the w-fold mapping and sorts the suffixes of each interval by the interval that they find
there, so an interleave that is right for h symbols becomes right for h + w, with w up to h; the first round reads off as many
symbols as a sort key holds. An interval of one block's suffixes is in order and takes no further part. Where intervals
part, the neighbours' common prefix is known to end; one with suffixes of two blocks that is left at ``size`` is a repeated
string. No suffix of the merged set is compared with another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm.common import rows_bytes, table
from stackloom.llm.repeats import Repeats, ddl

#: Bytes of a window: the length threshold of a repeated string.
SIZE = 200
GRAM = 48
#: Bytes of a block whose suffixes are sorted on their own.
BLOCK = 1 << 17
#: Bytes of a shard, whose blocks are merged.
SHARD = 1 << 19


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stable order, key in that order) of whole numbers that aren't negative."""
    n = len(key)
    bits = max(1, n.bit_length())
    if n and int(key.max()).bit_length() + bits > 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << bits | np.arange(n))  # faster than an indirect sort
    return both & (1 << bits) - 1, both >> bits


def spread(flat: np.ndarray) -> tuple[np.ndarray, int, int]:
    """(symbols numbered without gaps, 0 staying 0; how many there are; how many fit a number beside a position)."""
    used = np.bincount(flat, minlength=1) > 0
    used[0] = True
    kinds = max(2, int(used.sum()))
    room, step = 63 - max(1, len(flat).bit_length()), 1
    while (kinds ** (step + 1)).bit_length() <= room:
        step += 1
    return (np.cumsum(used) - 1)[flat], kinds, step


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Suffixes of one block in order; symbol 0 ends a string, and of two ends that of the earlier string is smaller."""
    n = len(flat)
    symbol, kinds, width = spread(flat)
    padded = np.concatenate([symbol, np.zeros(width, np.int64)])
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(width):
        key = key * kinds + np.where(open_, padded[i : i + n], 0)
        open_ &= padded[i : i + n] > 0
    order, key = ranked(key)  # positions of equal stretches stay in order of their strings
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | ~open_[order][1:]
    # Rank: how many suffixes are smaller; equal while the symbols compared so far are. Beyond the end: fewer than none.
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # places in the order; only these are sorted on
    while len(tied):
        some = order[tied]
        by, key = ranked(rank[some].astype(np.int64) * (n + 2) + rank.take(some + width, mode="clip") + 1)
        some = some[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order[tied] = some
        rank[some] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def transform(flat: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first symbol of each suffix in order, the suffix that starts one symbol after it): a block's transform, inverted."""
    n = len(order)
    place = np.zeros(n + 1, np.int32)  # nothing follows the last end
    place[order] = np.arange(n, dtype=np.int32)
    return flat[order], place[order + 1]


def _read(symbol: np.ndarray, kinds: int, later: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the first symbols of every suffix as one number, which of these differ from those before whatever follows)."""
    key, inside = symbol, symbol > 0
    for i in range(1, width):
        key = symbol * kinds**i + key[later] * inside
    return key, key % kinds == 0  # ends of strings all differ


def _after(later: dict[int, np.ndarray], width: int, at: np.ndarray) -> np.ndarray:
    """The suffixes that start ``width`` symbols after those in ``at``; mappings over powers of 2 are kept."""
    for i in range(width.bit_length()):
        if 1 << i not in later:
            half = later[1 << i - 1]
            later[1 << i] = half[half]
        if width >> i & 1:
            at = later[1 << i][at]
    return at


def parted(block: tuple[np.ndarray, np.ndarray], size: int) -> np.ndarray:
    """Which suffixes of a block share less than ``size`` symbols with the one before them.

    Neighbours in order that share h symbols share w more if what starts h symbols after them shares w; nothing is sorted.
    """
    symbol, kinds, done = spread(block[0])
    done = min(done, size)
    later = {1: block[1]}
    key, ends = _read(symbol, kinds, block[1], done)
    cut = np.ones(len(key), bool)
    cut[1:] = (key[1:] != key[:-1]) | ends[1:]
    alike = np.flatnonzero(~cut)
    while done < size and len(alike):
        width = min(done, size - done)
        interval = np.cumsum(cut, dtype=np.int32)
        new = interval[_after(later, width, alike)] != interval[_after(later, width, alike - 1)]
        cut[alike[new]] = True
        alike = alike[~new]
        done += width
    return cut


def distinct(block: tuple[np.ndarray, np.ndarray], group: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A transform with one suffix for each group that shares ``size`` symbols.

    What starts w symbols after a group is right for size - w + 1 symbols; a merge looks at no more.
    """
    return block[0][cut], group[block[1][cut]]


def merged(transforms: list[tuple[np.ndarray, np.ndarray]], size: int, single: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interleave, interval, common) of the suffixes of blocks by their transforms.

    interleave: the block of each suffix in merged order, right for ``size`` symbols; a block's suffixes come in its own
    order. interval: number of the group that shares ``size`` symbols. common: symbols that a suffix is known to share with
    the one before it (a lower bound from the round in which they parted, ``size`` where they did not). single: no two
    suffixes of one block share ``size`` symbols, so an interval of one block's suffixes is in order and parts at once.
    """
    counts = np.array([len(f) for f, _ in transforms])
    offset, n = np.cumsum(counts) - counts, int(counts.sum())
    home = np.repeat(np.arange(len(counts), dtype=np.uint8 if len(counts) < 256 else np.uint16), counts)
    symbol, kinds, done = spread(np.concatenate([f for f, _ in transforms]))
    done = min(done, size)
    later = {1: np.concatenate([x + np.int32(o) for (_, x), o in zip(transforms, offset)])}
    key, ends = _read(symbol, kinds, later[1], done)
    order, key = ranked(key)
    cut = np.ones(n, bool)
    cut[1:] = (key[1:] != key[:-1]) | ends[order[1:]]
    common = np.where(cut, 0, size)
    head = np.maximum.accumulate(np.where(cut, np.arange(n), 0))  # of each place: the first place of its interval
    rank = np.empty(n, np.int32)
    rank[order] = head
    alone = np.append(cut[1:], True) & cut
    open_ = np.flatnonzero(~alone)  # places in intervals of two suffixes or more; only these are looked at
    while True:
        if single and len(open_):
            begin = np.flatnonzero(cut[open_])
            block = home[order[open_]]
            one = np.minimum.reduceat(block, begin) == np.maximum.reduceat(block, begin)
            one = np.repeat(one, np.diff(begin, append=len(open_)))
            still = open_[one]
            common[still[~cut[still]]] = done
            cut[still] = True
            rank[order[still]] = still
            open_ = open_[~one]
        if done >= size or not len(open_):
            return home[order], np.cumsum(cut, dtype=np.int32) - 1, common
        width = min(done, size - done)
        # A suffix lies in its interval by what starts where the symbols end that are in order already; a block's own
        # suffixes never change places.
        some = order[open_]
        by, key = ranked(rank[some].astype(np.int64) * n + rank[_after(later, width, some)])
        some = some[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        order[open_] = some
        fresh = open_[new & ~cut[open_]]
        common[fresh] = done
        cut[fresh] = True
        rank[some] = np.maximum.accumulate(np.where(new, open_, 0))
        open_ = open_[~(new & np.append(new[1:], True))]
        done += width


def repeated(blocks: list[list[bytes]], size: int) -> list[np.ndarray]:
    """For every string of the blocks in turn, whether each of its windows of ``size`` bytes occurs twice or more.

    Of what a block itself repeats, one suffix goes into the merge.
    """
    orders, groups, whole, sizes = [], [], [], []
    for block in blocks:
        lengths = np.array([len(s) + 1 for s in block])
        flat = np.frombuffer(b"\0".join([*block, b""]), np.uint8).astype(np.int64) + 1
        flat[np.cumsum(lengths) - 1] = 0
        orders.append(suffix_array(flat))
        made = transform(flat, orders[-1])
        cut = parted(made, size)
        groups.append(np.cumsum(cut, dtype=np.int32) - 1)
        whole.append(distinct(made, groups[-1], cut))
        sizes += [len(s) for s in block]
    if not sizes:
        return []
    interleave, interval, _ = merged(whole, size, single=True)
    # Groups of block after block, as the stable order of the interleave lists them.
    again = (np.bincount(interval) > 1)[interval][np.argsort(interleave, kind="stable")]
    out, at, names = [], 0, iter(sizes)
    for block, order, group in zip(blocks, orders, groups):
        many = np.bincount(group)
        found = np.empty(len(order), bool)
        found[order] = (again[at : at + len(many)] | (many > 1))[group]
        at += len(many)
        start = 0
        for k in (next(names) for _ in block):
            out.append(found[start : start + max(0, k + 1 - size)])
            start += k + 1
    return out


def resolver(size: int):
    def resolve(segments: list[tuple[int | None, bytes]]) -> list[np.ndarray]:
        blocks: list[list[bytes]] = [[]]
        held = 0
        for _, body in segments:
            if held > BLOCK:
                blocks.append([])
                held = 0
            blocks[-1].append(body)
            held += len(body)
        return repeated(blocks, size)

    return resolve


def frame(size: int = SIZE, gram: int | None = None) -> Repeats:
    return Repeats("byte", size, gram or max(1, min(GRAM, size // 2)), "anywhere", resolver(size), shard=SHARD, trim=True)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])


def remove_repeats(documents: DataFrame, size: int = SIZE, text: bool = True) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256, spans.

    Texts count as UTF-8 bytes, null as none. Each byte under a string of ``size`` bytes that also starts anywhere
    else, in the same row (overlaps included) or another, goes; kept holds the rest (binary: a cut may part a
    character), spans the start and end of each removed run in turn. Repeated rows are rows of their own, so each
    repeats the other; a null doc_id is a value like any other; further columns are ignored. text=False leaves
    kept null.
    """
    rep = frame(size)

    def apply(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for doc, body, gone in zip(batch.column(0).to_pylist(), rows_bytes(batch.column(1)), batch.column(2).to_pylist()):
                n, spans, kept = len(body), [], body
                if gone:
                    hit = rep.mask(n, gone)
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                    kept = b"".join(body[i:j] for i, j in zip([0, *spans[1::2]], [*spans[::2], n]))
                for k, v in zip(out, (doc, n, n - len(kept), len(spans) // 2, kept if text else None, hashlib.sha256(kept).hexdigest(), spans)):
                    out[k].append(v)
            yield table(out, _OUT)

    return rep.removals(documents).mapInArrow(apply, ddl(pa.schema(list(_OUT)[:-1])) + ", spans array<int>")


def op7_suffix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, text=False).drop("kept", "spans")
