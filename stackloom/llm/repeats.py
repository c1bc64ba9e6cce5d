"""Exact repeated windows of words, bytes or lines across a corpus: the frame of three operators.

Every window of ``size`` units belongs to one content-defined anchor (winnow.py). Hashes only find candidates; where the
operator has a structure (suffix automaton, merged Burrows-Wheeler transforms), it decides every removal on the texts:

1. One pass over the texts writes a row per anchor occurrence: hash, class (hash of all that its windows cover),
   document and the range of its windows. Anchors seen once are gone after an aggregation with constant state per anchor.
2. The rest is grouped by class. Of each class that repeats, the first and the last member are paired; pairs of the
   same two documents join to runs, so each repeated stretch is looked at once. Of each anchor with several classes, one
   representative of each is a candidate by itself, since windows may be shared by classes.
3. The texts of pairs and representatives (a small part of the corpus) are fetched in one join, dealt to shards of
   bounded size (pairs by their documents, representatives by anchor), and the structure finds the windows that repeat in a
   shard. A class whose pair is confirmed holds for all its members, a representative's windows for its equals.
4. An anchor with more classes than a shard should hold spreads over tasks by hashes: first of blocks of consecutive
   windows, placed alike around the anchor, then of the single windows that blocks left open, but for those that
   reach further to a side of the anchor than any text that another segment shares. What repeats is again paired, and
   the structure confirms the pairs.

Without a structure (line dedup, whose method joins fingerprints) classes and window hashes decide.
Documents are keyed by doc_id and a hash of the text, so repeated rows with one id work as rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import winnow
from stackloom.llm.common import materialise, ready, slices, table, utf8

#: A shard's resolver gets (doc_id or None, body) of each segment, sorted by doc_id with None last, and gives one
#: boolean array per segment: which of its windows to remove.
Resolver = Callable[[list[tuple[int | None, bytes]]], list[np.ndarray]]

_OCC = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("anchor", pa.int64()), ("cls", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.bool_())])
#: Roles of a segment: others are compared with it; its windows are decided; its items are to be confirmed; it is hot.
REFERENCE, OPEN, PAIRED, HOT = 0, 1, 2, 3
_ITEM = pa.struct([("anchor", pa.int64()), ("cls", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_SEG = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("role", pa.int32()), ("lone", pa.bool_()), ("items", pa.list_(_ITEM)), ("body", pa.binary())])
_SEG_DDL = "key long, doc_id long, th long, first int, role int, lone boolean, items array<struct<anchor:bigint,cls:bigint,first:int,last:int>>, body binary"
_WIN = pa.schema([("anchor", pa.int64()), ("wh", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("lone", pa.bool_()), ("at", pa.int32())])
_BLK = pa.schema([("anchor", pa.int64()), ("bh", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("s", pa.int32()), ("lone", pa.bool_())])
_SPAN = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
_CTX = pa.schema([("anchor", pa.int64()), ("eh", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("side", pa.int32()), ("k", pa.int32())])
#: What shards tell: ranges of windows with the segment (at) that they belong to, or a confirmed class.
_TOLD = pa.schema([*_SPAN, ("at", pa.int32()), ("anchor", pa.int64()), ("cls", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "int32": "int", "bool": "boolean", "binary": "binary", "string": "string", "double": "double"}
    return ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in schema)


@dataclass(frozen=True)
class Repeats:
    """What repeats and which of the repeats go.

    unit: word, byte or line. scope: 'document' removes windows that also start in a document with a smaller id,
    'anywhere' those that also start anywhere else, 'place' all but the first in order of (doc_id, place).
    resolve: the structure that decides on texts (None: hashes decide). long_words: with lines, single lines of so
    many words count as windows too.
    """

    unit: str
    size: int
    gram: int
    scope: str
    resolve: Resolver | None = None
    shard: int = 60_000
    most: int = 500
    long_words: int = 0
    block: int = 16
    trim: bool = False

    def cut(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the units of a batch."""
        if self.unit == "word":
            return winnow.words(data, ends)
        return winnow.lines(data, ends)[:3]

    def occurrences(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, 2)):
            data, ends = utf8(batch.column(2))
            if self.unit == "byte":
                base = ends[:-1]
                rows = lambda i, j: np.searchsorted(ends, np.arange(i, j), side="right")
                found = winnow.anchors(lambda i, j: (winnow.byte_values(data[i:j], 1), rows(i, j)), len(data), self.size, self.gram)
                doc = np.searchsorted(ends, found["first"], side="right") - 1
            else:
                start, end, row = self.cut(data, ends)
                values = winnow.hashes(data, start, end)
                # Where no structure looks at the texts, classes come from other hashes: 128 bits tell units apart.
                other = [] if self.resolve else [winnow.hashes(data, start, end, 1, winnow.B2)]
                base = np.searchsorted(row, np.arange(len(ends) - 1))
                found = winnow.anchors(lambda i, j: (values[i:j], row[i:j], *[x[i:j] for x in other]), len(row), self.size, self.gram)
                doc = row[found["first"]]
                if self.long_words and len(row):
                    w, _, _ = winnow.words(data, ends)
                    wide = np.flatnonzero(np.searchsorted(w, end) - np.searchsorted(w, start) >= self.long_words)
                    more = winnow.mix(values[wide] ^ winnow.B2).view(np.int64)
                    cls = (other[0] if other else values)[wide].view(np.int64)
                    found = {k: np.concatenate([x, y]) for (k, x), y in zip(found.items(), (more, cls, wide, wide))}
                    # A long line is a window of one unit: it covers itself alone, which its negative end says.
                    found["last"][len(doc) :] = -1
                    doc = np.concatenate([doc, row[wide]])
            last = np.where(found["last"] < 0, -1, found["last"] - base[doc])
            first = found["first"] - base[doc]
            again = np.zeros(len(doc), bool)
            if self.scope == "place" and len(doc):
                order = np.lexsort((first, found["cls"], found["anchor"], doc))
                same = [x[order] for x in (doc, found["anchor"], found["cls"])]
                again[order[1:]] = np.logical_and.reduce([x[1:] == x[:-1] for x in same])
            at = pa.array(doc)
            yield table({"doc_id": batch.column(0).take(at), "th": batch.column(1).take(at), "anchor": found["anchor"], "cls": found["cls"], "first": first.astype(np.int32), "last": last.astype(np.int32), "again": again}, _OCC)

    def segments(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units under the windows asked for, of rows (doc_id, th, base, text, segs); text begins at unit ``base``.

        Pairs of one key that follow each other without a gap between their windows come as one segment.
        """
        for batch in (x for b in batches for x in slices(b, 3)):
            data, ends = utf8(batch.column(3))
            out: dict[str, list] = {f.name: [] for f in _SEG}
            start = end = base = None
            if self.unit != "byte":
                start, end, row = self.cut(data, ends)
                base = np.searchsorted(row, np.arange(len(ends) - 1))
            for i, segs in enumerate(batch.column(4).to_pylist()):
                doc, th, begin = (batch.column(k)[i].as_py() for k in range(3))
                runs: list[dict] = []
                for x in sorted(segs, key=lambda x: (x["key"], x["role"], x["first"])):
                    items = [{k: x[k] for k in ("anchor", "cls", "first", "last")}] if x["role"] == PAIRED else []
                    run = runs[-1] if runs else None
                    if run and x["pair"] and run["pair"] and (run["key"], run["role"]) == (x["key"], x["role"]) and x["first"] <= run["last"] + 1:
                        run["last"] = max(run["last"], x["last"])
                        run["items"] += items
                    else:
                        runs.append(x | {"items": items})
                for x in runs:
                    low, high = x["first"] - begin, x["last"] - begin + self.size
                    if self.unit == "byte":
                        body = data[ends[i] + low : ends[i] + high].tobytes()
                    else:
                        body = data[start[base[i] + low] : end[base[i] + high - 1]].tobytes()
                    for k, v in zip(out, (x["key"], doc, th, x["first"], x["role"], x["lone"], x["items"], body)):
                        out[k].append(v)
            yield table(out, _SEG)

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Resolve segments shard by shard; rows come sorted by key and no key is split."""
        held: list[tuple] = []
        units = 0

        def done():
            if self.scope != "anywhere":  # there the order decides nothing, and what is alike stays together
                held.sort(key=lambda x: (x[1] is None, x[1] or 0, x[2], x[3]))
            rows, ahead = self._trimmed(held) if self.trim else (held, [0] * len(held))
            found = self.resolve([(x[1], x[7]) for x in rows])
            out: dict[str, list] = {f.name: [] for f in _TOLD}
            for (_, doc, th, first, role, _, items, _), low, hit in zip(rows, ahead, found):
                if role == OPEN:
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))) + low
                    told = [(doc, th, first + s, first + e - 1, first, None, None) for s, e in zip(edges[::2].tolist(), edges[1::2].tolist())]
                elif role == PAIRED:
                    told = [(None,) * 5 + (x["anchor"], x["cls"]) for x in items if hit[x["first"] - first : x["last"] - first + 1].all()]
                else:
                    continue
                for row in told:
                    for k, v in zip(out, row):
                        out[k].append(v)
            return table(out, _TOLD)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if units >= self.shard and held[-1][0] != row[0]:
                    yield done()
                    held, units = [], 0
                held.append(row)
                units += len(row[7]) if self.unit == "byte" else row[7].count(b" ") + 1
        if held:
            yield done()

    def _trimmed(self, held: list[tuple]) -> tuple[list[tuple], list[int]]:
        """(segments of bytes that may share a window with another of their anchor, windows cut off ahead of each).

        All segments of an anchor are at hand. Two share a window only if they share what it holds before and after the
        anchor, so windows that reach beyond all shared contexts go; a context seen once by its hash is surely not shared.
        """
        some = [i for i, x in enumerate(held) if x[4] == OPEN or not x[5]]
        if not some:
            return held, [0] * len(held)
        many = np.array([len(held[i][7]) for i in some])
        base, row = np.cumsum(many) - many, np.repeat(np.arange(len(some)), many)
        values = winnow.byte_values(np.frombuffer(b"".join(held[i][7] for i in some), np.uint8), 1)
        keys = np.array([held[i][0] for i in some], np.int64)
        at, windows = self._anchors(pa.record_batch({"key": keys}), values, row, base)
        rolling, salt, side = winnow.Rolling(values, winnow.B3), winnow.mix(keys.view(np.uint64)), self.size - self.gram
        far = []
        for before, room in ((1, at), (0, many - at - self.gram)):
            reach = np.full(len(some), 1 << 30)
            for k in range(self.block, side + 1, self.block):
                r = np.flatnonzero((at >= 0) & (room >= k))
                s = base[r] + at[r]
                seen = winnow.mix(rolling.of(s - k * before, s + self.gram + k * (1 - before)) ^ salt[r])
                _, who, n = np.unique(seen, return_inverse=True, return_counts=True)
                alone = r[n[who] == 1]
                reach[alone] = np.minimum(reach[alone], k)
            far.append(reach)
        low = np.where(at < 0, 0, np.maximum(0, at - far[0] + 1))
        high = np.where(at < 0, windows, np.minimum(windows, at - side + far[1]))
        cut = {i: (a, b) for i, a, b in zip(some, low.tolist(), high.tolist())}
        rows, ahead = [], []
        for i, x in enumerate(held):
            a, b = cut.get(i, (0, 1))
            if a < b:
                rows.append((*x[:7], x[7][a : b - 1 + self.size]) if i in cut else x)
                ahead.append(a)
        return rows, ahead

    def _units(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, row of each unit, first unit of each row) of a batch of segments."""
        data, ends = utf8(batch.column(5))
        if self.unit == "byte":
            return winnow.byte_values(data, 1), np.repeat(np.arange(len(ends) - 1), np.diff(ends)), ends[:-1]
        start, end, row = self.cut(data, ends)
        return winnow.hashes(data, start, end), row, np.searchsorted(row, np.arange(len(ends) - 1))

    def _anchors(self, batch: pa.RecordBatch, values: np.ndarray, row: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the anchor's gram in each segment or -1, number of its windows)."""
        windows = np.bincount(row, minlength=len(base)) - self.size + 1
        # The gram lies in all windows of its segment; of equal grams the rightmost is the anchor.
        n = max(0, len(values) - self.gram + 1)
        grams = winnow.mix(winnow.Rolling(values, winnow.B2).of(np.arange(n), np.arange(n) + self.gram) + winnow.B1).view(np.int64)
        place = np.arange(n) - base[row[:n]]
        hit = (grams == batch.column(0).to_numpy()[row[:n]]) & (place >= windows[row[:n]] - 1) & (place <= self.size - self.gram)
        at = np.full(len(base), -1)
        np.maximum.at(at, row[:n][hit], place[hit])
        return at, windows

    def contexts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of a segment's anchor with k units before it (side 0) or after it (side 1), for multiples k of ``block``."""
        for batch in (x for b in batches for x in slices(b, 5, 1 << 18)):
            values, row, base = self._units(batch)
            at, windows = self._anchors(batch, values, row, base)
            after = windows + self.size - 1 - at - self.gram
            rolling = winnow.Rolling(values, winnow.B3)
            out = []
            k = self.block
            while k <= self.size - self.gram:
                for side, room in ((0, at), (1, after)):
                    r = np.flatnonzero((at >= 0) & (room >= k))
                    s = base[r] + at[r]
                    out.append((r, winnow.mix(rolling.of(s - k * (1 - side), s + self.gram + k * side)).view(np.int64), side, k))
                k += self.block
            r = np.concatenate([x[0] for x in out])
            take = pa.array(r)
            many = [len(x[0]) for x in out]
            yield table({"anchor": batch.column(0).take(take), "eh": np.concatenate([x[1] for x in out]), "doc_id": batch.column(1).take(take), "th": batch.column(2).take(take), "first": batch.column(3).take(take), "side": np.repeat([x[2] for x in out], many).astype(np.int32), "k": np.repeat([x[3] for x in out], many).astype(np.int32)}, _CTX)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash for each block of consecutive windows of a segment, counted from the anchor, that it holds whole."""
        for batch in (x for b in batches for x in slices(b, 5, 1 << 18)):
            values, row, base = self._units(batch)
            rows = len(base)
            at, windows = self._anchors(batch, values, row, base)
            low, high = -(-(at - windows + 1) // self.block), (at + 1) // self.block
            count = np.where(at >= 0, np.maximum(0, high - low), 0)
            r = np.repeat(np.arange(rows), count)
            number = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + low[r]
            s = at[r] - self.block * number - self.block + 1
            bh = winnow.mix(winnow.Rolling(values, winnow.B3).of(base[r] + s, base[r] + s + self.block - 1 + self.size) + number.astype(np.int64).view(np.uint64) * winnow.B1).view(np.int64)
            take = pa.array(r)
            first = batch.column(3).to_numpy()[r]
            yield table({"anchor": batch.column(0).take(take), "bh": bh, "doc_id": batch.column(1).take(take), "th": batch.column(2).take(take), "first": first, "s": (s + first).astype(np.int32), "lone": batch.column(4).take(take)}, _BLK)

    def windows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash for each single window of a segment that no block has settled and that may be shared.

        left, right: units beyond the anchor that no other segment shares; null where some does as far as was looked.
        """
        for batch in (x for b in batches for x in slices(b, 5, 1 << 18)):
            values, row, base = self._units(batch)
            n = max(0, len(row) - self.size + 1)
            s = np.flatnonzero(row[:n] == row[len(row) - n :]) if n else np.zeros(0, np.int64)
            first, open_ = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            lone, keep = open_[row[s]], np.ones(len(s), bool)
            begin = np.searchsorted(row[s], np.arange(len(base)))
            for i, settled in enumerate(batch.column(6).to_pylist()):
                for x in settled or ():
                    at = begin[i] + x["s"] - first[i]
                    lone[at : at + self.block] = False
                    keep[at : at + self.block] = x["rep"]  # a representative's windows stay as references
            at, _ = self._anchors(batch, values, row, base)
            far = [np.where(at >= 0, c.fill_null(1 << 30).to_numpy(zero_copy_only=False), 1 << 30) for c in batch.columns[7:9]]
            before = at[row[s]] - (s - base[row[s]])
            keep &= (before < far[0][row[s]]) & (self.size - self.gram - before < far[1][row[s]])
            s, lone = s[keep], lone[keep]
            r = row[s]
            wh = winnow.mix(winnow.Rolling(values, winnow.B3).of(s, s + self.size)).view(np.int64)
            take = pa.array(r)
            yield table({"anchor": batch.column(0).take(take), "wh": wh, "doc_id": batch.column(1).take(take), "th": batch.column(2).take(take), "s": (s - base[r] + first[r]).astype(np.int32), "lone": lone, "at": first[r]}, _WIN)

    @property
    def _rule(self) -> str:
        """Which members of a group of equals go, d0 being its smallest document and n its size."""
        return {"document": "doc_id > d0", "anywhere": "n > 1", "place": "doc_id > d0 or again"}[self.scope]

    def _ends(self, *place: str) -> tuple[Column, Column]:
        """The first member of a group, and one that goes if any does: by documents without an id last, and first."""
        void = F.col("doc_id").isNull() if self.scope == "anywhere" else F.col("doc_id").isNotNull()
        return F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "th", *place)).alias("low"), F.max(F.struct(void.alias("void"), "doc_id", "th", *place)).alias("high")

    def _pairs(self, groups: DataFrame, *more: str) -> DataFrame:
        """Requests for the first and the last member of groups (anchor, cls, d0, low, high) that repeat.

        Groups of the same two documents, in the same part of the first, share a key and thereby a shard.
        """
        two = groups.where("high.doc_id > d0") if self.scope == "document" else groups
        chunk = F.floor(F.col("low.first") / F.lit(max(1, self.shard // 2)))
        key = F.xxhash64("low.doc_id", "low.th", "high.doc_id", "high.th", chunk)
        side = lambda x, role: F.struct(key.alias("key"), F.lit(role).alias("role"), F.lit(True).alias("pair"), F.lit(True).alias("lone"), "anchor", "cls", *[f"{x}.{c}" for c in ("doc_id", "th", "first", "last", *more)])
        return two.select(F.explode(F.array(side("low", REFERENCE), side("high", PAIRED))).alias("x")).select("x.*")

    def _asked(self, requests: DataFrame, *by: str) -> DataFrame:
        return requests.groupBy(*by).agg(F.collect_list(F.struct("key", "role", "pair", "lone", "anchor", "cls", "first", "last")).alias("segs"))

    def _resolved(self, segments: DataFrame) -> DataFrame:
        """What shards tell of segments."""
        return materialise(segments.repartition("key").sortWithinPartitions("key").mapInArrow(self.shards, ddl(_TOLD)), "told")

    def _confirmed(self, groups: DataFrame, hot: DataFrame) -> DataFrame:
        """Groups (anchor, cls, d0, low, high: doc_id, th, first, last, at) of stretches of hot segments, without those that
        the structure refutes."""
        if not self.resolve:
            return groups
        asked = self._asked(self._pairs(groups, "at"), "anchor", "doc_id", "th", "at")
        h, r = hot.alias("h"), asked.alias("r")
        on = F.expr("h.key = r.anchor and h.doc_id <=> r.doc_id and h.th = r.th and h.first = r.at")
        found = h.join(r.hint("merge"), on).select("h.doc_id", "h.th", F.col("h.first").alias("base"), F.col("h.body").cast("string").alias("text"), "r.segs")
        told = self._resolved(found.mapInArrow(self.segments, _SEG_DDL)).select("anchor", "cls")
        return materialise(groups.join(told, ["anchor", "cls"], "left_semi"), "confirmed")

    def _settle(self, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ranges to remove, segments with the blocks that are settled) from whole blocks of windows."""
        key = ["anchor", "doc_id", "th", "first"]
        segs = hot.select(F.col("key").alias("anchor"), "doc_id", "th", "first", "lone", "body")
        blk = materialise(segs.mapInArrow(self.blocks, ddl(_BLK)), "blocks")
        place = blk.select("anchor", F.col("bh").alias("cls"), "doc_id", "th", F.col("s").alias("first"), (F.col("s") + (self.block - 1)).alias("last"), F.col("first").alias("at"))
        count = materialise(place.groupBy("anchor", "cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), *self._ends("first", "last", "at")).where("n > 1"), "blocks")
        count = self._confirmed(count, hot).withColumnRenamed("cls", "bh")
        me = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "th", F.col("s").alias("first"), (F.col("s") + (self.block - 1)).alias("last"), F.col("first").alias("at"))
        met = blk.join(count, ["anchor", "bh"]).withColumn("rep", me == F.col("low"))
        met = met.withColumn("again", ~F.col("rep") & F.col("doc_id").eqNullSafe(F.col("low.doc_id"))).where(self._rule)
        met = materialise(met.select(*key, "s", "lone", "rep"), "settled")
        done = met.groupBy(*key).agg(F.collect_list(F.struct("s", "rep")).alias("settled"))
        a, b = segs.alias("a"), done.alias("b")
        on = F.expr("a.anchor = b.anchor and a.doc_id <=> b.doc_id and a.th = b.th and a.first = b.first")
        left = a.join(b, on, "left").select("a.anchor", "a.doc_id", "a.th", "a.first", "a.lone", "a.body", "b.settled")
        gone = met.where("lone").select("doc_id", "th", F.col("s").alias("first"), (F.col("s") + (self.block - 1)).alias("last"), F.col("first").alias("at"))
        # Windows come with (anchor, doc_id, th, first, lone, body, settled).
        return gone, left

    def _hot(self, hot: DataFrame) -> DataFrame:
        """(doc_id, th, first, last, at): what goes of the segments of hot anchors."""
        gone = None
        if self.size - self.gram + 1 >= self.block:
            gone, segs = self._settle(hot)
        else:
            segs = hot.select(F.col("key").alias("anchor"), "doc_id", "th", "first", "lone", "body", F.lit(None).cast("array<struct<s:int,rep:boolean>>").alias("settled"))
        key = ["anchor", "doc_id", "th", "first"]
        far = segs.select(*key, F.lit(None).cast("int").alias("left"), F.lit(None).cast("int").alias("right")).limit(0)
        if self.size - self.gram >= self.block:
            ctx = hot.select(F.col("key").alias("anchor"), "doc_id", "th", "first", "lone", "body").mapInArrow(self.contexts, ddl(_CTX))
            alone = ctx.groupBy("anchor", "side", "k", "eh").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first")).alias("who")).where("n = 1")
            far = alone.groupBy("anchor", "who.doc_id", "who.th", "who.first").agg(*[F.min(F.when(F.col("side") == i, F.col("k"))).alias(c) for i, c in enumerate(("left", "right"))])
        a, b = segs.alias("a"), far.alias("b")
        on = F.expr("a.anchor = b.anchor and a.doc_id <=> b.doc_id and a.th = b.th and a.first = b.first")
        segs = a.join(b, on, "left").select("a.*", "b.left", "b.right")
        wins = materialise(segs.mapInArrow(self.windows, ddl(_WIN)), "windows")
        if self.scope == "place":
            wins = wins.withColumn("again", F.row_number().over(Window.partitionBy("anchor", "wh", "doc_id", "th").orderBy("s")) > 1)
        place = wins.select("anchor", F.col("wh").alias("cls"), "doc_id", "th", F.col("s").alias("first"), F.col("s").alias("last"), "at")
        count = materialise(place.groupBy("anchor", "cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), *self._ends("first", "last", "at")).where("n > 1"), "windows")
        count = self._confirmed(count, hot).select("anchor", F.col("cls").alias("wh"), "n", "d0")
        single = wins.join(count, ["anchor", "wh"]).where("lone").where(self._rule).select("doc_id", "th", F.col("s").alias("first"), F.col("s").alias("last"), "at")
        return single if gone is None else single.unionByName(gone)

    def _twins(self, twins: DataFrame, decided: DataFrame) -> DataFrame:
        """Ranges to remove from what is equal to a representative in its own document: those decided for it, moved."""
        held = F.collect_set(F.struct((F.col("first") - F.col("at")).alias("s"), (F.col("last") - F.col("at")).alias("e")))
        # Written first, as above: a document may repeat one passage any number of times.
        decided = materialise(decided.groupBy("doc_id", "th", "at").agg(held.alias("held")), "decided")
        t, r = twins.alias("t"), decided.alias("r")
        both = t.join(r.hint("merge"), F.expr("t.doc_id = r.doc_id and t.rep_th = r.th and t.at = r.at"))
        both = both.select("t.doc_id", "t.th", F.col("t.first").alias("to"), F.explode("r.held").alias("x"))
        return both.select("doc_id", "th", (F.col("to") + F.col("x.s")).alias("first"), (F.col("to") + F.col("x.e")).alias("last"))

    def spans(self, docs: DataFrame) -> DataFrame:
        """(doc_id, th, first, last): ranges of windows to remove; docs has doc_id, th and text."""
        ready(docs.sparkSession)
        occ = materialise(docs.mapInArrow(self.occurrences, ddl(_OCC)), "anchors")
        seen = occ.groupBy("anchor").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).where("n > 1" if self.scope != "document" else "n > 1 and d1 > d0")
        # Written first: a join of two plain exchanges can split a hot anchor, one that follows an aggregation can't.
        hits = materialise(occ.join(materialise(seen.select("anchor"), "repeated"), "anchor"), "hits")
        kept = [f.name for f in _SPAN]
        cls = materialise(hits.groupBy("anchor", "cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("d0"), *self._ends("first", "last")), "classes")
        size = materialise(cls.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "sizes")
        most = self.most if self.resolve else 0
        # Representatives whose class alone doesn't condemn them are open; the others still serve as references. A long
        # line is one window, so its class tells all.
        lone = F.col("n") == 1 if self.scope == "anywhere" else F.lit(True)
        role = F.when(F.col("classes") > most, HOT).when(lone, OPEN).otherwise(REFERENCE)
        reps = cls.where("low.last >= 0").join(size, "anchor").select(F.col("anchor").alias("key"), role.alias("role"), F.lit(False).alias("pair"), lone.alias("lone"), "anchor", "cls", "low.doc_id", "low.th", "low.first", "low.last")
        if self.resolve:
            reps = reps.unionByName(self._pairs(cls.where("n > 1")))
        by_doc = self._asked(reps, "doc_id", "th")
        d, s = docs.alias("d"), by_doc.alias("s")
        # Merge joins at every size: a broadcast of a small table's rows would only hide how the exchange grows.
        both = d.join(s.hint("merge"), F.expr("d.doc_id <=> s.doc_id and d.th = s.th")).select("d.doc_id", "d.th", F.lit(0).alias("base"), "d.text", "s.segs")
        segs = materialise(both.mapInArrow(self.segments, _SEG_DDL), "segments")
        hot = segs.where(F.col("role") == HOT)
        open_ = None if hot.isEmpty() else self._hot(hot)
        if self.resolve:
            told = self._resolved(segs.where(F.col("role") != HOT))
            sure = materialise(cls.join(told.where("anchor is not null").select("anchor", "cls"), ["anchor", "cls"], "left_semi"), "sure")
            some = told.where("anchor is null").select(*kept, "at")
            open_ = some if open_ is None else some.unionByName(open_)
        else:
            sure = cls.where("n > 1")
        # Tables are written before joins, so that Spark can split what a common passage makes of one key.
        whole = hits.join(sure.select("anchor", "cls", "d0", "n"), ["anchor", "cls"]).where(self._rule).select(kept)
        if open_ is None:
            return whole
        if self.scope != "document":
            return materialise(whole, "members").unionByName(open_.select(kept))
        # Members in the document of their representative share its fate.
        reps = materialise(cls.where("n > 1").join(size, "anchor").select("anchor", "cls", "low"), "twins")
        twins = hits.join(reps, ["anchor", "cls"]).where(F.expr("doc_id = low.doc_id and not (th = low.th and first = low.first)"))
        twins = twins.select(*kept, F.col("low.th").alias("rep_th"), F.col("low.first").alias("at"))
        open_ = materialise(open_, "decided")
        return materialise(whole, "members").unionByName(self._twins(materialise(twins, "twins"), open_)).unionByName(open_.select(kept))

    def removals(self, documents: DataFrame, extra: list[str] = ()) -> DataFrame:
        """documents with a column gone: the ranges of windows (or single long lines, last = -1) to remove; null: none."""
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"), *extra)
        spans = materialise(self.spans(docs.select("doc_id", "th", "text")).groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "spans")
        d, s = docs.alias("d"), spans.alias("s")
        on = F.expr("d.doc_id <=> s.doc_id and d.th = s.th")
        return d.join(s.hint("merge"), on, "left").select(*[f"d.{c}" for c in docs.columns if c != "th"], "s.gone")

    def mask(self, n: int, gone: list[dict] | None) -> np.ndarray:
        """Which of a document's n units its removals cover."""
        edge = np.zeros(n + 1, np.int64)
        for x in gone or ():
            edge[x["first"]] += 1
            edge[x["first"] + 1 if x["last"] < 0 else x["last"] + self.size] -= 1
        return np.cumsum(edge[:-1]) > 0
