"""Benchmark decontamination: BM25 retrieval of test items by block-max WAND, then a check of the overlap.

Items are the indexed side. A posting holds BM25's weight of a term in an item as a share of the item's score for its
own text, so 1 is a full copy whatever the item's length. Items are numbered in blocks, each with its largest weight
per term. Every passage of every document is a query: blocks whose upper bound stays below the threshold are skipped
(numpy, for a batch of passages at once), the others are walked by WAND with block maxima as bounds. What scores above
the threshold is verified: shingles of five words of the whole item, and the words of its answer, its last sentence.

How long a passage is depends on the item alone (``passage_words``), so items of different lengths are searched with
different passages and no item changes what is found of another. Indexes hold a bounded number of bytes; how items are
dealt to them changes nothing either. Long texts are searched some passages at a time.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.llm.common import materialise, ready, rows_bytes, slices
from stackloom.session import delete_on_exit, scratch_dir

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that retrieves it.
SCORE = 0.5
#: Share of an item's five-word shingles, and of its answer's words, that a passage must hold.
OVERLAP, ANSWER = 0.8, 0.5
SHINGLE = 5
BLOCK = 4
#: Bytes of the items' texts in one set of indexes: bounds what is broadcast. Larger benchmarks are searched set by set.
LIMIT = 4 << 20
#: Words of the shortest passage; an item of more than half as many has the next power of two that holds it twice.
PASSAGE = 128
#: Words of documents that are searched at once, steps of the longest passage in a stretch of one, blocks of items whose
#: postings a worker keeps as dictionaries, pieces in which a long text is cut into words: all bound memory alone.
WORDS, STEPS, KEPT, PIECE = 1 << 17, 64, 4_096, 1 << 20
#: A term in more items than this share, or this many, is common: its weight enters a block's bound as a constant.
COMMON, OFTEN = 0.05, 50

_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_LOWER = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-case words of letters, digits and characters beyond ASCII."""
    return text.decode().lower().encode().translate(_LOWER).split()


def shingles(ws: list[bytes]) -> set[bytes]:
    return {b" ".join(ws[i : i + SHINGLE]) for i in range(max(1, len(ws) - SHINGLE + 1))} if ws else set()


def answer(text: str) -> str:
    """The last sentence, or the second half of the words where there is one sentence."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p]
    ws = text.split()
    return parts[-1] if len(parts) > 1 else " ".join(ws[len(ws) // 2 :])


def passage_words(item_words: int) -> int:
    """Words of the passages that are searched for an item of so many words."""
    size = PASSAGE
    while size < 2 * item_words:
        size *= 2
    return size


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time; parts end at ASCII white space, where no word goes on."""
    at = 0
    while at < len(text):
        cut = _BLANK.search(text, at + PIECE)
        to = cut.start() if cut else len(text)
        yield words(text[at:to])
        at = to


def stretches(texts: list[bytes], step: int) -> Iterator[tuple[list[int], list[bool], list[list[bytes]]]]:
    """(text, whether more of it follows, words) of stretches of texts, some at a time.

    A stretch that is followed by more has STEPS steps; the next starts one step before its end, so each passage of two
    steps or less lies whole in one.
    """
    at, more, held, n = [], [], [], 0
    for i, text in enumerate(texts):
        rest: list[bytes] = []
        for part in pieces(text) if text else ():
            rest += part
            while len(rest) > STEPS * step:
                at.append(i)
                more.append(True)
                held.append(rest[: STEPS * step])
                rest = rest[(STEPS - 1) * step :]
                n += STEPS * step
                if n >= WORDS:
                    yield at, more, held
                    at, more, held, n = [], [], [], 0
        at.append(i)
        more.append(False)
        held.append(rest)
        n += len(rest)
        if n >= WORDS:
            yield at, more, held
            at, more, held, n = [], [], [], 0
    if held:
        yield at, more, held


@dataclass
class Index:
    """Inverted index of items with passages of one size: terms, postings in order of (term, item), texts to verify."""

    size: int
    ids: list[int]
    texts: list[str]
    terms: dict[bytes, int]
    first: np.ndarray
    item: np.ndarray
    share: np.ndarray

    def __post_init__(self) -> None:
        count, blocks = np.diff(self.first), -(-len(self.ids) // BLOCK)
        term, block = np.repeat(np.arange(len(count)), count), self.item // BLOCK
        common = (count > max(4, min(OFTEN, COMMON * len(self.ids))))[term]
        constant = np.bincount(self.item[common], self.share[common], blocks * BLOCK)
        self.constant = constant.reshape(blocks, BLOCK).max(axis=1)
        # Block maxima of the rarer terms, in order of (term, block).
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        lead = np.flatnonzero(new)
        most = np.maximum.reduceat(self.share, lead) if len(lead) else np.zeros(0)
        rare = ~common[lead]
        self.block, self.weight = block[lead][rare], most[rare]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term[lead][rare], minlength=len(count)))])
        # Postings in order of (block, term, item), for the walk.
        order = np.argsort(block, kind="stable")
        self.walk = np.concatenate([[0], np.cumsum(np.bincount(block, minlength=blocks))]), term[order], self.item[order], self.share[order]
        self.opened: dict[int, dict[int, list[tuple[int, float]]]] = {}
        self.checks: dict[int, tuple[set[bytes], set[bytes]]] = {}

    def __reduce__(self):
        return Index, (self.size, self.ids, self.texts, self.terms, self.first, self.item, self.share)

    @staticmethod
    def build(rows: list[tuple], total: int, average: float, size: int) -> Index:
        """rows: (item_id, text, [(term, frequency, document frequency)]); total and average are of all items."""
        rows = sorted(rows, key=lambda r: r[:2])
        terms: dict[bytes, int] = {}
        at, item, share = [], [], []
        for i, (_, _, counts) in enumerate(rows):
            length = sum(tf for _, tf, _ in counts)
            w = [np.log1p((total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)) for _, tf, df in counts]
            whole = sum(w)
            at += [terms.setdefault(bytes(t), len(terms)) for t, _, _ in counts]
            item += [i] * len(counts)
            share += [x / whole for x in w]
        order = np.argsort(np.array(at, np.int64), kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(terms)))])
        return Index(size, [r[0] for r in rows], [r[1] for r in rows], terms, first, np.array(item, np.int64)[order], np.array(share, float)[order])

    def open(self, block: int) -> dict[int, list[tuple[int, float]]]:
        """The postings of a block of items by term."""
        found = self.opened.get(block)
        if found is None:
            if len(self.opened) >= KEPT:
                self.opened.clear()
            ends, term, item, share = self.walk
            found = self.opened[block] = {}
            s = slice(ends[block], ends[block + 1])
            for t, i, w in zip(term[s].tolist(), item[s].tolist(), share[s].tolist()):
                found.setdefault(t, []).append((i, w))
        return found

    def check(self, item: int) -> tuple[set[bytes], set[bytes]]:
        """(shingles, words of the answer) of an item."""
        found = self.checks.get(item)
        if found is None:
            if len(self.checks) >= KEPT:
                self.checks.clear()
            text = self.texts[item]
            found = self.checks[item] = shingles(words(text.encode())), set(words(answer(text).encode()))
        return found

    def passages(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(stretch, first word, end) of passages at every half of their size."""
        step = self.size // 2
        each = np.maximum(1, -(-(counts - step) // step))
        of = np.repeat(np.arange(len(counts)), each)
        first = (np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)) * step
        return of, first, np.minimum(first + self.size, counts[of])

    def candidates(self, hit: np.ndarray, base: np.ndarray, counts: np.ndarray, score: float) -> tuple[np.ndarray, ...]:
        """Passages and blocks whose upper bound reaches the score; hit: term of every word, or -1; base: of stretches."""
        doc, first, end = self.passages(counts)
        rare = np.append(np.diff(self.start) > 0, False)  # the last stands for words of no item
        word = np.flatnonzero(rare[hit])
        step = self.size // 2
        of = np.searchsorted(base, word, side="right") - 1
        # A word lies in the passage that starts at its own half and in the one before; a term counts once in each.
        lead, last = np.searchsorted(doc, of), np.searchsorted(doc, of, side="right") - 1
        own = lead + (word - base[of]) // step
        at = np.concatenate([own, own - 1])
        ok = (at >= np.concatenate([lead, lead])) & (at <= np.concatenate([last, last]))
        pairs = np.unique((at * len(self.terms) + np.concatenate([hit[word]] * 2))[ok])
        at, term = np.divmod(pairs, max(1, len(self.terms)))
        several = self.start[term + 1] - self.start[term]
        blocks, found = len(self.constant), []
        # Sums of what the passages' terms add to blocks, so many postings at a time, cut between passages.
        cuts = np.searchsorted(at, np.unique(at[np.searchsorted(np.cumsum(several), np.arange(WORDS, max(1, several.sum()), WORDS))]))
        for i, j in zip([0, *cuts], [*cuts, len(at)]):
            some = several[i:j]
            inner = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            entry = np.repeat(self.start[term[i:j]], some) + inner
            cells, place = np.unique(np.repeat(at[i:j], some) * blocks + self.block[entry], return_inverse=True)
            bound = np.bincount(place, self.weight[entry], len(cells)) + self.constant[cells % blocks]
            found.append(cells[bound >= score - 1e-9])
        always = np.flatnonzero(self.constant >= score - 1e-9)  # common terms alone may reach the score there
        if len(always):
            found.append((np.arange(len(doc))[:, None] * blocks + always).ravel())
        p, b = np.divmod(np.unique(np.concatenate(found)), blocks)
        return p, b, doc, first + base[doc], end + base[doc]

    def wand(self, terms: list[int], block: int, score: float) -> list[tuple[int, float]]:
        """Items of a block that score at least so much for the terms, walked by pivots."""
        held = self.open(block)
        lists = [[x, 0, max(w for _, w in x)] for t in terms if (x := held.get(t))]
        found = []
        while lists:
            lists.sort(key=lambda c: c[0][c[1]][0])
            bound, pivot = 0.0, None
            for k, (_, _, most) in enumerate(lists):
                bound += most
                if bound >= score - 1e-9:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0][lists[pivot][1]][0]
            if lists[0][0][lists[0][1]][0] == item:
                total = 0.0
                for c in lists:
                    if c[0][c[1]][0] == item:
                        total += c[0][c[1]][1]
                        c[1] += 1
                if total >= score - 1e-9:
                    found.append((item, total))
            else:
                for c in lists[:pivot]:
                    while c[1] < len(c[0]) and c[0][c[1]][0] < item:
                        c[1] += 1
            lists = [c for c in lists if c[1] < len(c[0])]
        return found

    def search(self, at: list[int], flat: list[bytes], counts: np.ndarray, base: np.ndarray, score: float, overlap: float, answer_overlap: float, out: list[dict]) -> None:
        """Note in out, by text, the items that its stretches leak: item_id -> (score, overlap)."""
        hit = np.fromiter(map(self.terms.get, flat, repeat(-1)), np.int64, len(flat))
        kept: dict[int, tuple] = {}
        ps, bs, doc, first, end = self.candidates(hit, base, counts, score)
        for p, b in zip(ps.tolist(), bs.tolist()):
            if p not in kept:
                s, e = int(first[p]), int(end[p])
                kept = {p: (sorted({t for t in hit[s:e].tolist() if t >= 0}), flat[s:e], None)}
            terms, ws, sh = kept[p]
            for item, total in self.wand(terms, b, score):
                if sh is None:
                    sh = shingles(ws)
                    kept[p] = terms, ws, sh
                mine, said = self.check(item)
                share = len(mine & sh) / max(1, len(mine))
                heard = len(said.intersection(ws)) / max(1, len(said))
                if share >= overlap and heard >= answer_overlap:
                    leaks, key = out[at[int(doc[p])]], self.ids[item]
                    had = leaks.get(key, (0.0, 0.0))
                    leaks[key] = max(had[0], total), max(had[1], share)


def search(indexes: list[Index], texts: list[bytes], score: float, overlap: float, answer_overlap: float) -> list[dict[int, tuple[float, float]]]:
    """For each text the items that it leaks: item_id -> (score, overlap)."""
    out: list[dict] = [{} for _ in texts]
    step = max(x.size for x in indexes) // 2
    for at, more, held in stretches(texts, step):
        flat = [w for ws in held for w in ws]
        counts = np.array([len(ws) for ws in held], np.int64)
        base = np.cumsum(counts) - counts
        for index in indexes:
            # Where a stretch is followed by another, passages that start in its last step are left to that one.
            mine = counts - np.where(more, step - index.size // 2, 0)
            index.search(at, flat, mine, base, score, overlap, answer_overlap, out)
    return out


def indexes(benchmark: DataFrame, limit: int = LIMIT) -> Iterator[list[Index]]:
    """Sets of indexes of a benchmark (item_id, text), with corpus-wide statistics, one index for each size of passages.

    A set holds items of about ``limit`` bytes of text (one item at least): what reaches the driver at once.
    """
    ready(benchmark.sparkSession)

    def counted(batches):
        for batch in batches:
            out: dict[str, list] = {"item_id": [], "text": [], "size": [], "term": [], "tf": []}
            for item, text in zip(batch.column(0).to_pylist(), rows_bytes(batch.column(1))):
                ws = words(text)
                terms, tf = np.unique(np.array(ws, object), return_counts=True)
                for k, v in zip(out, (item, text.decode(), passage_words(len(ws)), terms.tolist(), tf.tolist())):
                    out[k].append(v)
            kinds = pa.int64(), pa.string(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out.values(), kinds)], names=list(out))

    rows = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("item_id is not null").dropDuplicates(["item_id", "text"])
    rows = rows.mapInArrow(counted, "item_id long, text string, size int, term array<binary>, tf array<long>").where("size(term) > 0")
    rows = materialise(rows, "items")
    each = rows.select("item_id", "text", "size", F.explode(F.arrays_zip("term", "tf")).alias("x")).select("item_id", "text", "size", "x.term", "x.tf")
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    full = each.join(df, "term").groupBy("item_id", "text", "size").agg(F.collect_list(F.struct("term", "tf", "df")).alias("counts"))
    total, length, held = rows.agg(F.count("*"), F.avg(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum(F.octet_length("text"))).first()
    if not total:
        return
    parts = max(1, min(total, -(-held // limit)))
    full = materialise(full, "terms")
    for part in range(parts):
        found: dict[int, list] = {}
        for r in full.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect():
            found.setdefault(r["size"], []).append((r["item_id"], r["text"], [tuple(x) for x in r["counts"]]))
        if found:
            yield [Index.build(x, total, length, size) for size, x in sorted(found.items())]


_LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("overlap", pa.float64())])
LEAKS = "array<struct<item_id:bigint,score:double,overlap:double>>"


def leaks_of(documents: DataFrame, shared: Broadcast, score: float, overlap: float, answer_overlap: float) -> DataFrame:
    """documents and, as last column, leaks: what each leaks of the items of one broadcast set."""
    at = documents.columns.index("text")
    names = [*documents.columns, "leaks"]

    def run(batches):
        for batch in (x for b in batches for x in slices(b, at)):
            found = search(shared.value, rows_bytes(batch.column(at)), score, overlap, answer_overlap)
            leaks = [[{"item_id": i, "score": s, "overlap": o} for i, (s, o) in sorted(x.items())] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, pa.list_(_LEAK))], names=names)

    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, T.StructField("leaks", T.DataType.fromDDL(LEAKS))]))


def find_leaks(documents: DataFrame, benchmark: DataFrame, score: float = SCORE, overlap: float = OVERLAP, answer_overlap: float = ANSWER, limit: int = LIMIT) -> DataFrame:
    """documents (with a column text) and, as last column, leaks: array of (item_id, score, overlap), empty if clean.

    A document leaks an item if one of its passages (of ``passage_words`` of the item) scores ``score`` of the item's own
    BM25 score, holds ``overlap`` of its five-word shingles (of all its words where there are fewer) and
    ``answer_overlap`` of its answer's words. Case and ASCII punctuation don't count; neither texts nor items are cut. Null and empty texts, and items without words or id, leak nothing; repeated
    rows are judged each by itself; every input column comes back, but one named leaks is replaced.

    A benchmark of one set is searched as the result is read. Of more, each set is a job of its own that writes what it
    found and then drops its indexes, so that a worker never holds two; documents are written first, each row with a key.
    """
    out = documents.drop("leaks")
    spark = ready(documents.sparkSession)
    sets = indexes(benchmark, limit)
    begun = list(islice(sets, 2))
    if not begun:
        return out.withColumn("leaks", F.array().cast(LEAKS))
    if len(begun) == 1:
        return leaks_of(out, spark.sparkContext.broadcast(begun[0]), score, overlap, answer_overlap)
    taken = {c.lower() for c in out.columns}
    key = next(c for c in map("row_key_{}".format, count()) if c not in taken)
    keyed = materialise(out.withColumn(key, F.expr("uuid()")), "keyed")
    path = f"{scratch_dir(spark)}/stackloom-leaks-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    for some in chain(begun, sets):
        shared = spark.sparkContext.broadcast(some)
        found = leaks_of(keyed.select(key, "text"), shared, score, overlap, answer_overlap)
        found.where(F.size("leaks") > 0).select(key, "leaks").write.mode("append").parquet(path)
        shared.destroy()
    leaks = spark.read.schema(f"{key} string, leaks {LEAKS}").parquet(path).groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return keyed.join(leaks, key, "left").withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS))).drop(key)


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, score, overlap) for every document that leaks an item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("x")).groupBy("doc_id", "x.item_id").agg(F.max("x.score").alias("score"), F.max("x.overlap").alias("overlap"))
