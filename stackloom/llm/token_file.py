"""Token ids in a binary file format with Simple-8b words: format("tokens8b"), and the encoder that feeds it.

A 64-bit word holds a selector in its upper four bits and as many ids as fit the rest at the selector's width. Ids too
wide for any selector are escapes: the word holds their place in a list of plain 64-bit numbers. Ids are packed in blocks of a fixed
number, each starting a new word, and a directory holds the first word of every block: blocks are packed in step with one
another, and decoding unpacks all words of a selector at once.

A file is a sequence of frames, each with whole documents of about a million ids and complete in itself, then a
directory of the frames. Documents are dealt by ranges of doc_id, so files follow each other in its order; the
manifest, written at the commit, tells how many ids lie before each file.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stackloom.llm.common import ready, rows_bytes, slices, table
from stackloom.llm.repeats import ddl
from stackloom.session import delete_on_exit, scratch_dir
from stackloom.sources.staging import Staging, store_of

MODEL, END = "word_bpe_49k.json", 1
#: Ids a word and bits an id, by selector from 1 on; selector 0 is an escape.
PACKED = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNT = np.array([1, *(n for n, _ in PACKED)])
BLOCK, FRAME, WIDEST = 1_024, 1 << 20, 60
MAGIC, VERSION = 0x46384253, 1
HEADER, FRAME_HEADER, FOOTER = struct.Struct("<IHHQ"), struct.Struct("<IQIII"), struct.Struct("<QQI")
#: Bytes of a file that a reading task takes.
SPLIT = 64 << 20


def _narrowest(ids: np.ndarray) -> np.ndarray:
    return (np.searchsorted(np.array([(1 << bits) - 1 for _, bits in PACKED], np.uint64), ids, side="left") + 1).astype(np.int8)


_NEED = _narrowest(np.arange(1 << 16, dtype=np.uint64))


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped ids) of unsigned 64-bit ids."""
    ids = ids.astype("<u8")
    blocks = -(-len(ids) // BLOCK)
    # Zeros after a block fit every selector, so its last word may hold fewer ids than it could.
    held = np.zeros((blocks, BLOCK + WIDEST), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[: len(ids)] = ids
    held[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # The narrowest selector that an id fits, as a number that grows with the width; 15 for escapes.
    need = (_NEED[held] if ids.max(initial=0) < len(_NEED) else _narrowest(held.reshape(-1))).reshape(held.shape)
    widest, spans = {1: need}, 1
    while spans * 2 <= WIDEST:
        last = widest[spans]
        widest[spans * 2] = np.maximum(last[:, : last.shape[1] - spans], last[:, spans:])
        spans *= 2
    best = np.where(need[:, :BLOCK] <= len(PACKED), len(PACKED), 0).astype(np.int8)
    for selector in range(len(PACKED) - 1, int(need[:, :BLOCK].min(initial=1)) - 1, -1):
        n = PACKED[selector - 1][0]
        k = 1 << (n.bit_length() - 1)
        fits = np.maximum(widest[k][:, :BLOCK], widest[k][:, n - k : n - k + BLOCK]) <= selector
        best[fits] = selector
    # All blocks step from word to word together.
    sizes = np.full(blocks, BLOCK)
    if blocks:
        sizes[-1] = len(ids) - BLOCK * (blocks - 1)
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        chosen = best[live, at[live]]
        steps.append((live, at[live], chosen))
        at[live] += COUNT[chosen]
        live = live[at[live] < sizes[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    block, place, selector = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")  # each block's words came in order
    block, place, selector = block[order], place[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    for s, (n, bits) in enumerate(PACKED, 1):
        some = np.flatnonzero(selector == s)
        for j in range(n if len(some) else 0):
            words[some] |= held[block[some], place[some] + j] << np.uint64(j * bits)
    escapes = np.flatnonzero(selector == 0)
    words[escapes] = np.arange(len(escapes), dtype=np.uint64)
    return words, np.searchsorted(block, np.arange(blocks)).astype(np.uint32), held[block[escapes], place[escapes]]


def unpack(words: np.ndarray, first: np.ndarray, escaped: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids that pack has packed."""
    if not n_ids:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int8)
    counts = COUNT[selector]
    ends = np.cumsum(counts)
    before = ends - counts
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    place = before - before[first][block]
    out = np.zeros((len(first), BLOCK + WIDEST), np.uint64)
    for s, (n, bits) in enumerate(PACKED, 1):
        some = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        for j in range(n if len(some) else 0):
            out[block[some], place[some] + j] = (words[some] >> np.uint64(j * bits)) & mask
    some = np.flatnonzero(selector == 0)
    out[block[some], place[some]] = escaped[words[some].astype(np.int64)]
    return out[:, :BLOCK].reshape(-1)[:n_ids]


def frame(docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    words, first, escaped = pack(ids)
    parts = [np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array(sizes, "<u8"), first.astype("<u4"), escaped.astype("<u8"), words.astype("<u8")]
    return FRAME_HEADER.pack(len(docs), len(ids), len(first), len(escaped), len(words)) + b"".join(p.tobytes() for p in parts)


def read_frame(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, which of them are null, ids of each document, ids) of a frame."""
    docs, n_ids, blocks, escapes, n_words = FRAME_HEADER.unpack_from(data)
    at, out = FRAME_HEADER.size, []
    for kind, n in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", blocks), ("<u8", escapes), ("<u8", n_words)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    doc, null, sizes, first, escaped, words = out
    return doc, null.astype(bool), sizes.astype(np.int64), unpack(words, first, escaped, n_ids)


@dataclass
class _Written(WriterCommitMessage):
    partition: int
    file: str | None
    docs: int
    ids: int


class TokenWriter(DataSourceArrowWriter):
    """Writes rows (doc_id, ids as little-endian unsigned 32-bit binary, or an array of longs) in the order they come."""

    def __init__(self, options: dict) -> None:
        self.staging = Staging(options["path"])

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        store, _, _ = store_of(self.staging.path)
        path = f"{self.staging.task_folder()}/tokens-{partition:06d}-{self.staging.job[:12]}.s8b"
        frames, docs, sizes, held, waiting = [], [], [], [], 0
        n_docs = n_ids = 0
        with store.open_output_stream(path) as out:
            out.write(HEADER.pack(MAGIC, VERSION, BLOCK, 0))
            at = HEADER.size

            def flush():
                nonlocal at, docs, sizes, held, waiting, n_docs, n_ids
                data = frame(docs, sizes, np.concatenate(held) if held else np.zeros(0, np.uint64))
                frames.append((at, n_ids, len(docs)))
                out.write(data)
                at, n_docs, n_ids = at + len(data), n_docs + len(docs), n_ids + waiting
                docs, sizes, held, waiting = [], [], [], 0

            for batch in iterator:
                binary = pa.types.is_binary(batch.schema.field("ids").type)
                rows = rows_bytes(batch.column("ids")) if binary else batch.column("ids")
                for doc, row in zip(batch.column("doc_id").to_pylist(), rows):
                    ids = np.frombuffer(row, "<u4") if binary else np.array(row.as_py() or [], np.int64).view(np.uint64)
                    docs.append(doc)
                    sizes.append(len(ids))
                    held.append(ids)
                    waiting += len(ids)
                    if waiting >= FRAME or len(docs) >= FRAME:
                        flush()
            if docs:
                flush()
            for entry in frames:
                out.write(FOOTER.pack(*entry))
            out.write(struct.pack("<QI", len(frames), MAGIC))
        return _Written(partition, path, n_docs, n_ids)

    def commit(self, messages) -> None:
        done = sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.partition)
        store, inner, _ = store_of(self.staging.path)
        self.staging.publish([m.file for m in done])
        manifest, before = [], 0
        for m in done:  # a line for each file, whatever it holds
            manifest.append({"file": m.file.rsplit("/", 1)[1], "docs": m.docs, "ids": m.ids, "start": before})
            before += m.ids
        with store.open_output_stream(f"{inner}/manifest.json") as out:
            out.write("\n".join(map(json.dumps, manifest)).encode())

    def abort(self, messages) -> None:
        self.staging.discard()


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    part: int
    parts: int


class TokenReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.digest = options["path"], options.get("digest", "none")

    def partitions(self):
        store, inner, _ = store_of(self.path)
        with store.open_input_stream(f"{inner}/manifest.json") as f:
            lines = f.read().decode().splitlines()
        out = []
        for m in map(json.loads, lines):
            file = f"{inner}/{m['file']}"
            parts = max(1, store.get_file_info(file).size // SPLIT)
            out += [_Part(file, m["start"], i, parts) for i in range(parts)]
        return out or [_Part("", 0, 0, 0)]

    def read(self, partition: _Part):
        if not partition.parts:
            return
        store, _, _ = store_of(self.path)
        schema = _CRC if self.digest == "crc32" else _IDS
        with store.open_input_file(partition.file) as f:
            size, tail = f.size(), struct.calcsize("<QI")
            f.seek(size - tail)
            n, magic = struct.unpack("<QI", f.read(tail))
            if magic != MAGIC:
                raise ValueError(f"{partition.file} is not a whole file of tokens")
            f.seek(size - tail - n * FOOTER.size)
            frames = list(FOOTER.iter_unpack(f.read(n * FOOTER.size)))
            ends = [x[0] for x in frames[1:]] + [size - tail - n * FOOTER.size]
            for i in range(partition.part, n, partition.parts):
                at, before, _ = frames[i]
                f.seek(at)
                doc, null, sizes, ids = read_frame(f.read(ends[i] - at))
                stops = np.cumsum(sizes)
                starts = stops - sizes
                columns = {"doc_id": pa.array(doc, pa.int64(), mask=null), "start": starts + before + partition.start, "n_tokens": sizes}
                if self.digest == "crc32":
                    flat = ids.astype("<u4")
                    columns["ids_crc32"] = np.array([zlib.crc32(flat[a:b]) for a, b in zip(starts, stops)], np.int64)
                else:
                    columns["ids"] = pa.LargeListArray.from_arrays(np.append(starts, stops[-1:]), ids.view(np.int64)).cast(pa.list_(pa.int64()))
                yield table(columns, schema)


_IDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int64()))])
_CRC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class TokenSource(DataSource):
    """Token files of a folder. Rows read are doc_id, start (ids of all documents before it), n_tokens, ids; digest=crc32
    gives ids_crc32, of the ids as little-endian unsigned 32-bit integers, in place of ids."""

    @classmethod
    def name(cls) -> str:
        return "tokens8b"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if self.options.get("digest") == "crc32" else "ids array<long>")

    def reader(self, schema):
        return TokenReader(dict(self.options))

    def writer(self, schema, overwrite):
        return TokenWriter(dict(self.options))


#: Text that the tokenizer treats apart at every blank and line break, so that each different part is encoded once: its
#: normalizer and its pattern of words must be these.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts and parts of nothing but blanks, line breaks, printable ASCII and Latin-1 letters, which normalization only
#: lower-cases, fall into words here; the library reads all others.
_PLAIN, _PLAIN_WORDS = re.compile("[ \n!-~À-ÖØ-öø-ÿ]*"), re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \na-z0-9ß-öø-ÿ]+")
#: Different words, and different other parts, that a worker remembers, and the longest of them.
REMEMBER, LONGEST = 800_000, 64


class Memory(dict):
    """A dictionary that forgets what was not asked for while half of REMEMBER new entries came."""

    def __init__(self, make) -> None:
        super().__init__()
        self.older, self.make = {}, make

    def __missing__(self, key: str) -> bytes:
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= REMEMBER // 2:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers; parts met before are looked up."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.model = self.tokenizer.model
        told = json.loads(model)
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        added = told.get("added_tokens") or []
        self.special = re.compile("|".join(re.escape(t["content"]) for t in added) or "(?!)")
        plain = (told.get("normalizer") or {}).get("normalizers") == _NORMAL and first.get("pattern") == {"Regex": _WORDS} and first.get("behavior") == "Removed"
        self.parted = plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in added)
        self.parts, self.words = Memory(self._part), Memory(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():  # as the characters that stand for its bytes
            word = "".join([x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(word)])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def _part(self, part: str) -> bytes:
        return self._plain(part) if _PLAIN.fullmatch(part) else self._whole(part)

    def _plain(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in _PLAIN_WORDS.findall(text.lower())])

    def encode(self, text: str) -> bytes:
        if not self.parted or self.special.search(text):
            return self._whole(text)
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        parts = self.parts
        return b"".join([parts[p] for p in text.replace("\n", " ").split(" ")])


def encoder(model: str, key: str) -> Encoder:
    """The worker's encoder of a model; what it remembers stays for the worker's life."""
    kept = sys.__dict__.setdefault("_stackloom_encoders", {})
    if key not in kept:
        kept[key] = Encoder(model)
    return kept[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


_ROWS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode(documents: DataFrame, model: str | None = None, end: int | None = END) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text), ids as little-endian unsigned 32-bit binary, in the order of the rows.

    Null texts count as empty. end, unless None, is appended to each document. model: a tokenizers file on the driver.
    """
    spark = ready(documents.sparkSession)
    with open(model or default_model(), encoding="utf-8") as f:
        told = f.read()
    key = f"{zlib.crc32(told.encode()):08x}-{len(told)}"
    shared = spark.sparkContext.broadcast(told)  # as large as the vocabulary, whatever the corpus
    last = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
        one = encoder(shared.value, key).encode
        for whole in batches:
            for batch in slices(whole, 1):
                yield table({"doc_id": batch.column(0), "ids": pa.array([one(t.decode()) + last for t in rows_bytes(batch.column(1))], pa.binary())}, _ROWS)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl(_ROWS))


def register(spark: SparkSession) -> SparkSession:
    """Make format("tokens8b") known to a session."""
    ready(spark)
    spark.dataSource.register(TokenSource)
    return spark


def write_tokens(documents: DataFrame, path: str, model: str | None = None, end: int | None = END) -> None:
    """Write the ids of documents (doc_id, text) to a new folder, in ascending order of doc_id, nulls first.

    Rows that share a doc_id follow each other in the order of their table, each as a document of its own, and may lie in
    several files, so one id may hold any share of the rows; further columns are ignored. A table without rows gives a
    manifest without files.
    """
    spark = register(documents.sparkSession)
    at = F.monotonically_increasing_id()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), at.alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    encode(rows, model, end).write.format("tokens8b").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str, digest: str = "none") -> DataFrame:
    """doc_id, start, n_tokens and ids (or ids_crc32 with digest='crc32') of every document of a folder of token files."""
    return register(spark).read.format("tokens8b").option("digest", digest).load(path)


def op12_tokens(spark, sf_dir: str) -> DataFrame:
    path = delete_on_exit(spark, f"{scratch_dir(spark)}/stackloom-tokens-{uuid.uuid4().hex}")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path, digest="crc32")
