"""SentencePiece encoding and decoding by a prefix table of unique last tokens.

For a merge-type (BPE) vocabulary every prefix of a text has one encoding, and its last token is the only one
that matches there and is compatible with the last token of the prefix before it. An Aho-Corasick automaton gives the
tokens that end at each position; two tokens are compatible if undoing their merges never meets a pair across their
border that would have merged earlier. The ids are then read off backwards from the end.

Pieces never hold a space after another character and none holds a line break, so texts fall apart before
runs of spaces and around line breaks, and each different part is encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm.common import ready, rows_bytes, table
from stackloom.llm.repeats import ddl

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Different parts of texts that a worker remembers.
REMEMBER = 400_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def pieces(model: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind is normal, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), sp.get_score(i), kind(i)) for i in range(sp.get_piece_size())]


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]) -> None:
        import ahocorasick

        self.piece = [p for p, _, _ in vocabulary]
        self.byte = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == "byte"}
        self.value = {i: b for b, i in self.byte.items()}
        self.id = {p: i for i, (p, _, k) in enumerate(vocabulary) if k == "normal"}
        # Merges run from the highest score down; equal scores from left to right.
        ranks = {s: r for r, s in enumerate(sorted({vocabulary[i][1] for i in self.id.values()}, reverse=True))}
        self.rank = {i: ranks[vocabulary[i][1]] for i in self.id.values()}
        if 0 in self.id.values():
            raise ValueError("id 0 must not be a piece")
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id):
            raise ValueError("a piece crosses a space or a line break: texts can't be parted there")
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            tokens, last = self._merge(p)
            if tokens == [i]:  # a piece that its own merges never reach can't be in any encoding
                self.parts[i] = last
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.piece]
        self.plain = [p.replace(SPACE, " ") for p in self.piece]
        self.compatible: dict[int, bool] = {}
        self.memory: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _merge(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Token ids of a text whose characters are all pieces, merge by merge, and the last merge's two tokens."""
        ids, last = [self.id.get(c, -1) for c in text], None
        while True:
            best = min(((self.rank[t], i, t) for i, (x, y) in enumerate(zip(ids, ids[1:])) if x >= 0 and y >= 0 and (t := self.id.get(self.piece[x] + self.piece[y])) is not None), default=None)
            if best is None:
                return ids, last
            _, i, t = best
            last = ids[i], ids[i + 1]
            ids[i : i + 2] = [t]

    def _pair(self, left: int, right: int) -> bool:
        """Whether the merges of two adjacent tokens, run together, leave exactly these two."""
        limit = 1 << 60
        while True:
            joined = self.id.get(self.piece[left] + self.piece[right])
            if joined is not None and self.rank[joined] < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            ra, rb = (self.rank[left] if a else -1), (self.rank[right] if b else -1)
            if ra < 0 and rb < 0:
                return True
            # Undo the later of the two merges. A pair of equal rank loses to what stands left of it only.
            if ra > rb:
                limit, left = ra, a[1]
            else:
                limit, right = rb + 1, b[0]

    def encode_part(self, part: str) -> list[int]:
        # token[i]: last token of the first i characters; ids of pieces are never 0, which stands for an unset place.
        n = len(part)
        token = [0] * (n + 1)
        known, sizes = self.compatible.get, self.size
        for end, t in self.automaton.iter(part):
            end += 1
            if token[end]:
                continue
            start = end - sizes[t]
            if start:
                before = token[start]
                if before:  # 0: a character without a piece, which merges with nothing
                    ok = known(before << 20 | t)
                    if ok is None:
                        ok = self._learn(before, t)
                    if not ok:
                        continue
            token[end] = t
        ids: list[int] = []
        while n:
            t = token[n]
            if t:
                ids.append(t)
                n -= sizes[t]
            else:
                n -= 1
                ids += [self.byte[b] for b in reversed(part[n].encode())]
        ids.reverse()
        return ids

    def _learn(self, left: int, right: int) -> bool:
        if len(self.compatible) > 2_000_000:
            self.compatible.clear()
        ok = self.compatible[left << 20 | right] = self._pair(left, right)
        return ok

    def decode_part(self, ids: list[int]) -> str:
        if self.value.keys().isdisjoint(ids):
            return "".join([self.plain[i] for i in ids])
        out, raw = [], []
        for i in [*ids, None]:
            if i in self.value:
                raw.append(self.value[i])
                continue
            if raw:
                out.append(bytes(raw).decode("utf-8", "replace"))
                raw = []
            if i is not None:
                out.append(self.plain[i])
        return "".join(out)

    def _part(self, part: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a part that the younger memory lacks."""
        found = self.older.get(part)
        if found is None:
            ids = self.encode_part(part)
            found = ",".join(map(str, ids)), self.decode_part(ids)
        if len(part) <= 64:
            if len(self.memory) >= REMEMBER // 2:  # what was not seen for a whole generation is forgotten
                self.older, self.memory = self.memory, {}
            self.memory[part] = found
        return found

    def code(self, text: str) -> tuple[str, str]:
        """(ids joined by commas, decoded text) of a whole text."""
        if not text:
            return "", ""
        parts = PARTS.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.memory.get, parts))
        if None in found:
            found = [self._part(p) if x is None else x for p, x in zip(parts, found)]
        # Decoding drops the one space that encoding puts in front.
        return ",".join([x for x, _ in found]), "".join([x for _, x in found])[1:]


PARTS = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.string()), ("decoded", pa.string())])


def codec(vocabulary: list, key: str) -> Codec:
    """The worker's codec of a vocabulary; it and what it has learnt stay for the worker's life."""
    kept = sys.__dict__.setdefault("_stackloom_codecs", {})
    if key not in kept:
        kept[key] = Codec(vocabulary)
    return kept[key]


def encode_decode(documents: DataFrame, model: str | None = None, text: bool = True) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, ids, decoded.

    ids are the decimal ids joined by commas, without begin or end; decoded is what decoding them gives. Null texts
    count as empty and have no ids; ids and rows may repeat or be null, each row is coded by itself; further columns
    are ignored. text=False leaves ids and decoded null. model: path of a BPE model with byte fallback, identity
    normalisation and a dummy prefix, on the driver.
    """
    spark = ready(documents.sparkSession)
    vocabulary = pieces(model or default_model())
    key = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, whatever the corpus

    def run(batches):
        code = codec(shared.value, key).code
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for doc, body in zip(batch.column(0).to_pylist(), rows_bytes(batch.column(1))):
                ids, decoded = code(body.decode())
                sums = [hashlib.sha256(x.encode()).hexdigest() for x in (ids, decoded)]
                for k, v in zip(out, (doc, ids.count(",") + 1 if ids else 0, *sums, ids if text else None, decoded if text else None)):
                    out[k].append(v)
            yield table(out, _OUT)

    return documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, ddl(_OUT))


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False).drop("ids", "decoded")
