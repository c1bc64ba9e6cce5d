"""Substring dedup by suffix automata: matching statistics against reference shards remove maximal repeated spans.

A window of ``size`` words goes if its words also start in a document with a smaller doc_id. Candidate windows come
from content-defined anchors (repeats.py); what differs around a shared anchor is dealt to reference shards of
bounded size. Each shard's automaton grows in order of doc_id: a document streams through the automaton of all
smaller documents first, which gives the longest match ending at each of its words, and joins it afterwards.
An automaton of all references is never broadcast, since its size would grow with the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stackloom.llm.common import rows_bytes, table
from stackloom.llm.repeats import Repeats, ddl

#: Words of a window: the length threshold of a removed span.
SIZE = 50
GRAM = 16


class SuffixAutomaton:
    """Suffix automaton of several sequences of hashable symbols."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, next_: dict) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c) -> int:
        """A copy of q for the shorter strings that reach it through p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list) -> None:
        next_, link, length = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = next_[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(length[last] + 1, 0, {}), last
            while p >= 0 and c not in next_[p]:
                next_[p][c] = new
                p = link[p]
            if p >= 0:
                q = next_[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, symbols: list) -> list[int]:
        """Matching statistics: the length of the longest known string that ends at each symbol."""
        next_, link, length = self.next, self.link, self.length
        state = matched = 0
        out = []
        for c in symbols:
            while state and c not in next_[state]:
                state = link[state]
                matched = length[state]
            to = next_[state].get(c)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            out.append(matched)
        return out


def resolver(size: int):
    """Resolve a shard: the windows of each segment that an automaton of smaller documents holds; none without an id."""

    def resolve(segments: list[tuple[int | None, bytes]]) -> list[np.ndarray]:
        automaton, out = SuffixAutomaton(), []
        symbols: dict[bytes, int] = {}
        for doc, group in groupby(segments, key=lambda x: x[0]):
            seqs = [[symbols.setdefault(w, len(symbols)) for w in body.split()] for _, body in group]
            if doc is None:
                out += [np.zeros(max(0, len(s) - size + 1), bool) for s in seqs]
                continue
            out += [np.array(automaton.matches(s)[size - 1 :]) >= size for s in seqs]
            for s in seqs:
                automaton.add(s)
        return out

    return resolve


def frame(size: int = SIZE, gram: int | None = None) -> Repeats:
    return Repeats("word", size, gram or max(1, min(GRAM, size // 2)), "document", resolver(size))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.int32()))])


def remove_repeats(documents: DataFrame, size: int = SIZE, text: bool = True) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, n_words, n_removed, kept, kept_sha256, spans.

    Words are runs of characters other than ASCII white space. Each word under a window of ``size`` words that also
    starts in a document with a smaller doc_id goes; kept words are joined by one space; spans holds start and end
    word of each removed run in turn. Null texts have no words; rows with a null doc_id have no place
    in that order: they keep all words and take none from others; rows that share a doc_id don't remove each other's
    words; columns beyond doc_id and text are ignored. text=False leaves kept null.
    """
    rep = frame(size)

    def apply(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in _OUT}
            for doc, body, gone in zip(batch.column(0).to_pylist(), rows_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = body.split()
                n, spans = len(words), []
                if gone:
                    hit = rep.mask(n, gone)
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).tolist()
                    kept = [w for i, j in zip([0, *spans[1::2]], [*spans[::2], n]) for w in words[i:j]]
                else:
                    kept = words
                joined = b" ".join(kept)
                for k, v in zip(out, (doc, n, n - len(kept), joined.decode() if text else None, hashlib.sha256(joined).hexdigest(), spans)):
                    out[k].append(v)
            yield table(out, _OUT)

    return rep.removals(documents).mapInArrow(apply, ddl(pa.schema(list(_OUT)[:-1])) + ", spans array<int>")


def op4_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, text=False).drop("kept", "spans")
