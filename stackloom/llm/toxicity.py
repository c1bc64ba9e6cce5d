"""Toxicity by multiple-instance learning: a noisy-or over sentences, trained from document labels.

A document is a bag of sentences and toxic if any sentence is: 1 - P = (1 - leak) * prod(1 - p_s), where p_s is logistic
in a sentence's features and sentences without features count as clean. Features are whole words and word beginnings
that tell the classes apart. The gradient reaches sentences through the noisy-or, so labels of documents teach which
sentences offend; scoring locates them.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import held_out, materialise, ready, rows_bytes, slices

THRESHOLD = 0.5
#: Labelled documents that training reads at most, chosen by a hash of doc_id; bounds the fit, not the scoring.
SAMPLE = 20_000
#: Features kept, the rows that one must occur in, and the lengths of word beginnings.
KEEP, LEAST = 600, 6
STARTS = (4, 5, 6, 7, 8)
STEPS, RATE, DECAY = 600, 0.1, 1e-4

_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]+")


def lowered(text: str) -> str:
    """The text in lower case, place by place: characters whose lower case is longer stay, so that places hold for both."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def marks(text: str) -> set[str]:
    """Features of a text: =word for whole words, and beginnings of words longer than them."""
    ws = set(_WORD.findall(lowered(text)))
    out = {"=" + w for w in ws}
    for k in STARTS:
        out.update(w[:k] for w in ws if len(w) > k)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts between sentence ends that hold more than white space."""
    cuts = [0, *[m.end() for m in _END.finditer(text)], len(text)]
    return [(s, e) for s, e in zip(cuts, cuts[1:]) if text[s:e].strip()]


@dataclass
class Model:
    """Weights of features, bias of a sentence and leak of a document."""

    weights: dict[str, float]
    bias: float
    leak: float

    def __post_init__(self) -> None:
        import ahocorasick

        # A string may be both a whole word and a beginning: keep both weights with it.
        both: dict[str, list] = {}
        for f, w in self.weights.items():
            both.setdefault(f.lstrip("="), [0.0, 0.0])[f.startswith("=")] += w
        self.automaton = ahocorasick.Automaton()
        for key, (start, whole) in both.items():
            self.automaton.add_word(key, (len(key), start, whole))
        if both:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, float]]:
        """(place, weight) of every feature in a lower-case text, each word's features once per occurrence."""
        out, n = [], len(text)
        if not self.weights:
            return out
        for end, (size, start, whole) in self.automaton.iter(text):
            begin, end = end - size + 1, end + 1
            if begin and text[begin - 1].isalpha():
                continue
            if end < n and text[end].isalpha():
                if start:
                    out.append((begin, start))
            elif whole:
                out.append((begin, whole))
        return out

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(score of the document, offending sentences as (start, end, score))."""
        lower = lowered(text)
        clean, found = 1 - self.leak, []
        hits = self.hits(lower)
        if hits:
            spans = sentences(text)
            starts, total = [s for s, _ in spans], {}
            for at, w in hits:
                k = bisect.bisect_right(starts, at) - 1
                total[k] = total.get(k, self.bias) + w
            for k, z in sorted(total.items()):
                p = 1 / (1 + np.exp(-z)) if z > -700 else 0.0
                clean *= 1 - p
                if p >= 0.5:
                    found.append((*spans[k], float(p)))
        return float(1 - clean), found


def fit(bags: list[list[list[int]]], y: np.ndarray, names: list[str]) -> Model:
    """Noisy-or by full-batch Adam on the log-likelihood; bags: per document, per sentence, feature numbers."""
    d = len(names)
    doc = np.array([i for i, b in enumerate(bags) for _ in b], np.int64)
    sent = [s for b in bags for s in b]
    row = np.repeat(np.arange(len(sent)), [len(s) for s in sent]) if sent else np.zeros(0, np.int64)
    col = np.array([f for s in sent for f in s], np.int64)
    w = np.zeros(d + 2)
    w[d], w[d + 1] = -1.0, -3.0  # bias of a sentence, logit of the leak
    m, v = np.zeros_like(w), np.zeros_like(w)
    n, s = len(bags), len(sent)
    for t in range(1, STEPS + 1):
        z = w[d] + np.bincount(row, w[col], s)
        p, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-w[d + 1]))
        log_clean = np.log1p(-leak) + np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        clean = np.exp(log_clean)
        # dL/dlog_clean: 1 for clean documents, -clean / (1 - clean) for toxic ones.
        g = np.where(y, -clean / np.maximum(1 - clean, 1e-9), 1.0)
        gs = -g[doc] * p  # d log(1 - p) / dz = -p
        grad = np.zeros_like(w)
        grad[:d] = np.bincount(col, gs[row], d)
        grad[d], grad[d + 1] = gs.sum(), -(g * leak).sum()
        grad = grad / max(n, 1) - DECAY * np.append(w[:d], [0, 0])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({k: float(x) for k, x in zip(names, w) if x}, float(w[d]), float(1 / (1 + np.exp(-w[d + 1]))))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold."""
    spark = ready(documents.sparkSession)
    picked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).where("y in (0, 1)")
    picked = picked.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.join(F.broadcast(picked), "doc_id")  # ``sample`` pairs of numbers at most

    def marked(batches):
        for batch in (x for b in batches for x in slices(b, 1, 1 << 18)):
            found = [(y, f) for y, t in zip(batch.column(2).to_pylist(), rows_bytes(batch.column(1))) for f in marks(t.decode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in ((0, pa.int32()), (1, pa.string()))], names=["y", "f"])

    rows = materialise(rows, "labelled")  # read by three jobs; labels without a document count nowhere
    size = rows.agg(F.count("*"), F.sum("y")).first()
    n, toxic = size[0], size[1] or 0
    share = toxic / max(n, 1)
    counts = rows.mapInArrow(marked, "y int, f string").groupBy("f").agg(F.count("*").alias("n"), F.sum("y").alias("t")).where(F.col("n") >= LEAST)
    gain = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share) + 1)
    names = [r[0] for r in counts.orderBy(F.desc(F.abs(gain)), "f").limit(KEEP).collect()] if 0 < toxic < n else []
    numbers = {f: float(i + 1) for i, f in enumerate(names)}

    def bagged(batches):
        lookup = Model(numbers, 0.0, 0.0)
        for batch in (x for b in batches for x in slices(b, 1)):
            out = []
            for t in rows_bytes(batch.column(1)):
                text = t.decode()
                starts, bag = [s for s, _ in sentences(text)], {}
                for at, number in lookup.hits(lowered(text)):
                    bag.setdefault(bisect.bisect_right(starts, at), []).append(int(number) - 1)
                out.append(list(bag.values()))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["y", "bag"])

    bags = rows.mapInArrow(bagged, "y int, bag array<array<int>>").collect()
    return fit([r[1] for r in bags], np.array([r[0] for r in bags], bool), names)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, held_out, score, predicted, offending.

    offending lists the sentences whose own score is 0.5 or more as (start, end, score), places counted in characters.
    Learns from labels (doc_id, toxic) outside the held-out fold; a doc_id labelled twice counts as toxic if any label
    is. Null texts count as empty and score the model's leak; a null doc_id has no label; labels other than 0 and 1 are
    passed over; with labels of one class alone there are no features; repeated rows stay rows; further columns are
    ignored and never seen by the score.
    """
    model = train(documents, labels, sample)
    place = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    plain = (model.weights, model.bias, model.leak)

    def run(batches):
        model = Model(*plain)
        for batch in batches:
            found = [model.score(t.decode()) for t in rows_bytes(batch.column(2))]
            score = np.array([s for s, _ in found], float)
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(spans, pa.list_(place))], names=["doc_id", "held_out", "score", "predicted", "offending"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.withColumn("n_offending", F.size("offending")).drop("offending")
