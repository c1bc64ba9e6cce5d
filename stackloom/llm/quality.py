"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and its diagonal. A document's score is the
posterior of class 1 from the difference of the two Mahalanobis log-densities, with the Cholesky factors of both
covariances computed once. Moments are sums, so training aggregates in Spark and only two rows reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.common import held_out, materialise, ready, rows_bytes, slices

THRESHOLD = 0.3
#: Weight of the pooled covariance, and of its diagonal within that.
SHRINK, DIAGONAL = 0.2, 0.1
#: Words by which rates are smoothed, so that very short texts stay near the usual rates.
PRIOR_WORDS = 12

FEATURES = ("length", "word_length", "variety", "stutter", "upper", "symbols", "pipes", "exclamations", "stops", "line_length", "line_variety", "beyond_ascii")

_CLASS = np.zeros((256, 7))
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c, 0] = "A" <= _ch <= "Z"
    _CLASS[_c, 1] = _ch in "#$%&*@^~_=<>{}[]\\/+`"
    _CLASS[_c, 2] = _ch == "|"
    _CLASS[_c, 3] = _ch in "!?"
    _CLASS[_c, 4] = _ch in ".,;:"
    _CLASS[_c, 5] = _c >= 0xC0
    _CLASS[_c, 6] = _c < 0x80 or _c >= 0xC0


def features(text: bytes) -> list[float]:
    """Transformed statistics of one whole text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS if text else np.zeros(7)
    upper, symbols, pipes, bangs, stops, accents, chars = counts.tolist()
    words = text.split()
    n = len(words)
    m = n + PRIOR_WORDS
    lines = [x for x in text.split(b"\n") if x.strip()]
    stutter = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    distinct = len(set(words))
    # Variety falls slowly with length in natural text, so compare logarithms; the prior counts as all different.
    variety = np.log(distinct + PRIOR_WORDS) / np.log(m)
    # Rates stay linear: a phone number or a key in a short text is then far nearer to usual text than to junk.
    return [
        np.log1p(n), (chars + 6 * PRIOR_WORDS) / m, variety, stutter / m, upper / (chars + 6 * PRIOR_WORDS), symbols / m, pipes / m, bangs / m, stops / m,
        np.log1p((n + PRIOR_WORDS) / (len(lines) + 1)), (len(set(lines)) + 2) / (len(lines) + 2), accents / (chars + 6 * PRIOR_WORDS),
    ]


def statistics(documents: DataFrame, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, the features of every row as one array x, and the columns in keep."""

    def run(batches):
        for batch in (x for b in batches for x in slices(b, 2)):
            rows = [features(t) for t in rows_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.list_(pa.float64())), *batch.columns[3:]], names=["doc_id", "held_out", "x", *keep])

    ready(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("words"), *keep)
    kinds = "".join(f", `{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)
    return docs.mapInArrow(run, "doc_id long, held_out boolean, x array<double>" + kinds)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log-density constants of both classes."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]

    @staticmethod
    def fit(moments: list[tuple[float, np.ndarray, np.ndarray]]) -> Discriminant:
        """moments: for classes 0 and 1 the count, the sum and the sum of outer products of the features."""
        d = len(FEATURES)
        total = sum(m[0] for m in moments)
        means = [s / max(n, 1) for n, s, _ in moments]
        within = [q - n * np.outer(mu, mu) for (n, _, q), mu in zip(moments, means)]
        pooled = sum(within) / max(total - 2, 1) + 1e-6 * np.eye(d)
        target = (1 - DIAGONAL) * pooled + DIAGONAL * np.diag(np.diag(pooled))
        factors, constants = [], []
        for (n, _, _), w in zip(moments, within):
            cov = (1 - SHRINK) * (w / n if n > 1 else pooled) + SHRINK * target
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            constants.append(np.log((n + 1) / (total + 2)) - np.log(np.diag(low)).sum())
        return Discriminant(means, factors, constants)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 for each row of x."""
        density = [c - 0.5 * np.square((x - mu) @ f.T).sum(axis=1) for mu, f, c in zip(self.means, self.factors, self.constants)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def train(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the rows of stats whose doc_id is not held out and has a label quality of 0 or 1."""
    d = len(FEATURES)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = stats.where(~F.col("held_out")).join(marks, "doc_id").select("y", *[F.col("x")[i].alias(f"x{i}") for i in range(d)])
    sums = [F.sum(f"x{i}") for i in range(d)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i in range(d) for j in range(i, d)]
    found = {r[0]: r[1:] for r in rows.groupBy("y").agg(F.count("*"), *sums).collect()}
    moments = []
    for y in (0, 1):
        n, *rest = found.get(y, [0] * (1 + len(sums)))
        q = np.zeros((d, d))
        q[np.triu_indices(d)] = rest[d:]
        moments.append((n, np.array(rest[:d], float), q + np.triu(q, 1).T))
    return Discriminant.fit(moments)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, held_out, score, predicted.

    Learns from labels (doc_id, quality) of rows outside the held-out fold; a doc_id labelled twice counts as 0 if any
    label is. Null texts count as empty and get a score like any other; a null doc_id has no label; labels other than 0
    and 1 are passed over; without labels of a class its covariance is the pooled one; repeated rows stay rows; further
    columns are ignored and never seen by the score.
    """
    stats = materialise(statistics(documents), "statistics")
    return scored(stats, train(stats, labels), threshold=threshold)


def scored(stats: DataFrame, model: Discriminant, keep: list[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns in keep of every row of stats."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= threshold).astype(np.int32)), *batch.columns[3:]], names=["doc_id", "held_out", "score", "predicted", *keep])

    kinds = "".join(f", `{k}` {stats.schema[k].dataType.simpleString()}" for k in keep)
    return stats.select("doc_id", "held_out", "x", *keep).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + kinds)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
