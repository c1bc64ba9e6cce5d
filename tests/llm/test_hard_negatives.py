"""Hard negatives against all pairs, bounds against scores, and odd tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm.hard_negatives import Anchors, Cells, hard_negatives, op13_hard_negatives
from tests.llm.util import same_as_sql

SCHEMA = "vec_id long, label int, embedding array<double>"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def plain(rows, every=5, positives=5, negatives=3, low=50, high=95):
    good = [(k, i, label, [math.floor(256 * x) for x in v]) for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for k, i, label, v in good:
        if i % every:
            continue
        other = sorted((-sum(a * b for a, b in zip(v, w)), j, n, m) for n, j, m, w in good if n != k and len(w) == len(v))
        for ps, pid, _, _ in [x for x in other if x[3] == label][:positives]:
            found = [(s, j) for s, j, _, m in other if m != label and low * -ps <= 100 * -s <= high * -ps][:negatives]
            out += [(i, pid, r, j, -ps, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, every=5, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", anchor string, key int").repartition(3)
    return sorted(map(tuple, hard_negatives(df, F.col("vec_id") % every == 0, **kw).select(*COLUMNS).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, seed):
    r = random.Random(seed)
    grain = (0.0, 0.25, 0.5, 0.05)[seed]  # coarse components make many ties
    value = lambda: (lambda x: round(x / grain) * grain if grain else x)(r.gauss(0.1, 0.4))
    rows = [(i, r.randrange(3), [value() for _ in range(6)]) for i in range(160)]
    got = run(spark, rows, group=2_000 if seed else 64 << 20)
    assert got == plain(rows) and got


def test_copies_labels_and_lengths(spark):
    r = random.Random(9)
    same = [0.5, 0.4, -0.3]
    rows = [(i, i % 4, same) for i in range(60)] + [(100 + i, i % 3, [r.gauss(0, 1) for _ in range(3)]) for i in range(80)] + [(200 + i, i % 2, [r.gauss(0.3, 1) for _ in range(5)]) for i in range(40)]
    rows += [(5, 1, [0.1, 0.9, 0.2]), (5, 1, [0.1, 0.9, 0.2]), (300, 1, []), (305, 1, []), (306, 2, []), (307, 2, [float("nan"), 1.0, 1.0]), (310, 1, [None, 1.0, 1.0]), (315, None, same), (None, 1, same), (320, 1, None), (325, 3, [float("inf"), 0.0, 0.0])]
    assert run(spark, rows) == plain(rows)


def test_empty_tables_and_no_anchors(spark):
    assert run(spark, []) == [] and run(spark, [(1, 1, [0.1])]) == [] and run(spark, [(5, None, [0.1])]) == []


def test_large_components_are_exact_or_an_error(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(2), [r.uniform(-60_000, 60_000) for _ in range(4)]) for i in range(60)]
    assert run(spark, rows) == plain(rows)
    with pytest.raises(Exception, match="range of scores"):
        run(spark, [(5, 1, [70_000.0]), (6, 1, [1.0])])


def test_bounds_hold_every_score():
    r = np.random.default_rng(2)
    x = np.floor(r.standard_t(2, (400, 12)) * 30).astype(np.int64)
    x[:, 3] = 7
    cells = Cells(x.min(axis=0).astype(float), x.max(axis=0).astype(float), x.mean(axis=0), x.std(axis=0))
    codes = cells.approximate(x)
    at = np.arange(12)
    assert (cells.low[at, codes] <= x).all() and (x <= cells.high[at, codes]).all()
    low, high = Anchors(x[:50], cells).bounds(slice(0, 50), codes)
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all() and (high - low).mean() < np.abs(score).mean()


def test_query_equals_its_sql(spark):
    same_as_sql(spark, "op13_hard_negatives", op13_hard_negatives)
