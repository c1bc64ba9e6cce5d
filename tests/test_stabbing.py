"""Ranges and addresses by sweep and slices, against looking at every range."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stackloom.operators import stabbing as S
from stackloom.operators.resolve import resolve_addresses, resolve_samples

MAP = "process_id long, ord int, base long, `end` long, executable boolean, name string"


def plain(address, ranges):
    """(base, name) of the first range in order of ord that holds an address."""
    u = address % (1 << 64)
    return next(((b, n) for _, b, e, n in sorted(ranges, key=lambda r: r[0]) if b % (1 << 64) <= u < e % (1 << 64)), (None, None))


@pytest.mark.parametrize("seed", range(20))
def test_stretches(seed):
    rng = np.random.default_rng(seed)
    first = rng.integers(0, 40, 15)
    last = first + rng.integers(0, 20, 15)
    order = rng.permutation(15)
    starts, decides = S.stretches(first.tolist(), last.tolist(), order.tolist())
    for k in range(-1, 65):
        at = np.searchsorted(starts, k, side="right") - 1
        held = [i for i in range(15) if first[i] <= k <= last[i]]
        assert (-1 if at < 0 else decides[at]) == (min(held, key=lambda i: order[i]) if held else -1)
    assert S.stretches([], [], [])[0].size == 0
    assert S.stretches([S.LOW], [S.HIGH], [0])[1].tolist() == [0]


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_overlapping_ranges(spark, few):
    """Nested, equal, touching and page-crossing ranges, all of one end, kernel addresses, nulls, and a process without a map."""
    rng = np.random.default_rng(5)
    rows, ranges = [], {}
    for p in range(4):
        for o in range(60):
            b = int(rng.integers(0, 3000)) if p else 7 * o
            e = b + int(rng.integers(0, 1500)) if p else 4000  # process 0: all end together
            ranges.setdefault(p, []).append((o, b, e, f"l{p}_{o % 50}"))
    ranges[3] += [(90, -500, -100, "kernel"), (91, 2900, -300, "wide")]
    rows = [(p, o, b, e, True, n) for p, r in ranges.items() for o, b, e, n in r]
    rows += [(1, -1, 0, 9999, False, "data"), (2, -1, 10, 10, True, "empty"), (None, 0, 0, 9999, True, "nobody"), (5, None, 0, 9999, True, "unordered")]
    asked = [(int(p), int(a)) for p in range(4) for a in [*rng.integers(-700, 4600, 400), 0, 10]] * 2 + [(9, 5), (None, 5), (1, None), (None, None), (5, 5)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in S.stab(spark.createDataFrame(asked, "process_id long, address long"), spark.createDataFrame(rows, MAP), few).collect()}
    assert len(got) == len(set(asked))
    for p, a in got:
        assert got[p, a] == (plain(a, ranges.get(p, [])) if a is not None else (None, None)), (p, a)
    final = {(r["process_id"], r["address"]): (r["library_name"], r["offset"]) for r in resolve_addresses(spark.createDataFrame(asked, "process_id long, address long"), spark.createDataFrame(rows, MAP), few).collect()}
    assert final[9, 5] == ("[unknown]", 5) and final[None, 5] == ("[unknown]", 5) and final[1, None] == ("[unresolved]", None) and final[5, 5] == ("[unresolved]", 5)


def test_empty(spark):
    none, maps = spark.createDataFrame([], "process_id long, address long"), spark.createDataFrame([], MAP)
    one = spark.createDataFrame([(1, 2)], "process_id long, address long")
    for few in (0, -1):
        assert S.stab(none, maps, few).count() == 0
        assert [tuple(r) for r in S.stab(one, maps, few).collect()] == [(1, 2, None, None)]


def test_one_process_with_a_million_ranges(spark):
    """Slices share out the ranges of one process, and ranges that span all of them reach each slice once."""
    n = 1_000_000
    maps = spark.range(n).selectExpr("1L process_id", "cast(id as int) + 10 ord", "id * 64 base", "id * 64 + if(id % 3 = 0, 200, 64) `end`", "true executable", "concat('l', id % 1000) name")
    wide = spark.createDataFrame([(1, n + 20 + k, 0, n * 64 - k, True, f"wide{k}") for k in range(50)], MAP)
    asked = spark.range(200_000).selectExpr("1L process_id", "(id * 7919) % 64100000 - 50 address")
    ranges = S.keyed(maps.unionByName(wide))
    began = time.perf_counter()
    got = S.stab_many(asked, ranges).toPandas()
    took = time.perf_counter() - began
    assert len(got) == 200_000 and took < 120
    k = got["address"].to_numpy()
    i = np.arange(n)
    want = np.full(len(k), -1)
    for back in (0, 1, 2, 3):  # the smallest ord that holds an address is that of the earliest range
        j = k // 64 - back
        ok = (j >= 0) & (j < n) & (k - j * 64 < np.where(j % 3 == 0, 200, 64))
        want = np.where(ok, j, want)
    named = np.where(want >= 0, pd.Series("l" + pd.Series(want % 1000).astype(str)), None)
    assert (got["name"].where(got["name"].notna(), None).to_numpy() == named).all() and len(i) == n
    sizes = S.pieces(ranges, [(1, int(x), s) for s, x in enumerate(S.LOW + np.arange(8) * 8_000_000)]).groupBy("slice").count().toPandas()
    assert len(sizes) == 8 and sizes["count"].max() < 1.2 * sizes["count"].median() and sizes["count"].sum() < n + 1000


def test_slices_do_not_grow(spark):
    """However many addresses and boundaries there are, a slice has no more than its share; with few partitions too."""
    maps = spark.range(100_000).selectExpr("1L process_id", "cast(id as int) ord", "id * 64 base", "id * 64 + 64 `end`", "true executable", "concat('l', id) name")
    for n in (200_000, 800_000):
        points = S.sliced(spark.range(n).selectExpr("1L process_id", "id * 8 + 3 address"), S.keyed(maps))
        sizes = points.groupBy("slice").agg(F.count("*").alias("n"), F.min("address").alias("low"), F.max("address").alias("high")).orderBy("low").collect()
        assert max(r["n"] for r in sizes) <= 1 << S.SLICE_BITS and sum(r["n"] for r in sizes) == n + 200_000
        assert all(a["high"] < b["low"] for a, b in zip(sizes, sizes[1:]))


def test_frames_are_never_broadcast(spark):
    """Whatever size Spark takes the frames for: the driver would hold all of them."""
    one = spark.range(1)  # tables of a known, small size
    samples = one.selectExpr("id + 1 process_id", "id entry_ord", "array(id + 5, id + 6) addrs", "id + 1 count")
    maps = one.selectExpr("id + 1 process_id", "0 ord", "id base", "id + 9 `end`", "true executable", "concat('l', id) name")
    symbols = one.selectExpr("concat('l', id) library", "id + 5 offset", "'f' function_name", "'f.c' filename", "1 line_number")
    found = resolve_samples(samples, maps, symbols)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert all(any("SortMergeJoin" in x and key in x for x in joins) and not any("Broadcast" in x and key in x for x in joins) for key in ("address#", "offset#")), joins
    assert [len(r["frames"]) for r in found.collect()] == [2]
