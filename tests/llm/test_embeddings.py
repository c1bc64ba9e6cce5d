"""Embedding links against brute force in double precision."""

import numpy as np

from stackloom.llm import embedding_dedup as E


def brute(rows, threshold):
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [E.unit(np.array([v], np.float64))[0] if o else None for (_, v), o in zip(rows, ok)]
    n = len(rows)
    adj = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (unit[i] @ unit[j] >= threshold or rows[i][1] == rows[j][1])] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        for i in range(n):
            for j in adj[i]:
                comp[i] = comp[j] = min(comp[i], comp[j])
    name = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            name[c] = min(name.get(c, d), d)
    return sorted([(d, len(a), name.get(c), d is not None and d == name.get(c)) for (d, _), a, c in zip(rows, adj, comp)], key=str)


def test_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(30, 16))
    vecs = [(base[i % 30] + rnd.normal(size=16) * rnd.choice([0, 0.05, 0.2, 0.3, 1.0])).astype(np.float32).tolist() for i in range(150)]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(200 + i, vecs[3]) for i in range(10)]
    nan, inf = float("nan"), float("inf")
    rows += [(300, None), (301, []), (302, [0.0] * 16), (303, [nan] + [1.0] * 15), (304, [inf] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, vecs[7]), (None, [0.0]), (5, vecs[9]), (308, [-0.0] + vecs[4][1:]), (309, [0.0] + vecs[4][1:]), (310, [1e-30] * 16), (311, [1e30] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 n_links", "2 key", "3 label").repartition(3)
    monkeypatch.setattr(E, "TILE", 16)
    for group in (E.GROUP, 40 * 16 * 8):
        assert sorted(map(tuple, E.near_duplicates(df, group=group).collect()), key=str) == brute(rows, 0.95)
    assert E.near_duplicates(df.limit(0)).count() == 0
    assert E.near_duplicates(df.where("vec_id = 300")).collect()[0]["kept"] is True


def test_bounds_hold():
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, norm, error = E.quantise(x)
    product = E.products(codes, codes).astype(float) * np.outer(scale, scale)
    bound = np.outer(error, norm) + np.outer(norm, error) + np.outer(error, error)
    assert (np.abs(x @ x.T - product) <= bound).all()


def test_wide_vectors():
    """1,536 and 4,096 dimensions: exact products, and links on the threshold as in double precision."""
    rnd = np.random.default_rng(5)
    for dim in (1_040, 1_536, 4_096):
        codes = rnd.choice([-127, 127, 126, -125], size=(20, dim)).astype(np.int8)
        assert (E.products(codes, codes) == codes.astype(np.int64) @ codes.T.astype(np.int64)).all()
        base = rnd.normal(size=(40, dim))
        other = rnd.normal(size=(40, dim))
        # Angles whose cosines lie closely around the threshold.
        c = 0.95 + np.linspace(-3e-9, 3e-9, 40)
        base = E.unit(base)
        other = E.unit(other - (other * base).sum(axis=1)[:, None] * base)
        near = base * c[:, None] + other * np.sqrt(1 - c * c)[:, None]
        x = np.concatenate([base, near]) * rnd.choice([1e-200, 1.0, 1e200], size=80)[:, None]
        side = E.Side(np.arange(80), np.ones(80, np.int64), x)
        na, nb, _ = E.linked(side, side, True, 0.95)
        u = E.unit(x)
        near = np.array([[np.einsum("i,i", u[i], u[j]) >= 0.95 for j in range(80)] for i in range(80)]) & ~np.eye(80, dtype=bool)
        assert 10 < near.sum() < 80 and (na + nb == near.sum(axis=1)).all()


def test_huge_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-300, 1e-300]), (4, [1e200, -1e200]), (5, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, E.near_duplicates(df).collect()), key=str) == brute(rows, 0.95)
