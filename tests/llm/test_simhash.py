"""SimHash components against brute force."""

import random

import xxhash

from stackloom.llm import simhash
from stackloom.llm.components import components


def brute(rows, radius=2):
    fps = []
    for _, t in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    name = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            name[c] = min(name.get(c, d), d)
    return sorted(((d, f"{f:016x}", name.get(c)) for (d, _), f, c in zip(rows, fps, comp)), key=str)


def test_near_duplicates(spark, monkeypatch):
    rnd = random.Random(3)
    vocab = [f"W{i}ß" for i in range(99)]
    rows = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([0, 1, 2, 3, 40])))) for i in range(40)]
    base = rnd.choices(vocab, k=300)
    for i in range(40, 70):
        w = list(base)
        w[rnd.randrange(300)] = "x"
        rows.append((i, " \x0b\n".join(w)))
    rows += [(70, None), (71, ""), (None, "W1ß"), (5, rows[6][1]), (5, rows[6][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 component_id").repartition(3)
    links = simhash.links
    for bucket in (2048, 2):
        monkeypatch.setattr(simhash, "links", lambda fps, radius, n=bucket: links(fps, radius, n))
        assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str) == brute(rows)


def test_covering_masks():
    for positions in (list(range(64)), list(range(3, 30))):
        ms = simhash.masks(positions, 2)
        assert all(any(not m >> i & 1 and not m >> j & 1 for m in ms) for i in positions for j in positions)


def test_forest_connects():
    rnd = random.Random(4)
    fps = list({rnd.getrandbits(5) << 3 for _ in range(25)})
    for radius in (0, 1, 2):
        got = simhash.forest(fps, radius)
        assert all((x ^ y).bit_count() <= radius for x, y in got)

        def groups(pairs):
            name = {f: f for f in fps}
            for _ in fps:
                for x, y in pairs:
                    name[x] = name[y] = min(name[x], name[y])
            return name

        assert groups(got) == groups([(x, y) for x in fps for y in fps if (x ^ y).bit_count() <= radius])


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(300, 300), (1, 0), (None, 3)]
    name = {x: x for e in edges if None not in e for x in e}
    for _ in name:
        for u, v in edges:
            if u is not None:
                name[u] = name[v] = min(name[u], name[v])
    df = spark.createDataFrame(edges, "u long, v long").selectExpr("v", "u", "1 node")
    for finish in (1000, 15):
        assert {r["node"]: r["component"] for r in components(df, finish).collect()} == name
    assert components(df.limit(0)).count() == 0


def test_representatives(spark):
    rows = [(4, "a b c d", "x"), (4, "a b c d", "x"), (9, "a b c d", "y"), (4, "other words here now", "z"), (None, "a b c d", "n"), (None, "alone", "n"), (2, "", "e"), (1, None, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = sorted(map(tuple, simhash.representatives(df).collect()), key=str)
    assert got == sorted([(4, "a b c d", "x"), (4, "other words here now", "z"), (None, "alone", "n"), (1, None, "e")], key=str)


def test_representatives_keep_clashing_columns(spark):
    rows = [(1, "a b c d", 7, 8), (2, "a b c d", 9, 10), (None, None, 1, 2), (3, "e f g h", 0, 0), (3, "e f g h", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, many int").selectExpr("*", "1 _th", "2 r_id", "3 row", "4 d_th")
    got = simhash.representatives(df)
    assert got.columns == df.columns and sorted(((r["doc_id"], r["_id"]) for r in got.collect()), key=str) == [(1, 7), (3, 0), (None, 1)]
    assert simhash.representatives(df.limit(0)).count() == 0
