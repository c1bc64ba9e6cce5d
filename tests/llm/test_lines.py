"""Line dedup against its SQL and brute force."""

import hashlib
import random

import duckdb

from stackloom.llm import line_dedup


def test_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(line_dedup.SQL).fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in line_dedup.op3_lines(spark, d).collect()}
    assert got == want and any(x[1] for x in got.values())


def test_brute_force(spark):
    rnd = random.Random(2)
    pool = [f"line {i} é" for i in range(12)] + ["", " ", " ".join("w" * 50)]
    rows = [(i, "\n".join(rnd.choices(pool, k=rnd.randint(0, 12)))) for i in range(40)] + [(50, None), (51, ""), (None, rnd.choice(pool))]
    for run in (2, 3):
        first, wide, want = {}, {}, []
        seqs = [[(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip()] for _, t in rows]
        hits = []
        for (d, _), s in zip(rows, seqs):
            hit = set()
            for i in range(len(s) - run + 1):
                if first.setdefault(tuple(x for _, x in s[i : i + run]), (d, i)) != (d, i) and d is not None:
                    hit |= {p for p, _ in s[i : i + run]}
            for i, (p, x) in enumerate(s):
                if len(x.split()) >= 50 and wide.setdefault(x, (d, i)) != (d, i) and d is not None:
                    hit.add(p)
            hits.append(hit)
        for (d, t), hit in zip(rows, hits):
            lines = (t or "").split("\n")
            kept = "\n".join(x for p, x in enumerate(lines) if p not in hit)
            want.append((d, len(lines), len(hit), hashlib.sha256(kept.encode()).hexdigest(), kept, "s"))
        df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' gone", "7 n_lines").repartition(3)
        got = line_dedup.remove_runs(df, run, keep=("gone",)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert line_dedup.remove_runs(df.limit(0)).count() == 0
