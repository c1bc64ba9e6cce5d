"""Classifiers: held-out accuracy, the named formulas, and odd rows."""

import zlib

import numpy as np

from stackloom.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_quality_query(spark):
    got = quality.op1_quality(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 1000
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.quality).mean() > 0.95


def test_discriminant_is_the_density_ratio():
    rnd = np.random.default_rng(1)
    d = len(quality.FEATURES)
    xs = [rnd.normal(size=(80, d)) * 2, rnd.normal(size=(150, d)) + 1]
    model = quality.Discriminant.fit([(len(x), x.sum(0), x.T @ x) for x in xs])
    pooled = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in xs) / 228 + 1e-6 * np.eye(d)
    target = (1 - quality.DIAGONAL) * pooled + quality.DIAGONAL * np.diag(np.diag(pooled))
    logs = []
    point = rnd.normal(size=(5, d))
    for x in xs:
        cov = (1 - quality.SHRINK) * np.cov(x.T, bias=True) + quality.SHRINK * target
        diff = point - x.mean(0)
        logs.append(np.log((len(x) + 1) / 232) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff))
    assert np.allclose(model.score(point), 1 / (1 + np.exp(logs[0] - logs[1])))


def odd(spark):
    docs = spark.createDataFrame([(1, "A plain text. Nothing more."), (2, None), (None, ""), (3, "x" * 200_000), (1, "A plain text. Nothing more.")], "doc_id long, text string").selectExpr("*", "1 quality", "0 toxic", "'a' x", "9 score")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None), (7, 5, 5)], "doc_id long, quality int, toxic int").selectExpr("*", "'t' text")
    return docs, labels


def test_quality_of_odd_rows(spark):
    docs, labels = odd(spark)
    for lab in (labels, labels.limit(0)):
        got = quality.classify(docs, lab).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_toxicity_query(spark):
    got = toxicity.op8_toxicity(spark, SF).toPandas()
    assert list(got.columns)[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == 1000
    both = got.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    out = both[both.held_out]
    assert (out.predicted == out.toxic).mean() > 0.93 and out.predicted.sum() > 0


def test_toxicity_locates_sentences():
    rnd = np.random.default_rng(2)
    names = ["=bad", "=fine"]
    bags = [[[1]] * int(rnd.integers(0, 4)) + ([[0]] if i % 3 == 0 else []) for i in range(300)]
    model = toxicity.fit(bags, np.arange(300) % 3 == 0, names)
    text = "All fine here. You BAD one! Nothing."
    score, found = model.score(text)
    assert score > 0.9 and [text[s:e].strip() for s, e, _ in found] == ["You BAD one!"]
    assert model.score("fine. badly. nothing")[0] < 0.2 and model.score("")[0] < 0.2


def test_toxicity_of_odd_rows(spark):
    docs, labels = odd(spark)
    for lab in (labels, labels.limit(0)):
        got = toxicity.classify(docs, lab).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(docs.limit(0), labels).count() == 0


def test_quality_training_equals_brute_force(spark):
    """Moments from Spark give the discriminant of the plain rows outside the held-out fold."""
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    got = quality.train(quality.statistics(spark.createDataFrame(docs[["doc_id", "text"]])), spark.createDataFrame(labels))
    marks = {int(d): int(y) for d, y in zip(labels.doc_id, labels.quality) if y in (0, 1)}
    xs: list[list] = [[], []]
    for d, t in zip(docs.doc_id, docs.text):
        if zlib.crc32(str(d).encode()) % 5 and int(d) in marks:
            xs[marks[int(d)]].append(quality.features((t or "").encode()))
    n = len(quality.FEATURES)
    arrays = [np.array(x, float).reshape(-1, n) for x in xs]
    want = quality.Discriminant.fit([(len(x), x.sum(0), x.T @ x) for x in arrays])
    point = np.vstack(arrays)
    assert len(point) > 20 and np.allclose(got.score(point), want.score(point), atol=1e-6)


def test_toxicity_gradient_climbs_to_the_maximum():
    """The fitted noisy-or beats every small change of its parameters in the penalised likelihood, computed plainly."""
    rnd = np.random.default_rng(3)
    bags = [[[int(rnd.integers(0, 3))] for _ in range(int(rnd.integers(0, 4)))] for _ in range(200)]
    y = np.array([any(s == [0] for s in b) != (rnd.random() < 0.1) for b in bags])
    model = toxicity.fit(bags, y, ["=a", "=b", "=c"])

    def value(w, bias, leak):
        total = 0.0
        for b, t in zip(bags, y):
            clean = 1 - 1 / (1 + np.exp(-leak))
            for s in b:
                clean *= 1 - 1 / (1 + np.exp(-(bias + sum(w[f] for f in s))))
            total += np.log(max(1 - clean, 1e-12)) if t else np.log(max(clean, 1e-12))
        return total / len(bags) - toxicity.DECAY / 2 * sum(x * x for x in w)

    at = [model.weights.get(k, 0.0) for k in ("=a", "=b", "=c")], model.bias, float(np.log(model.leak / (1 - model.leak)))
    best = value(*at)
    for i in range(5):
        for step in (-0.3, 0.3):
            w, bias, leak = list(at[0]), at[1], at[2]
            if i < 3:
                w[i] += step
            elif i == 3:
                bias += step
            else:
                leak += step
            assert value(w, bias, leak) <= best + 1e-4, (i, step)
