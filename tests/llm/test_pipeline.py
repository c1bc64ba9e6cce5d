"""Each pipeline stage against its operator or a brute-force version, on the input that it gets."""

import hashlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as P
from stackloom.llm import line_dedup, quality, sentencepiece_bpe
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_simhash import brute as groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    root, frames = tmp_path_factory.mktemp("steps"), [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, frames[-1], SF).write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    return root, frames


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(steps):
    assert all(f.dtypes == steps[1][0].dtypes for f in steps[1][1:-1])


def test_quality(spark, steps):
    want = {r["doc_id"] for r in quality.op1_quality(spark, SF).collect() if r["predicted"]}
    before, after = rows(steps[1][0]), rows(steps[1][1])
    assert set(after) == want and 0 < len(want) < len(before) and all(after[d] == before[d] for d in want)


def test_lines(steps):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{steps[0]}/quality/*.parquet'")
    want = dict(con.execute(f"select doc_id, kept_sha256 from ({line_dedup.SQL})").fetchall())
    got = rows(steps[1][2])
    assert {d: hashlib.sha256(r["text"].encode()).hexdigest() for d, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_near_duplicates(steps):
    before = [(r["doc_id"], r["text"]) for r in steps[1][2].collect()]
    assert set(rows(steps[1][3])) == {c for _, _, c in groups(before)}


def test_decontamination(spark, steps):
    docs = [(r["doc_id"], r["text"]) for r in steps[1][3].collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {docs[i][0] for i, _ in leaks(docs, items)}
    assert set(rows(steps[1][4])) == {d for d, _ in docs} - bad


def test_tokens(steps):
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    got = rows(steps[1][5])
    for r in steps[1][4].collect():
        ids = sp.encode(r["text"])
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_stages(spark, steps):
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, steps[1][5].collect()))


EXTRA = ("held_out", "x", "predicted", "gone", "kept", "th", "fp", "row", "leaks", "ids", "`a.b`")


def folder(spark, root, docs, labels, items):
    """Tables of documents with clashing further columns, labels and benchmark."""
    docs.selectExpr("*", *[f"{i} {c}" for i, c in enumerate(EXTRA)]).write.parquet(f"{root}/documents.parquet")
    labels.selectExpr("*", "1 x", "2 held_out", "3 text").write.parquet(f"{root}/labels.parquet")
    items.selectExpr("*", "1 term", "2 leaks", "3 doc_id").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def stepped(spark, sf, root):
    frames = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in P.STAGES:
        stage(spark, frames[-1], sf).write.parquet(f"{root}/{name}")
        frames.append(spark.read.parquet(f"{root}/{name}"))
    return [sorted((r.asDict() for r in f.select(*[c for c in f.columns if c in (*P.COLUMNS, "n_tokens", "ids_sha256", "decoded_sha256")]).collect()), key=str) for f in frames]


def kept_lines(rows):
    """Texts after line dedup: all but the first place of pairs of lines and of single long lines goes."""
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    first, out = {}, []
    for r in rows:
        lines, hit = (r["text"] or "").split("\n"), set()
        solid = [p for p, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        place = r["doc_id"], r["text"]  # a row's own id never counts against another row of it
        for i, p in enumerate(solid):
            runs = [solid[i : i + 2]] if i + 1 < len(solid) else []
            runs += [[p]] if len(lines[p].split()) >= 50 else []
            for run in runs:
                d, t, at = first.setdefault(tuple(lines[q] for q in run), (*place, i))
                if r["doc_id"] is not None and (d != r["doc_id"] or (t == r["text"] and at != i)):
                    hit |= set(run)
        out.append("\n".join(x for p, x in enumerate(lines) if p not in hit))
    return sorted(zip([r["doc_id"] for r in rows], out), key=str)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    some = [tuple(r) for r in docs.select(*P.COLUMNS).orderBy("doc_id").limit(60).collect()]
    leaked = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first()["text"]
    good = some[0][1]
    odd = [(None, None, None, None, None), (None, good, None, "s", 1), (9001, None, "en", None, None), (9002, "", None, None, 0), (9002, "", None, None, 0), (9003, " \n\t\n", "en", "s", 4)]
    odd += [some[1], some[1], (some[2][0], "another text under an id that is taken already.", None, None, None), (9004, good, "en", "s", 1), (9005, good + " " + leaked, "en", "s", None), (9006, (good + "\n") * 300, None, None, None)]
    rows = spark.createDataFrame(some + odd, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = labels.select("doc_id", "quality", "toxic").unionByName(spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 7, 7), (2, 1, 1)], "doc_id long, quality int, toxic int").select(*[F.col(c).cast(labels.schema[c].dataType) for c in ("doc_id", "quality", "toxic")]))
    bench = items.select("item_id", "text").unionByName(spark.createDataFrame([(None, "an item without an id at all"), (900, None), (901, "")], "item_id long, text string").select(F.col("item_id").cast(items.schema["item_id"].dataType), "text"))
    sf = folder(spark, tmp_path / "odd", rows, marks, bench)
    raw, scored, lines, near, clean, tokens = stepped(spark, sf, tmp_path)

    stats = quality.statistics(rows)
    model = quality.train(stats, marks)
    sure = lambda r: model.score(np.array([quality.features((r["text"] or "").encode())]))[0] >= quality.THRESHOLD
    assert scored == [r for r in raw if sure(r)] and 0 < len(scored)
    assert sorted(((r["doc_id"], r["text"]) for r in lines), key=str) == kept_lines(scored)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    # One row of each component, of its smallest doc_id; components of different texts may share that id.
    comps = groups([(r["doc_id"], r["text"]) for r in lines])
    left, n = {int(f, 16) for _, f, _ in comps}, 0
    while left:
        n, queue = n + 1, [left.pop()]
        while queue:
            x = queue.pop()
            close = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= close
            queue += close
    assert len(near) == n < len(lines) and {r["doc_id"] for r in near} == {c for _, _, c in comps}
    assert all(r in lines for r in near)
    texts = [(r["doc_id"], r["text"]) for r in near]
    bad = {i for i, _ in leaks(texts, [(r["item_id"], r["text"]) for r in bench.collect() if r["item_id"] is not None])}
    assert clean == [r for i, r in enumerate(near) if i not in bad]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    want = []
    for r in clean:
        ids = sp.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert sorted((tuple(r.values()) for r in tokens), key=str) == sorted(want, key=str)


def test_empty_tables(spark, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    few = docs.select(*P.COLUMNS).limit(5)
    sf = folder(spark, tmp_path / "none", few.limit(0), labels.select("doc_id", "quality").limit(0), items.select("item_id", "text").limit(0))
    got = P.run(spark, sf)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == 0
    # Without labels both classes are alike, so every score is a half; without items nothing leaks.
    sf = folder(spark, tmp_path / "unlabelled", few, labels.select("doc_id", "quality").limit(0), items.select("item_id", "text").limit(0))
    assert 0 < P.run(spark, sf).count() <= 5
