"""format("pflw"): filters, splits, repeated stacks, broken files, headers, and jobs that fail."""

import os
import random
import time

import pytest
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from stackloom.sources import datasource, files
from stackloom.sources.formats import SAMPLE_HEADER, find_boundary, pack_samples, parse_samples
from stackloom.sources.staging import Staging


@pytest.fixture(autouse=True)
def known(spark):
    datasource.register(spark)


def rows_of(df):
    return sorted((r["file"].rsplit("/", 1)[1], r["entry_ord"], r["addrs"], r["count"]) for r in df.collect())


def entries(r, n, top):
    """Entries whose addresses and counts look like depths and counts, when top is small."""
    return [([r.randrange(top) for _ in range(r.choice([0, 1, 2, 3, 7, 128]))], r.randrange(1, top)) for _ in range(n)]


@pytest.mark.parametrize("top", [3, 140, 1 << 47])
def test_parts_of_a_file_give_all_its_entries(spark, tmp_path, top):
    r = random.Random(top)
    want = []
    for name, n in (("a_rank_1", 3_000), ("b_rank_2", 1), ("c_rank_3", 0)):
        rows = entries(r, n, top)
        (tmp_path / f"{name}.pflw").write_bytes(pack_samples(rows))
        want += [(f"{name}.pflw", i, a, c) for i, (a, c) in enumerate(rows)]
    df = spark.read.format("pflw").option("duplicates", "all").option("splitBytes", "20000").load(str(tmp_path))
    assert df.rdd.getNumPartitions() > 10
    assert rows_of(files.number_entries(df)) == sorted(want)
    whole = spark.read.format("pflw").load(str(tmp_path))
    assert rows_of(whole) == rows_of(files.read_samples(spark, str(tmp_path), glob="*.pflw")[0]) == rows_of(files.last_entries(files.number_entries(df)))


def test_a_boundary_is_proven_or_not_claimed():
    r = random.Random(5)
    for top in (2, 3, 5, 200, 1 << 60):
        rows = entries(r, 300, top)
        body = pack_samples(rows)[SAMPLE_HEADER.size :]
        true, at = {0}, 0
        for a, _ in rows:
            at += 2 + len(a)
            true.add(at)
        found = [find_boundary(lambda w, n: body[8 * w : 8 * (w + n)], at, k) for k in range(0, at + 3, 7)]
        assert all(x is None or x in true for x in found) and sum(x is not None for x in found) > len(found) // 2
    same = pack_samples([([0, 0], 0)] * 400)[SAMPLE_HEADER.size :]  # every word may begin an entry: nothing is proven but the end
    assert find_boundary(lambda w, n: same[8 * w : 8 * (w + n)], 1_600, 7) in (None, 1_600)


def test_repeated_stacks_count_as_their_last_entry_says(spark, tmp_path):
    (tmp_path / "rank_0.pflw").write_bytes(pack_samples([([1, 2], 5), ([3], 1), ([1, 2], 8), ([], 2), ([2, 1], 4), ([], 3)]))
    load = lambda **o: rows_of(spark.read.format("pflw").options(**o).load(str(tmp_path)))
    assert load() == [("rank_0.pflw", 0, [1, 2], 8), ("rank_0.pflw", 1, [3], 1), ("rank_0.pflw", 3, [], 3), ("rank_0.pflw", 4, [2, 1], 4)]
    assert [x[3] for x in load(duplicates="all")] == [5, 1, 8, 2, 4, 3]
    assert [x[2] for x in load(frame_order="leaf_first")] == [[2, 1], [3], [], [1, 2]]


def test_broken_files_are_skipped_reported_or_fail(spark, tmp_path):
    good = pack_samples([([1, 2], 5), ([3], 1)])
    for name, data in {"good": good, "short": good[:-1], "magic": b"X" * 80, "newer": good[:4] + b"\x02\x00" + good[6:], "packed": good[:6] + b"\x01" + good[7:], "deep": pack_samples([(list(range(129)), 1)], max_depth=129), "none": b"", "huge": good[:72] + b"\xff" * 8 + good[80:]}.items():
        (tmp_path / f"{name}_rank_4.pflw").write_bytes(data)
    load = lambda mode: spark.read.format("pflw").option("badFiles", mode).load(str(tmp_path))
    assert load("skip").count() == 2 and {r[0] for r in load("skip").select("process_id").distinct().collect()} == {4}
    told = {r["file"].rsplit("/", 1)[1].split("_")[0]: r["status"] for r in load("report").collect()}
    assert told == {n: parse_samples((tmp_path / f"{n}_rank_4.pflw").read_bytes()).status.value for n in told} and len(told) == 8
    with pytest.raises(Exception, match="rank_4.pflw: "):
        load("fail").count()
    with pytest.raises(Exception, match="badFiles is"):
        load("ignore").count()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "rank_0.pflw").write_bytes(pack_samples([([7] * 100, 3)] * 400)[:-4])
    with pytest.raises(Exception, match="rank_0.pflw: FileRead"):
        spark.read.format("pflw").option("duplicates", "all").option("splitBytes", "20000").load(str(tmp_path / "cut")).count()


def counting(reader):
    """The reader, its opened files, and the bytes read of them."""
    opened, n = [], [0]
    real = reader._opened

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, k=None):
            data = self.f.read() if k is None else self.f.read(k)
            n[0] += len(data)
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    def opened_file(path):
        opened.append(os.path.basename(path))
        return Counted(real(path))

    reader._opened = opened_file
    return reader, opened, n


def test_filters_are_settled_by_names(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{'ab'[i % 2]}_rank_{i}.pflw").write_bytes(pack_samples([([i], i + 1)]))
    (tmp_path / "a_rank_7.pflw").write_bytes(b"broken")
    path = str(tmp_path)
    cases = [
        ([D.EqualTo(("process_id",), 3)], {3}), ([D.In(("process_id",), (1, 4, 9))], {1, 4}), ([D.GreaterThan(("process_id",), 2), D.LessThanOrEqual(("process_id",), 4)], {3, 4}), ([D.Not(D.LessThan(("process_id",), 5)), D.StringStartsWith(("file",), path + "/b")], {5}),
        ([D.StringContains(("file",), "b_rank")], {1, 3, 5}), ([D.IsNull(("file",))], set()), ([D.EqualTo(("file",), f"{path}/a_rank_2.pflw")], {2}), ([D.EqualNullSafe(("process_id",), None)], set()),
    ]
    for filters, want in cases:
        reader, opened, _ = counting(datasource.PushedSampleReader({"path": path, "badfiles": "fail"}, ".pflw"))
        assert list(reader.pushFilters([*filters, D.EqualTo(("count",), 1)])) == [D.EqualTo(("count",), 1)]
        got = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(1).to_pylist()]
        assert set(got) == want == {int(x.split("_")[2].split(".")[0]) for x in opened}
    few = files.entries_where(spark, path, F.expr("process_id in (1, 2) and file like '%/b%' and count > 1"), badFiles="fail")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert [r["process_id"] for r in few.collect()] == [1] and "BatchScan pflw" in plan


def test_filters_of_one_scan_leave_others_alone(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"rank_{i}.pflw").write_bytes(pack_samples([([i], i + 1)]))
    for df in (spark.read.format("pflw").load(str(tmp_path)).where("process_id < 4"), files.entries_where(spark, str(tmp_path), F.col("process_id") < 4)):
        assert [df.where("process_id = 1").count(), df.count(), df.where("process_id > 1").count()] == [1, 4, 2]
        one, others = (df.where(c).select("process_id") for c in ("process_id = 1", "process_id <> 1"))
        assert sorted(r[0] for r in one.unionAll(others).collect()) == [0, 1, 2, 3]
    pushed = files.entries_where(spark, str(tmp_path), F.col("process_id") < 4)
    assert "PushedFilters: [IsNotNull(process_id), IsNotNull(file), LessThan(process_id,4)]" in pushed._sc._jvm.PythonSQLUtils.explainString(pushed._jdf.queryExecution(), "formatted")


def test_headers_are_all_that_is_read(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"rank_{i}.pflw").write_bytes(pack_samples([([i] * 100, 1)] * 50))
    reader, opened, n = counting(datasource.HeaderReader({"path": str(tmp_path)}, ".pflw"))
    got = [row for p in reader.partitions() for row in reader.read(p)]
    assert len(got) == len(opened) == 300 and {r[3] for r in got} == {50} and n[0] == 300 * SAMPLE_HEADER.size
    assert spark.read.format("pflw").option("headerOnly", "true").load(str(tmp_path)).where(F.col("file").contains("rank_7")).count() == 11


def test_killed_tasks_leave_nothing(spark, tmp_path):
    def slow(batches):
        for b in batches:
            if b.column(0)[0].as_py() == 0:
                time.sleep(1)
                raise ValueError("no")
            for _ in range(40):
                time.sleep(0.1)
                yield b

    df = spark.range(0, 400, 1, 8).selectExpr("id process_id", "array(id) addrs", "1L count").mapInArrow(slow, "process_id long, addrs array<long>, count long")
    with pytest.raises(Exception, match="no"):
        df.write.format("pflw").mode("append").save(str(tmp_path / "out"))
    until = time.time() + 30
    while time.time() < until and spark.sparkContext.statusTracker().getActiveStageIds():
        time.sleep(0.2)
    time.sleep(5)
    assert os.listdir(tmp_path / "out") == []


def test_ended_jobs_take_no_more_tasks(tmp_path, monkeypatch):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("C", (), {"taskAttemptId": lambda self: 5})()))
    job, other = Staging(str(tmp_path / "out")), Staging(str(tmp_path / "out"))
    folder = job.task_folder()
    with open(f"{folder}/x.pflw", "wb") as f:
        f.write(b"1")
    job.discard()
    with pytest.raises(OSError):
        job.task_folder()
    with open(f"{other.task_folder()}/y.pflw", "wb") as f:
        f.write(b"2")
    other.publish([f"{tmp_path}/out/_temporary/{other.job}/5/y.pflw"])
    assert os.listdir(tmp_path / "out") == ["y.pflw"]
