import os
import random
import time

import pytest
from pyspark.sql import functions as F

from stackloom.model import SampleCountMode
from stackloom.operators.resolve import resolve_samples
from stackloom.operators.tree import build_tree
from stackloom.sources.files import read_maps, read_samples
from stackloom.sources.formats import pack_map, pack_samples
from stackloom.streaming import runs
from stackloom.streaming.folder import FolderReader
from stackloom.streaming.online import OnlineAnalysis

LIB = [(0x7F0000001000, 0x7F0000002000, True, "lib1")]


def test_stream_equals_batch(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    told = []
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state", count_mode=SampleCountMode.Both)
    o.set_file_callback(lambda path, kind, new: told.append((path.rsplit("/", 1)[1], kind, new)))
    assert o.files_processed == 0 and o.tree.total_samples == 0
    (data / "rank_1.pflw").write_bytes(pack_samples([([0x7F0000001500, 0x7F0000001600], 5)]))
    o.start(None).awaitTermination(120)
    assert o.tree.nodes.where("library_name = 'lib1'").count() == 0
    (data / "rank_0.pflw").write_bytes(pack_samples([([0x7F0000001500], 2)]))
    (data / "rank_1.libmap").write_bytes(pack_map(LIB, 1))
    (data / "broken_rank_2.pflw").write_bytes(b"oops")
    o.start(None).awaitTermination(120)
    # The map came after its samples and counts all the same; the process count did not shrink.
    assert o.tree.nodes.where("library_name = 'lib1'").count() == 2 and o.tree.process_count == 2
    assert o.summary() == {"files": 4, "processes": 2, "samples": 7, "nodes": o.tree.node_count}
    assert ("rank_1.libmap", "library_map", True) in told and o.balance().first()["process_samples"] == [2, 5] and o.hotspots().count() > 0
    o.start(None).awaitTermination(120)
    assert o.tree.total_samples == 7
    o.stop()


def test_replace_mode(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state", replace=True)
    p = data / "rank_0.pflw"
    p.write_bytes(pack_samples([([1], 5)]))
    assert o.scan() == 1 and o.scan() == 0
    p.write_bytes(pack_samples([([1], 8)]))
    os.utime(p, (time.time() + 10, time.time() + 10))
    assert o.scan() == 1 and o.tree.total_samples == 8


def write(path, data, at):
    path.write_bytes(data)
    os.utime(path, (at, at))


def rows_of(tree):
    return sorted((r["depth"], str(r["path"]), r["raw_address"], r["total_samples"], r["self_samples"]) for r in tree.nodes.collect())


@pytest.mark.parametrize("order", ["leaf_first"])
def test_every_batch_equals_a_full_build(spark, tmp_path, monkeypatch, order):
    monkeypatch.setattr(runs, "FAN", 2)  # levels merge all the time
    data = tmp_path / "in"
    data.mkdir()
    r = random.Random(order)
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state", count_mode=SampleCountMode.Both, replace=True, frame_order=order)
    now = time.time() - 1_000
    for step in range(3):
        for p in r.sample(range(4), 2):
            stacks = [([0x7F0000001000 + r.randrange(3) * 0x400 for _ in range(r.randrange(1, 4))], r.randrange(1, 9)) for _ in range(r.randrange(6))]
            write(data / f"rank_{p}.pflw", pack_samples(stacks), now + step)
        if step:
            write(data / "rank_1.libmap", pack_map(LIB if step == 1 else [(0x7F0000001000, 0x7F0000001500, True, "other")], 1), now + step)
        assert o.scan() in (2, 3)
        samples, _ = read_samples(spark, str(data), glob="*.pflw")
        maps = read_maps(spark, str(data), glob="*.libmap") if step else spark.createDataFrame([], o.runs.schemas["maps"])
        whole = build_tree(resolve_samples(samples, maps, None, order), o.build_mode, o.count_mode)
        assert rows_of(o.tree) == rows_of(whole)
        assert sorted(map(tuple, o.samples.select("process_id", "entry_ord", "addrs", "count").collect())) == sorted(map(tuple, samples.select("process_id", "entry_ord", "addrs", "count").collect()))
        assert o.scan() == 0
    held = o.runs.manifest()
    assert held["last"] == 2 and len(held["runs"]["entries"]) <= 3 and len(os.listdir(tmp_path / "state" / "entries")) <= 6 and len(os.listdir(tmp_path / "state" / "manifest")) <= 4


def test_a_stop_before_the_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    data = tmp_path / "in"
    data.mkdir()
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state")
    (data / "rank_0.pflw").write_bytes(pack_samples([([1], 5)]))
    assert o.scan() == 1
    (data / "rank_1.pflw").write_bytes(pack_samples([([2], 7)]))
    real = runs.Runs._write
    monkeypatch.setattr(runs.Runs, "_write", lambda self, name, *a: (_ for _ in ()).throw(RuntimeError("stopped")) if name == "events" else real(self, name, *a))
    with pytest.raises(RuntimeError, match="stopped"):
        o.scan()
    monkeypatch.undo()
    again = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state")
    assert again.tree.total_samples == 5 and again.scan() == 1 and again.tree.total_samples == 12 and again.files_processed == 2


def test_streams_restart_from_the_checkpoint_and_take_few_files_at_a_time(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    now = time.time() - 100
    batches = []

    def watch(n):
        o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state", replace=True, max_files=2)
        o.set_batch_callback(lambda a, number: batches.append(a.events.where(F.col("batch_id") == number).count()))
        o.start("200 milliseconds")
        until = time.time() + 90
        while time.time() < until and o.tree.total_samples != n:
            assert o.query.exception() is None
            time.sleep(0.5)
        o.stop()
        assert o.tree.total_samples == n
        return o

    for i in range(5):
        write(data / f"rank_{i}.pflw", pack_samples([([i], 1)]), now + i)
    watch(5)
    assert sorted(batches) == [1, 2, 2]
    write(data / "rank_1.pflw", pack_samples([([1], 10), ([2], 1)]), now + 50)
    write(data / "rank_9.pflw", pack_samples([([9], 100)]), now - 50)  # turns up late
    o = watch(115)
    assert sum(batches) == 7 and o.files_processed == 6 and o.events.count() == 7


def test_metrics_are_observed_and_reported_if_they_change(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    (data / "rank_0.pflw").write_bytes(pack_samples([([1], 5), ([2], 2)]))
    (data / "rank_1.pflw").write_bytes(b"broken")
    told = []
    o = OnlineAnalysis(spark, str(data), f"file://{tmp_path}/state")
    o.set_report(told.append, 0.0)
    o.start("200 milliseconds")
    until = time.time() + 60
    while not told and time.time() < until:
        time.sleep(0.5)
    o.stop()
    assert list(o.metrics) == [{"batch_id": 0, "files": 2, "bad_files": 1, "samples": 7, "entries": 2}]
    assert told == [{"batches": 1, "files": 2, "bad_files": 1, "samples": 7}]
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in o.events.collect()} == {"rank_0.pflw": "Success", "rank_1.pflw": "FileRead"}


def test_offsets_stay_small_and_tell_late_files(tmp_path):
    for i in range(200):
        write(tmp_path / f"rank_{i}.pflw", b"x", 1_000_000 + i)
    reader = FolderReader({"path": str(tmp_path), "maxfilespertrigger": "150"})
    first, second = reader.latestOffset(), reader.latestOffset()
    assert len(str(second)) < 200 + len(str(tmp_path)) and second == reader.latestOffset() != first
    count = lambda a, b: sum(len(p.rows) for p in reader.partitions(a, b))
    assert count(reader.initialOffset(), first) == 150 and count(first, second) == 200  # versions within the lag come again
    write(tmp_path / "rank_late.pflw", b"y", 1_000_100)
    third = reader.latestOffset()
    assert third != second and (third["time"], third["path"]) == (second["time"], second["path"])
    again = FolderReader({"path": str(tmp_path), "maxfilespertrigger": "150"})
    assert "rank_late.pflw" in [x[1].rsplit("/", 1)[1] for p in again.partitions(second, third) for x in p.rows]
