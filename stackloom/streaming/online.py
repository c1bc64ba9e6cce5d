"""Analysis of a folder that is still receiving files, by Structured Streaming.

format("rundir") tells which files have come or changed; a batch decodes them, resolves their addresses once and adds
signed entries (process, stack, count) to tables of runs: positive ones for what came, negative ones for what it
replaces. Runs merge by levels, where opposite entries cancel, so the work of a batch follows the batch, and tree,
hotspots and balance follow the entries that are left. By default each path is read once. In replace mode a rewritten file
(another time or length) takes the place of what the same rank reported before, unless that was later. A library map may
come after its samples: it takes back the entries of its process and adds them as it resolves them. The number of
processes never shrinks. Batches may be delivered again or repeat versions of files: the tables know what they hold.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from stackloom.functions.callstack import root_first
from stackloom.model import FRAME, SAMPLES, TIME_PER_SAMPLE, FileStatus, FileType, SampleCountMode, TreeBuildMode
from stackloom.operators import analysis
from stackloom.operators.resolve import latest_maps, resolve_samples
from stackloom.operators.tree import Tree, build_tree
from stackloom.session import ready
from stackloom.sources.files import decode_maps, decode_samples, file_type, list_files, map_rank_of, rank_of, samples_of, status_of
from stackloom.streaming.folder import FolderSource
from stackloom.streaming.runs import Runs

_FRAMES = f"array<{FRAME.simpleString()}>"
_SCHEMAS = {
    "entries": f"process_id long, file string, modified timestamp, entry_ord long, frames {_FRAMES}, count long",
    "maps": "process_id long, ord int, base long, end long, executable boolean, name string, loaded long",
    "events": "path string, file_type string, modified timestamp, length long, batch_id long, process_id long, status string",
}
_KEY = ("process_id", "file", "modified", "entry_ord", "frames")
#: Bits of the order of entries that number those of a file; the upper ones number the files of a process.
ORDER_BITS = 40


def _net(entries: DataFrame) -> DataFrame:
    """Entries with opposite ones cancelled."""
    return entries.groupBy(*_KEY).agg(F.sum("count").alias("count")).where("count <> 0")


def _placed(files: DataFrame, *order: str) -> DataFrame:
    """Files of a process, numbered: one row for each file, whatever it holds."""
    return files.withColumn("at", F.row_number().over(Window.partitionBy("process_id").orderBy(*order)).cast("long") - 1)


class Reporter(StreamingQueryListener):
    """Tells the totals of a running analysis as its stream makes progress or idles."""

    def __init__(self, analysis: OnlineAnalysis, callback: Callable[[dict], None], seconds: float) -> None:
        self.analysis, self.callback, self.seconds = analysis, callback, seconds
        self.told, self.at, self.total, self.counted = None, -seconds, dict.fromkeys(("batches", "files", "bad_files", "samples"), 0), -1

    def tell(self, now: bool = False) -> None:
        for m in [m for m in list(self.analysis.metrics) if m["batch_id"] > self.counted]:
            self.counted = m["batch_id"]
            self.total = {k: n + (1 if k == "batches" else m[k]) for k, n in self.total.items()}
        if self.total != self.told and (now or time.monotonic() - self.at >= self.seconds):
            self.told, self.at = self.total, time.monotonic()
            self.callback(dict(self.total))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.tell()

    def onQueryIdle(self, event) -> None:
        self.tell()

    def onQueryTerminated(self, event) -> None:
        self.tell(now=True)


class OnlineAnalysis:
    """Watches a folder; results are DataFrames over all files seen so far."""

    def __init__(self, spark: SparkSession, folder: str, state: str, build_mode: TreeBuildMode = TreeBuildMode.ContextFree, count_mode: SampleCountMode = SampleCountMode.Exclusive, frame_order: str = "root_first", replace: bool = False, time_per_sample: float = TIME_PER_SAMPLE, max_files: int = 0) -> None:
        self.spark, self.folder, self.state = ready(spark), folder, state.rstrip("/")
        self.build_mode, self.count_mode, self.frame_order = build_mode, count_mode, frame_order
        self.replace, self.time_per_sample, self.max_files = replace, time_per_sample, max_files
        self.runs = Runs(spark, self.state, _SCHEMAS, {"entries": _net})
        self._callback: Callable[[str, str, bool], None] | None = None
        self._on_batch: Callable[[OnlineAnalysis, int], None] | None = None
        self.query = None
        #: What the last batches brought: batch_id, files, bad_files, samples (less those replaced), entries written.
        self.metrics: deque[dict] = deque(maxlen=1_000)
        self._reporter: Reporter | None = None

    def set_report(self, callback: Callable[[dict], None] | None, seconds: float = 10.0) -> None:
        """callback(totals of metrics so far) while a stream runs: every so many seconds at most, and if they changed."""
        self._reporter = callback and Reporter(self, callback, seconds)

    def set_file_callback(self, callback: Callable[[str, str, bool], None] | None) -> None:
        """callback(path, file type, is new) for each file of a batch, after the batch is stored."""
        self._callback = callback

    def set_batch_callback(self, callback: Callable[[OnlineAnalysis, int], None] | None) -> None:
        """callback(self, batch number) after each batch that brought files: summaries, exports."""
        self._on_batch = callback

    def start(self, interval: str | None = "1 second"):
        """Begin to watch; interval None takes all that is there and ends. max_files bounds a batch of a watch."""
        self.spark.dataSource.register(FolderSource)
        if self._reporter:
            self.spark.streams.addListener(self._reporter)
        reader = self.spark.readStream.format("rundir")
        if interval and self.max_files:
            reader = reader.option("maxFilesPerTrigger", self.max_files)
        writer = reader.load(self.folder).writeStream.foreachBatch(lambda batch, _: self.handle(batch)).option("checkpointLocation", f"{self.state}/checkpoint")
        self.query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        return self.query

    def stop(self) -> None:
        if self.query:
            self.query.stop()
            self.query = None
        if self._reporter:
            self.spark.streams.removeListener(self._reporter)
            self._reporter.tell(now=True)

    def scan(self) -> int:
        """One pass without a stream over files that are new, or in replace mode changed; also such as came with old times."""
        return self.handle(list_files(self.spark, self.folder).select("path", F.col("modified").alias("modificationTime"), "length"))

    def handle(self, batch: DataFrame) -> int:
        """Store what is new of a batch (path, modificationTime, length); the number of files taken."""
        state = self.runs.manifest()
        number = state["last"] + 1
        kinds = (FileType.SampleData.value, FileType.LibraryMap.value)
        events = self.runs.table("events", state["runs"]["events"])
        listed = batch.select("path", file_type(F.col("path")).alias("file_type"), F.date_trunc("millisecond", "modificationTime").alias("modified"), "length").where(F.col("file_type").isin(*kinds)).dropDuplicates(["path", "modified", "length"])
        known = events.select("path", F.lit(True).alias("old")).distinct()
        same = ["path", "modified", "length"] if self.replace else ["path"]
        fresh = listed.join(events.select(*same), same, "left_anti").join(known, "path", "left").withColumn("is_new", F.col("old").isNull()).drop("old")
        fresh = fresh.persist()
        taken = dict(map(tuple, fresh.groupBy("file_type").agg(F.count("*")).collect()))
        if not taken:
            fresh.unpersist()
            return 0
        kind = lambda t: fresh.where(F.col("file_type") == t.value).select("path").repartition(min(1_000, taken.get(t.value, 1)))  # noqa: E731  # a task a file
        decoded = decode_samples(kind(FileType.SampleData)).persist()
        times = fresh.select(F.col("path").alias("file"), "modified")
        samples = samples_of(decoded).join(times, "file")
        rank = map_rank_of(F.col("file"))["rank"]
        mapped_files = decode_maps(kind(FileType.LibraryMap)).persist()
        maps = mapped_files.where("ord is not null").select(F.when(rank >= 0, rank).otherwise(F.col("header_process_id")).alias("process_id"), "ord", "base", "end", "executable", "name", F.lit(number).cast("long").alias("loaded"))
        gone = mapped = latest = None  # processes that report anew, and that are resolved anew
        if self.replace and kinds[0] in taken:
            good = status_of(decoded).where(F.col("status") == FileStatus.Success.value).select("file", rank_of(F.col("file")).alias("process_id")).join(times, "file")
            # The latest version of each rank, unless what it reported before is later still.
            latest = good.groupBy("process_id").agg(F.max(F.struct("modified", "file")).alias("m")).select("process_id", "m.modified", "m.file")
            before = events.where(F.col("file_type") == kinds[0]).join(latest.select("process_id"), "process_id", "left_semi").groupBy("process_id").agg(F.max("modified").alias("until"))
            latest = latest.join(before, "process_id", "left").where("until is null or modified >= until").drop("until").persist()
            samples = samples.join(latest, ["process_id", "modified", "file"], "left_semi")
            gone = latest.select("process_id")
        raw = samples.select("process_id", "file", "modified", "entry_ord", root_first(F.col("addrs"), self.frame_order).alias("addrs"), "count")
        had, known_maps = self.runs.table("entries", state["runs"]["entries"]), self.runs.table("maps", state["runs"]["maps"])
        if kinds[1] in taken:
            mapped, known_maps = maps.select("process_id").distinct(), known_maps.unionByName(maps)
        touched = [x for x in (gone, mapped) if x is not None]
        old = None
        if touched and state["runs"]["entries"]:
            all_ = touched[0] if len(touched) == 1 else touched[0].unionByName(touched[1])
            old = _net(had.join(all_, "process_id", "left_semi")).persist()
            again = old if gone is None else old.join(gone, "process_id", "left_anti")
            raw = raw.unionByName(again.select("process_id", "file", "modified", "entry_ord", F.transform("frames", lambda f: f["raw_address"]).alias("addrs"), "count"))
        entries = self._resolved(raw, latest_maps(known_maps).drop("loaded"))
        if old is not None:
            entries = entries.unionByName(old.withColumn("count", -F.col("count")))
        statuses = status_of(decoded).select(F.col("file").alias("path"), "status").unionByName(mapped_files.where("ord is null").select(F.col("file").alias("path"), "status"))
        info = fresh.join(statuses, "path", "left").select("path", "file_type", "modified", "length", F.lit(number).cast("long").alias("batch_id"), rank_of(F.col("path")).alias("process_id"), F.coalesce("status", F.lit(FileStatus.FileOpen.value)).alias("status"))
        of_files, of_entries = Observation(), Observation()
        info = info.observe(of_files, F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") != FileStatus.Success.value).alias("bad_files"))
        entries = entries.observe(of_entries, F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("samples"), F.count(F.lit(1)).alias("entries"))
        told = [tuple(r) for r in fresh.select("path", "file_type", "is_new").toLocalIterator()] if self._callback else []
        self.runs.commit(number, {"entries": entries, "events": info} | ({"maps": maps} if mapped is not None else {}), {"entries": "process_id", "maps": "process_id"})
        seen = of_files.get | of_entries.get
        self.metrics.append({"batch_id": number} | {k: int(seen.get(k) or 0) for k in ("files", "bad_files", "samples", "entries")})
        for df in (decoded, mapped_files, fresh, *(x for x in (latest, old) if x is not None)):
            df.unpersist()
        for path, what, new in told:
            self._callback(path, what, new)
        if self._on_batch:
            self._on_batch(self, number)
        return sum(taken.values())

    def _resolved(self, raw: DataFrame, maps: DataFrame) -> DataFrame:
        """Entries with frames, of rows (process_id, file, modified, entry_ord, addrs, count)."""
        found = resolve_samples(raw, maps, None, "root_first", self.time_per_sample, ("process_id", "file", "modified", "entry_ord"))
        return found.select("process_id", "file", "modified", "entry_ord", F.col("frames").cast(_FRAMES).alias("frames"), "count")

    @property
    def events(self) -> DataFrame:
        """Versions of files taken so far: path, file_type, modified, length, batch_id, process_id."""
        return self.runs.table("events")

    @property
    def _live(self) -> DataFrame:
        return _net(self.runs.table("entries"))

    @property
    def samples(self) -> DataFrame:
        addrs = F.transform("frames", lambda f: f["raw_address"])
        return self._live.withColumn("addrs", F.reverse(addrs) if self.frame_order == "leaf_first" else addrs).select(*SAMPLES.fieldNames())

    @property
    def tree(self) -> Tree:
        live = self._live
        place = _placed(live.select("process_id", "file").distinct(), "file")
        stacks = live.join(place, ["process_id", "file"]).select("process_id", (F.shiftleft("at", ORDER_BITS) + F.col("entry_ord")).alias("entry_ord"), "frames", "count", (F.col("count") * F.lit(float(self.time_per_sample))).alias("time_us"))
        return build_tree(stacks, self.build_mode, self.count_mode)

    @property
    def files_processed(self) -> int:
        return self.events.select("path").distinct().count()

    def hotspots(self, top_n: int = 10) -> DataFrame:
        return analysis.find_hotspots(self.tree, top_n)

    def balance(self) -> DataFrame:
        return analysis.balance(self.tree)

    def summary(self) -> dict:
        """Numbers for a periodic report."""
        tree = self.tree
        return {"files": self.files_processed, "processes": tree.process_count, "samples": tree.total_samples, "nodes": tree.node_count}
