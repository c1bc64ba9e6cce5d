"""spark.readStream.format("rundir"): the files of a folder as they come and change.

Rows are (path, modificationTime, length), one for each version of a file; contents are read by whoever wants them. An
offset is the place of the last file in the order of (time, path) and a checksum of the files of the last `lag`
seconds before it, however many files there are: a file that turns up late, with a time within the lag, changes the
checksum, and the next batch holds that stretch again. So a version comes at least once; a batch may repeat versions
that came before, within the lag or after a restart, which the taker drops by what it has stored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from stackloom.sources.staging import store_of

#: Seconds by which a file may turn up after others with later times; files that a task lists.
LAG, TASK_FILES = 600, 1_000


def list_versions(path: str, pattern: str = r".*\.(pflw|libmap)") -> list[tuple[int, str, int]]:
    """(milliseconds, path, bytes) of the files below a folder, in order; hidden ones are passed over."""
    from pyarrow import fs

    store, inner, prefix = store_of(path)
    prefix = prefix or "file:"
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p.removeprefix(inner).split("/"))
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns // 1_000_000, prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and re.fullmatch(pattern, f.base_name) and not hidden(f.path))


@dataclass
class _Versions(InputPartition):
    rows: list[tuple[int, str, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.lag = options["path"], 1_000 * int(options.get("lag", LAG))
        self.most = int(options.get("maxfilespertrigger", 0))
        self.place = (0, "")

    def initialOffset(self) -> dict:
        return {"time": 0, "path": "", "seen": 0}

    def latestOffset(self) -> dict:
        files = list_versions(self.path)
        fresh = [f for f in files if f[:2] > self.place]
        end = fresh[min(self.most or len(fresh), len(fresh)) - 1][:2] if fresh else self.place
        self.place = max(self.place, end)
        seen = 0
        for time, name, size in files:
            if self.place[0] - self.lag < time and (time, name) <= self.place:
                seen ^= zlib.crc32(f"{time} {size} {name}".encode())
        return {"time": self.place[0], "path": self.place[1], "seen": seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        last = end["time"], end["path"]
        self.place = max(self.place, last, (start["time"], start["path"]))
        rows = [f for f in list_versions(self.path) if f[0] > start["time"] - self.lag and f[:2] <= last]
        return [_Versions(rows[i : i + TASK_FILES]) for i in range(0, len(rows), TASK_FILES)]

    def read(self, partition: _Versions):
        for time, name, size in partition.rows:
            yield name, datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=time), size

    def commit(self, end: dict) -> None:
        self.place = max(self.place, (end["time"], end["path"]))


class FolderSource(DataSource):
    """Options: lag (seconds), maxFilesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "rundir"

    def schema(self) -> str:
        return "path string, modificationTime timestamp, length long"

    def streamReader(self, schema):
        return FolderReader({k.lower(): v for k, v in dict(self.options).items()})
