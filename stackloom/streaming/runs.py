"""Tables that grow by batches, as runs of Parquet files that one manifest lists.

A batch adds one run to each table at level 0. When a level has FAN runs, they become one run of the next, so a row is
written again once a level, and their number grows with the logarithm of the batches. A reader follows the manifest
alone; it comes into place by one rename after the new runs are whole, and the runs that it no longer lists go after that. A stop
anywhere leaves the old state or the new one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Runs of a level that become one of the next.
FAN = 8


class Runs:
    """schemas: columns of each table; merge: how rows of several runs of a table become fewer (default: as they are)."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str], merge: dict[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.spark, self.path, self.schemas, self.merge = spark, path, schemas, merge
        self._jvm = spark.sparkContext._jvm

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @property
    def _fs(self):
        return self._at("manifest").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """number, last batch, and the runs (level, name) of each table."""
        fs, top = self._fs, self._at("manifest")
        names = sorted(s.getPath().getName() for s in fs.listStatus(top) if not s.getPath().getName().startswith("_")) if fs.exists(top) else []
        if not names:
            return {"number": 0, "last": -1, "runs": {name: [] for name in self.schemas}}
        stream = fs.open(self._at(f"manifest/{names[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, runs: list | None = None) -> DataFrame:
        """Rows of a table as its runs hold them."""
        runs = self.manifest()["runs"][name] if runs is None else runs
        if not runs:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(*[f"{self.path}/{name}/{run}" for _, run in runs])

    def _write(self, name: str, rows: DataFrame, level: int, batch: int, by: str | None) -> list:
        run = f"{level}-{batch}-{uuid.uuid4().hex[:8]}"
        (rows.sortWithinPartitions(by) if by else rows).write.option("compression", "zstd").parquet(f"{self.path}/{name}/{run}")
        return [level, run]

    def commit(self, batch: int, rows: dict[str, DataFrame], by: dict[str, str]) -> None:
        """Add a batch's rows to the tables, sorted by a column each; merge levels that are full."""
        old = self.manifest()
        runs = {name: list(x) for name, x in old["runs"].items()}
        for name, df in rows.items():
            runs[name].append(self._write(name, df, 0, batch, by.get(name)))
            level = 0
            while len(full := [r for r in runs[name] if r[0] == level]) >= FAN:
                whole = self.merge.get(name, lambda df: df)(self.table(name, full))
                runs[name] = [r for r in runs[name] if r[0] != level] + [self._write(name, whole, level + 1, batch, by.get(name))]
                level += 1
        new = {"number": old["number"] + 1, "last": batch, "runs": runs}
        fs, hidden = self._fs, self._at(f"manifest/_{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not fs.rename(hidden, self._at(f"manifest/{new['number']:010d}")):
            raise RuntimeError(f"another writer has committed to {self.path}")
        self._clean(new, old)

    def _clean(self, new: dict, old: dict) -> None:
        """Remove what neither this manifest nor the one before lists, so that readers of that one can end."""
        fs = self._fs
        for name in self.schemas:
            live = {run for m in (new, old) for _, run in m["runs"][name]}
            if fs.exists(self._at(name)):
                for s in fs.listStatus(self._at(name)):
                    if s.getPath().getName() not in live:
                        fs.delete(s.getPath(), True)
        for s in fs.listStatus(self._at("manifest")):
            found = s.getPath().getName()
            if found.startswith("_") or int(found) < old["number"]:
                fs.delete(s.getPath(), False)
