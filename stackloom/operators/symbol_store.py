"""Answers of symbolizers kept from run to run.

The store is a folder of Parquet files that only grows. A row is one answer about one build of a library; that the tool knows
nothing of an offset is an answer too, that it failed is none. What a look-up lacks is found by an anti-join before any tool
runs, so a second run over the same stacks asks nothing. A library's build is the identity that its linker wrote, or else
the hash of its bytes; a rebuilt library is asked about anew, and goes back to old answers with the old build.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.model import UNKNOWN, UNRESOLVED
from stackloom.operators.resolve import symbolize
from stackloom.session import ready, written

ANSWERS = "library string, build string, offset long, function_name string, filename string, line_number int"
#: Fixed values of the ELF format: type of a segment of notes, and of the note with the build's identity.
PT_NOTE, NT_GNU_BUILD_ID = 4, 3


def build_identity(path: str) -> str:
    """The build of a library file: its linker's identity, the hash of its bytes without one, "" if it can't be read."""
    try:
        with open(path, "rb") as f:
            return _linked(f) or f"sha256:{hashlib.file_digest(f, 'sha256').hexdigest()}"
    except OSError:
        return ""


def _linked(f) -> str | None:
    """The identity in the notes of an ELF file; leaves the file at its start where there is none."""
    try:
        head = f.read(64)
        if head[:4] == b"\x7fELF":
            wide, order = head[4] == 2, "<" if head[5] == 1 else ">"
            (table,) = struct.unpack_from(f"{order}{'Q' if wide else 'I'}", head, 32 if wide else 28)
            size, count = struct.unpack_from(f"{order}HH", head, 54 if wide else 42)
            f.seek(table)
            segments = f.read(size * count)
            for i in range(count):
                kind, *fields = struct.unpack_from(f"{order}{'IIQQQQQQ' if wide else 'IIIIIIII'}", segments, i * size)
                at, length = (fields[1], fields[4]) if wide else (fields[0], fields[3])
                if kind == PT_NOTE:
                    f.seek(at)
                    if found := _note(f.read(min(length, 1 << 16)), order):
                        return found
    except struct.error:  # cut short: its bytes identify it
        pass
    f.seek(0)
    return None


def _note(notes: bytes, order: str) -> str | None:
    at = 0
    while at + 12 <= len(notes):
        name, desc, kind = struct.unpack_from(f"{order}III", notes, at)
        begin = at + 12 + (name + 3) // 4 * 4
        if kind == NT_GNU_BUILD_ID and notes[at + 12 : at + 16] == b"GNU\0" and desc and begin + desc <= len(notes):
            return f"gnu:{notes[begin : begin + desc].hex()}"
        at = begin + (desc + 3) // 4 * 4
    return None


def _builds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        libraries = b.column("library").to_pylist()
        yield pa.RecordBatch.from_pydict({"library": libraries, "build": [build_identity(x) for x in libraries]}, pa.schema([("library", pa.string()), ("build", pa.string())]))


class SymbolStore:
    """Answers below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = ready(spark), path.rstrip("/")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)

    @property
    def answers(self) -> DataFrame:
        """Every answer (ANSWERS) so far; function_name is null where the tool knew nothing. Two runs at once may add one twice."""
        return self.spark.read.schema(ANSWERS).parquet(self.path)

    def add(self, symbols: DataFrame) -> None:
        """Append answers; without a column build they count for libraries that can't be read where the executors run."""
        if "build" not in symbols.columns:
            symbols = symbols.withColumn("build", F.lit(""))
        symbols.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in ANSWERS.split(", "))]).where("library is not null and offset is not null").write.mode("append").parquet(self.path)

    def symbols(self, frames: DataFrame, tool: str | None = "addr2line") -> DataFrame:
        """Symbols (library, offset, function_name, filename, line_number) of frames (library_name, offset), one a pair.

        The tool is asked what the store lacks, and its answers are added; tool None asks nothing. Frames without a library,
        an offset or an answer give no row. Answers of a library that changed while the tool ran are not kept.
        """
        named = frames.where(F.col("library_name").isNotNull() & ~F.col("library_name").isin(UNKNOWN, UNRESOLVED) & F.col("offset").isNotNull())
        pairs = written(named.select(F.col("library_name").alias("library"), "offset").distinct(), "pairs")
        asked = written(pairs.join(self._builds(pairs), "library"), "asked")
        key = ["library", "build", "offset"]
        if tool is not None:
            lack = asked.join(self.answers, key, "left_anti").where("build <> ''")
            found = written(symbolize(lack.withColumnRenamed("library", "library_name"), tool, unknown=True), "answers")
            before, after = asked.select("library", "build").distinct(), self._builds(found)
            self.add(found.join(before.join(after, ["library", "build"]), "library"))
        hit = self.answers.join(asked, key, "left_semi").where("function_name is not null")
        return hit.groupBy("library", "offset").agg(F.min(F.struct("function_name", "filename", "line_number")).alias("s")).select("library", "offset", "s.*")

    def _builds(self, pairs: DataFrame) -> DataFrame:
        """(library, build), a row a library."""
        return pairs.select("library").distinct().mapInArrow(_builds, "library string, build string")
