"""Enumerations and table schemas that everything else shares."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class TreeBuildMode(Enum):
    """What tells siblings apart: function and library, or the offset as well."""

    ContextFree = "context_free"
    ContextAware = "context_aware"


class SampleCountMode(Enum):
    """Which samples a node counts: those that end in it, those that pass through it, or both."""

    Exclusive = "exclusive"
    Inclusive = "inclusive"
    Both = "both"


class ConcurrencyModel(Enum):
    """Accepted for compatibility; Spark's tasks give the parallelism, and totals are the same for all."""

    Serial = "serial"
    FineGrainedLock = "fine_grained_lock"
    ThreadLocalMerge = "thread_local_merge"
    LockFree = "lock_free"


class ResolveStrategy(Enum):
    """How symbols are looked up; loading libraries into the analyser is never done."""

    TableOnly = "table_only"
    Addr2LineOnly = "addr2line_only"
    AutoFallback = "auto_fallback"


class ColorScheme(Enum):
    Grayscale = "grayscale"
    Heatmap = "heatmap"
    Rainbow = "rainbow"


class FileType(Enum):
    Unknown = "unknown"
    SampleData = "sample_data"
    LibraryMap = "library_map"
    PerformanceTree = "performance_tree"
    Text = "text"


class FileStatus(Enum):
    """Outcome of reading a file."""

    Success = "Success"
    FileOpen = "FileOpen"
    FileRead = "FileRead"
    InvalidFormat = "InvalidFormat"
    VersionMismatch = "VersionMismatch"
    Compression = "Compression"
    Integrity = "Integrity"


UNKNOWN, UNRESOLVED, ANONYMOUS = "[unknown]", "[unresolved]", "[anonymous]"
ROOT, VIRTUAL = "[root]", "[virtual]"
#: Deepest stack that a sample file may hold.
MAX_DEPTH = 128
#: Microseconds that one sample stands for.
TIME_PER_SAMPLE = 1000.0

FRAME = T.StructType(
    [
        T.StructField("raw_address", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("library_name", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
    ]
)
SAMPLES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("process_id", T.LongType()),
        T.StructField("entry_ord", T.LongType()),
        T.StructField("addrs", T.ArrayType(T.LongType())),
        T.StructField("count", T.LongType()),
    ]
)
LIB_MAP = T.StructType(
    [
        T.StructField("process_id", T.LongType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("base", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("executable", T.BooleanType()),
        T.StructField("name", T.StringType()),
    ]
)
SYMBOLS = T.StructType(
    [
        T.StructField("library", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("line_number", T.IntegerType()),
    ]
)
STACKS = T.StructType(
    [
        T.StructField("process_id", T.LongType()),
        T.StructField("entry_ord", T.LongType()),
        T.StructField("frames", T.ArrayType(FRAME)),
        T.StructField("count", T.LongType()),
        T.StructField("time_us", T.DoubleType()),
    ]
)
