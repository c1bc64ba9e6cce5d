"""Tables of counted stacks: adding, replacing, looking up and erasing entries. A table has no capacity to run out of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_stacks(samples: DataFrame, keys: list[str] = ("process_id", "addrs"), count: Column | None = None) -> DataFrame:
    """Equal stacks added up: one row per key with count; each row counts one unless count says how many."""
    return samples.groupBy(*keys).agg(F.sum(F.lit(1) if count is None else count).cast("long").alias("count"))


def upsert(table: DataFrame, updates: DataFrame, keys: list[str] = ("process_id", "addrs"), order: str = "entry_ord") -> DataFrame:
    """table with the counts of updates in place of its own; of equal keys in updates the last by ``order`` counts."""
    u = updates.groupBy(*keys).agg(F.max_by("count", order).alias("count"))
    return table.join(u.select(*keys), list(keys), "left_anti").select(*keys, "count").unionByName(u)


def add(table: DataFrame, updates: DataFrame, keys: list[str] = ("process_id", "addrs")) -> DataFrame:
    """table with the counts of updates added."""
    both = table.select(*keys, "count").unionByName(updates.select(*keys, "count"))
    return count_stacks(both, keys, F.col("count"))


def find(table: DataFrame, stack: list[int]) -> DataFrame:
    """Entries of one stack, compared frame by frame."""
    return table.where(F.col("addrs") == F.array(*[F.lit(a).cast("long") for a in stack]))


def erase(table: DataFrame, gone: DataFrame, keys: list[str] = ("process_id", "addrs")) -> DataFrame:
    """table without the keys in gone."""
    return table.join(gone.select(*keys), list(keys), "left_anti")
