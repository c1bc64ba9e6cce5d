"""Numbers of rows among those of their group, however many rows one group has.

Rows are cut into ranges of the order (group, place), so that one large group spreads over many tasks. Each task numbers
its range by itself; what a range's first group has in earlier ranges follows from one row per range and is added after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.session import ready, written


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank and sum of the sizes ahead of every row in its group, within one sorted range."""
    part = TaskContext.get().partitionId()
    group, rank, ahead = None, 0, 0  # of the last row: its group, its rank there, sizes up to it
    for b in batches:
        if not b.num_rows:
            continue
        groups, size = b.column("group"), b.column("size").to_numpy(zero_copy_only=False)
        at = np.arange(b.num_rows)
        new = np.empty(b.num_rows, bool)
        new[0] = groups[0].as_py() != group
        new[1:] = pc.not_equal(groups.slice(1), groups.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        begin = np.maximum.accumulate(np.where(new, at, 0))
        before = np.cumsum(size) - size
        ranks, sums = at - begin + 1, before - before[begin]
        if not new[0]:  # the group of the last batch goes on
            same = slice(0, int(new.argmax()) if new.any() else None)
            ranks[same] += rank
            sums[same] += ahead
        group, rank, ahead = groups[-1].as_py(), int(ranks[-1]), int(sums[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([b.column("id"), groups, b.column("size"), pa.array(ranks), pa.array(sums), pa.array(np.full(b.num_rows, part, np.int32))], names=["id", "group", "size", "rank", "ahead", "part"])


def ranges(rows: DataFrame, place: list[Column]) -> DataFrame:
    """rows (id, group, size) with rank and ahead within their range, and the number of the range; written."""
    ready(rows.sparkSession)
    order = [F.col("group"), *place]
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "group", F.col("size").cast("long").alias("size"))
    return written(cut.mapInArrow(_number, "id string, group string, size long, rank long, ahead long, part int"), "ranges")


def numbered(rows: DataFrame, *place: Column) -> DataFrame:
    """(id, group, size, rank, ahead) of rows (id, group, size: no nulls) in the order of place within their group.

    rank counts from 1; ahead is the sum of the sizes of earlier rows of the group. Places of a group differ. An empty
    table gives none. The ranges are written once, so that both passes see the same cuts.
    """
    found = ranges(rows, list(place))
    ends = found.groupBy("part").agg(F.min("group").alias("head"), F.max(F.struct("group", "rank", (F.col("ahead") + F.col("size")).alias("sum"))).alias("tail"))
    # One row per range from here on. All ranges that end in one group are neighbours.
    so_far = Window.partitionBy("tail.group").orderBy("part")
    ends = ends.select("part", "head", "tail.group", F.sum("tail.rank").over(so_far).alias("n"), F.sum("tail.sum").over(so_far).alias("s"))
    last = [F.lag(c).over(Window.orderBy("part")).alias(f"last_{c}") for c in ("group", "n", "s")]
    carried = ends.select("part", "head", *last).where("last_group = head").select("part", F.col("head").alias("group"), "last_n", "last_s")
    whole = found.join(F.broadcast(carried), ["part", "group"], "left")
    more = lambda c, by: (F.col(c) + F.coalesce(F.col(by), F.lit(0))).alias(c)
    return whole.select("id", "group", "size", more("rank", "last_n"), more("ahead", "last_s"))
