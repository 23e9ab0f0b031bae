"""Live and ghost points of restarted series.

A restart at step s takes back every live point with a step of s or more. So a point is live if and only if no later
point has a step at or below its own (a suffix minimum), and a ghost belongs to the first later segment that starts at
or below its step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators import catalog
from runlens.operators.catalog import SERIES, linked


def with_live(points: DataFrame) -> DataFrame:
    """Points with segment and ``is_live``: no later point of the chunk, nor one of the chunks after it, is at or below."""
    after = Window.partitionBy(*SERIES, "chunk").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a frame that only grows
    least = F.least(F.min("step").over(after), F.col("later"))
    return linked(points).withColumn("is_live", least.isNull() | (least > F.col("step"))).drop("chunk", "later")


class Undone:
    """The restarts after some place of a series that no later one outdoes: steps descend with time, so the top is the next one."""

    def __init__(self):
        self.stack: list[tuple[int, int]] = []

    def before(self, start: int, last: int, segment: int | None) -> list[tuple[int, int]]:
        """Go back over points that ascend from ``start`` to ``last``: the (step, segment) of restarts that take some of them back. ``segment`` if they open one."""
        stack, found = self.stack, []
        while stack and stack[-1][0] > start:
            step, by = stack.pop()
            if step <= last:
                found.append((step, by))
        if stack:
            found.append(stack[-1])
        if segment is not None:  # what was popped above its start can't reach points before it either
            if stack and stack[-1][0] == start:
                stack.pop()
            stack.append((start, segment))
        return found


def taken_back(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, tag, chunk, segment, step, by) from parts of series that come from their end: restart ``by`` takes back the part's points from ``step`` on, up to the next such row."""
    key, undone, out = None, None, []

    def made() -> pa.RecordBatch:
        types = [pa.string(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[*SERIES, "chunk", "segment", "step", "by"])

    for batch in parts:
        for run, tag, chunk, segment, start, last, opens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (run, tag) != key:
                key, undone = (run, tag), Undone()
            out += [(run, tag, chunk, segment, step, by) for step, by in undone.before(start, last, segment if opens else None)]
        if out:
            yield made()
            out = []


def marked(parts: DataFrame) -> DataFrame:
    """What restarts take back of parts (run, tag, chunk, segment, start, last, opens) of series, as ``taken_back`` tells it."""
    ordered = parts.select(*SERIES, "chunk", "segment", "start", "last", "opens").repartition(*SERIES).sortWithinPartitions(*SERIES, F.col("chunk").desc(), F.col("segment").desc())
    return ordered.mapInArrow(taken_back, "run string, tag string, chunk long, segment long, step long, by long")


def ghosts(flagged: DataFrame) -> DataFrame:
    """The dead points with ``ghost_of``, the segment that took them back: the first later one that starts at or below their step.

    Points ascend within a segment. So a stack of later restarts that goes back over the parts of a series (a segment's
    points in a chunk, one row each) tells which step on each of them takes back: all parts get at most two rows each for
    all restarts of the series. A point finds its own among the rows of its part.
    """
    part = [*SERIES, "chunk", "segment"]
    rows = flagged.withColumn("chunk", F.shiftright("seq", catalog.CHUNK_BITS))
    parts = rows.groupBy(*part).agg(F.min("step").alias("start"), F.max("step").alias("last"), (F.max("restart") == 1).alias("opens"))
    marks = marked(parts)
    dead = rows.where(~F.col("is_live")).withColumn("k", F.lit(1))
    both = dead.unionByName(marks.withColumn("k", F.lit(0)), allowMissingColumns=True)
    by = F.last("by", True).over(Window.partitionBy(*part).orderBy("step", "k").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("ghost_of", by).where("k = 1").select(*flagged.columns, "ghost_of")


def cuts(flagged: DataFrame) -> DataFrame:
    """Per restart, the number of points that were live and stayed so at that moment: all before, less all taken back by then."""
    born = flagged.groupBy(*SERIES, "segment").agg(F.count("*").alias("born"), F.min_by("step", "seq").alias("start_step"))
    lost = ghosts(flagged).groupBy(*SERIES, F.col("ghost_of").alias("segment")).agg(F.count("*").alias("lost"))
    order = Window.partitionBy(*SERIES).orderBy("segment")
    before = F.sum("born").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gone = F.sum(F.coalesce("lost", F.lit(0))).over(order)
    return born.join(lost, [*SERIES, "segment"], "left").select(*SERIES, "segment", "start_step", (before - gone).alias("cut")).where("segment > 0")
