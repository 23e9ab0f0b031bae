"""X axes, zoom, extents and reductions of drawn series. Input: live points unless said otherwise."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.catalog import SERIES, finite


def step_axis(points: DataFrame) -> DataFrame:
    return points.withColumn("x", F.col("step").cast("double"))


def wall_axis(points: DataFrame) -> DataFrame:
    return points.withColumn("x", F.col("wall"))


def relative_axis(flagged: DataFrame) -> DataFrame:
    """Seconds since the series' first live point; ghosts share that origin."""
    origin = F.min_by(F.when(F.col("is_live"), F.col("wall")), F.when(F.col("is_live"), F.col("seq"))).over(Window.partitionBy(*SERIES))
    return flagged.withColumn("x", F.col("wall") - origin)


def tokens_axis(points: DataFrame, counter: DataFrame) -> DataFrame:
    """Interpolating as-of join by step with the run's live counter (run, step, tokens).

    x is null where a point lies outside the counter's steps, a neighbour is not finite, or the run has no counter.
    """
    counted = counter.select("run", "step", finite(F.col("tokens")).alias("tokens"))
    tags = points.select(*SERIES).distinct()
    marks = counted.join(tags, "run").select(*SERIES, "step", F.lit(0).alias("k"), F.struct("step", "tokens").alias("mark"))
    both = points.withColumn("k", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy(*SERIES).orderBy("step", "k")
    before = F.last("mark", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("mark", True).over(order.rowsBetween(1, Window.unboundedFollowing))
    found = both.withColumns({"before": before, "after": after}).where("k = 1")
    a, b = F.col("before"), F.col("after")
    x = F.when(a["step"] == F.col("step"), a["tokens"]).otherwise(a["tokens"] + (b["tokens"] - a["tokens"]) * (F.col("step") - a["step"]) / (b["step"] - a["step"]))
    return found.withColumn("x", x).drop("k", "mark", "before", "after")


def zoom(drawn: DataFrame, low: float, high: float, log: bool = False) -> DataFrame:
    """Per series, the y range of the finite values, smoothed ones too, with x in [low, high]; none where it is a single value or, with ``log``, not positive."""
    v = finite(F.col("value"))
    s = finite(F.col("smoothed")) if "smoothed" in drawn.columns else F.lit(None).cast("double")
    rows = drawn.where(F.col("x").between(low, high)).groupBy(*SERIES).agg(F.min(F.least(v, s)).alias("y_min"), F.max(F.greatest(v, s)).alias("y_max"), F.count(v).alias("n"))
    return rows.where("y_min < y_max" + (" and y_min > 0" if log else ""))


def extent(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("tag").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))


def nearest(drawn: DataFrame, x: float) -> DataFrame:
    """Per series the point nearest to x; of two as near, the one with the smaller x."""
    return drawn.groupBy(*SERIES).agg(F.min_by(F.struct("x", "value"), F.struct(F.abs(F.col("x") - x), "x")).alias("p")).select(*SERIES, "p.x", "p.value")


def stepped(drawn: DataFrame, x: float | None, by: int) -> DataFrame:
    """Rows (run, tag, x): where a crosshair at x stands after a step of ``by`` points of the series, clamped to its ends; without x at the newest point."""
    placed = drawn.withColumns({"at": F.row_number().over(Window.partitionBy(*SERIES).orderBy("x", "seq")) - 1, "n": F.count("*").over(Window.partitionBy(*SERIES))})
    if x is None:
        return placed.where(F.col("at") == F.col("n") - 1).select(*SERIES, "x")
    before = F.sum(F.when(F.col("x") < x, 1).otherwise(0)).over(Window.partitionBy(*SERIES))
    goal = F.least(F.greatest(F.least(before, F.col("n") - 1) + by, F.lit(0)), F.col("n") - 1)
    return placed.withColumn("goal", goal).where("at = goal").select(*SERIES, "x")


def panned(window: tuple[float, float], x: float) -> tuple[float, float]:
    """The zoom window, moved as little as brings x into it."""
    low, high = window
    return (x, x + high - low) if x < low else (x - (high - low), x) if x > high else window


def log_y(drawn: DataFrame) -> DataFrame:
    """log10 of positive values; the rest are gaps."""
    return drawn.withColumn("log_value", F.when(finite(F.col("value")) > 0, F.log10(F.when(F.col("value") > 0, F.col("value")))))


def boundaries(flagged: DataFrame) -> DataFrame:
    """Distinct steps at which surviving segments begin."""
    first = flagged.where("is_live").groupBy(*SERIES, "segment").agg(F.min_by("step", "seq").alias("step")).where("segment > 0")
    return first.select("tag", "step").distinct()


def m4(drawn: DataFrame, columns: int) -> DataFrame:
    """First, last, least and greatest point per raster column of each series: draws the same pixels as all points."""
    span = Window.partitionBy(*SERIES)
    low, high = F.min("x").over(span), F.max("x").over(span)
    column = F.when(high > low, F.least(F.floor((F.col("x") - low) * columns / (high - low)), F.lit(columns - 1))).otherwise(0)
    v, order = finite(F.col("value")), F.struct("x", "seq")
    rows = drawn.withColumn("col", column.cast("int")).where(v.isNotNull())
    return rows.groupBy(*SERIES, "col").agg(F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.min("value").alias("min"), F.max("value").alias("max"))


def sparkline(points: DataFrame, last: int = 120, cells: int = 12) -> DataFrame:
    """Levels 0 to 7 of the last finite values in ``cells`` cells (maximum of each); flat series are level 3."""
    recent = Window.partitionBy(*SERIES).orderBy(F.col("seq").desc())
    rows = points.withColumn("back", F.row_number().over(recent)).where(F.col("back") <= last).where(finite(F.col("value")).isNotNull())
    order = Window.partitionBy(*SERIES).orderBy("seq")
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy(*SERIES))}).where("n >= 2")
    rows = rows.withColumn("cell", F.explode(F.filter(F.sequence(F.lit(0), F.lit(cells - 1)), lambda c: (F.col("i") >= F.floor(c * F.col("n") / cells)) & (F.col("i") < F.greatest(F.floor((c + 1) * F.col("n") / cells), F.floor(c * F.col("n") / cells) + 1)))))
    tall = rows.groupBy(*SERIES, "cell").agg(F.max("value").alias("v"))
    low, high = F.min("v").over(Window.partitionBy(*SERIES)), F.max("v").over(Window.partitionBy(*SERIES))
    return tall.select(*SERIES, "cell", F.when(high > low, F.round((F.col("v") - low) / (high - low) * 7)).otherwise(3).cast("int").alias("level"))


def ewma(points: DataFrame, factor: float) -> DataFrame:
    """Debiased exponential moving average of each series in order of ``seq``; a NaN does not advance it and comes back as null.

    Sorted partitions go by in batches: a task holds one batch and the state of one series, however long that is.
    """

    def smooth(batches):
        held = Average(factor)
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, tags = batch.column("run").to_pylist(), batch.column("tag").to_pylist()
            values = batch.column("value").to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *(k for k in range(1, len(runs)) if tags[k] != tags[k - 1] or runs[k] != runs[k - 1]), len(runs)]
            out = [held.follow((runs[a], tags[a]), values[a:b]) for a, b in itertools.pairwise(cuts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "tag", "seq")), pa.array(np.concatenate(out), from_pandas=True)], names=["run", "tag", "seq", "smoothed"])

    rows = points.select("run", "tag", "seq", "value").repartition(*SERIES).sortWithinPartitions(*SERIES, "seq")
    return rows.mapInArrow(smooth, "run string, tag string, seq long, smoothed double")


class Average:
    """The moving average of one series at a time, followed over its pieces."""

    def __init__(self, factor: float):
        self.factor, self.key, self.level, self.weight = factor, None, 0.0, 1.0
        # so many powers of the factor stay within the range of doubles
        self.block = min(1024, int(-200 / math.log10(factor))) if 0 < factor < 1 else 0

    def follow(self, key, values: np.ndarray) -> np.ndarray:
        if key != self.key:
            self.key, self.level, self.weight = key, 0.0, 1.0
        out, real = values.copy(), np.flatnonzero(~np.isnan(values))
        x = values[real]
        out[real] = self.long(x) if self.block > 8 and len(x) > 32 and np.isfinite(x).all() else self.short(x)
        return out

    def short(self, x: np.ndarray) -> list[float]:
        out, level, weight, factor = [], self.level, self.weight, self.factor
        for v in x.tolist():
            level, weight = factor * level + (1 - factor) * v, weight * factor
            out.append(level / (1 - weight) if weight != 1 else math.nan)
        self.level, self.weight = level, weight
        return out

    def long(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for a in range(0, len(x), self.block):
            part = x[a : a + self.block]
            powers = self.factor ** np.arange(1, len(part) + 1)
            level = powers * (self.level + np.cumsum((1 - self.factor) * part / powers))
            weight = self.weight * powers
            out[a : a + len(part)] = level / (1 - weight)
            self.level, self.weight = float(level[-1]), float(weight[-1])
        return out
