"""From points to segments, series and runs.

Points are rows (run, tag, seq, step, wall, value); ``seq`` is the order of arrival within a series. A point whose step
does not exceed the step before it restarts the series and opens a segment.

No task holds a series: it is scanned in chunks, the points of 2 ** CHUNK_BITS successive places, each of which is summed up
for itself. A chunk's summary (its first, last and least step, its restarts, its moments) is what the scan over the chunks of
a series carries on: one row for at most 65,536 places, so that a single series of all points spreads over all tasks. Points
are shuffled once, by (run, tag, chunk), and where the carry comes back to them they stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("run", "tag")
#: Places of ``seq`` that one chunk spans, as a power of two.
CHUNK_BITS = 16
#: Conventional names of a token counter, in order of preference.
COUNTERS = ("tokens", "consumed_tokens", "total_tokens", "num_tokens", "tokens_seen")


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def in_chunks(points: DataFrame) -> DataFrame:
    """Points with ``chunk`` and ``restart`` (0 or 1; null for the first point of a chunk, which only the chunk before can tell)."""
    order = Window.partitionBy(*SERIES, "chunk").orderBy("seq")
    rows = points.withColumn("chunk", F.shiftright("seq", CHUNK_BITS))
    return rows.withColumn("restart", (F.col("step") <= F.lag("step").over(order)).cast("int"))


def carried(points: DataFrame) -> DataFrame:
    """Rows (run, tag, chunk, joint, before, later): whether the chunk begins with a restart, the restarts of the chunks before, the least step of the chunks after it."""
    rows = in_chunks(points).groupBy(*SERIES, "chunk").agg(F.min_by("step", "seq").alias("first"), F.max_by("step", "seq").alias("last"), F.min("step").alias("least"), F.coalesce(F.sum("restart"), F.lit(0)).alias("restarts"))
    order = Window.partitionBy(*SERIES).orderBy("chunk")
    rows = rows.withColumn("joint", F.coalesce((F.col("first") <= F.lag("last").over(order)).cast("int"), F.lit(0)))
    before = F.coalesce(F.sum(F.col("restarts") + F.col("joint")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return rows.select(*SERIES, "chunk", "joint", before.alias("before"), F.min("least").over(Window.partitionBy(*SERIES).orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))


def linked(points: DataFrame) -> DataFrame:
    """Points with ``restart`` (0 or 1), ``segment``, ``chunk`` and ``later``, the least step of later chunks."""
    order = Window.partitionBy(*SERIES, "chunk").orderBy("seq")
    rows = in_chunks(points).join(carried(points), [*SERIES, "chunk"])
    rows = rows.withColumn("restart", F.coalesce("restart", "joint"))
    return rows.withColumn("segment", F.col("before") + F.sum("restart").over(order)).select(*points.columns, "restart", "segment", "chunk", "later")


def segmented(points: DataFrame) -> DataFrame:
    """Points with ``restart`` (0 or 1) and ``segment``, from 0."""
    return linked(points).drop("chunk", "later")


def moments(value: Column) -> list[Column]:
    """count, mean and sum of squared deviations of finite values: mergeable."""
    n = F.count(value)
    return [n.alias("n_finite"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2")]


def pooled(parts: DataFrame, *keys: str) -> DataFrame:
    """Rows with (n_finite, mean, m2) get ``pooled``, the mean of all rows of the key, and ``apart``, what m2 gains by it."""
    whole = Window.partitionBy(*keys)
    n = F.when(F.col("n_finite") > 0, F.col("n_finite"))
    rows = parts.withColumn("pooled", F.when(F.count("*").over(whole) == 1, F.col("mean")).otherwise(F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)))
    return rows.withColumn("apart", F.coalesce(n * (F.col("mean") - F.col("pooled")) * (F.col("mean") - F.col("pooled")), F.lit(0.0)) + F.coalesce("m2", F.lit(0.0)))


def summed(value: Column) -> list[Column]:
    """The aggregates of one part of a series."""
    point = F.struct("seq", "step", "wall", "value")
    return [F.min_by(point, "seq").alias("first"), F.max_by(point, "seq").alias("last"), F.count("*").alias("count"), (F.count("*") - F.count(value)).alias("non_finite"), F.min(value).alias("min"), F.max(value).alias("max"), *moments(value)]


def resummed(place: Column | None = None) -> list[Column]:
    """The aggregates of parts that ``pooled`` has seen, as if of their points; ``place`` orders them if ``seq`` doesn't."""
    first, last = ("first.seq", "last.seq") if place is None else (place, place)
    return [F.min_by("first", first).alias("first"), F.max_by("last", last).alias("last"), F.sum("count").alias("count"), F.sum("non_finite").alias("non_finite"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("n_finite").alias("n_finite"), F.first("pooled").alias("mean"), F.when(F.sum("n_finite") > 0, F.sum("apart")).alias("m2")]


def segments(points: DataFrame) -> DataFrame:
    """One row per (run, tag, segment)."""
    inner = Window.partitionBy(*SERIES, "chunk").orderBy("seq")
    rows = in_chunks(points).withColumn("part", F.coalesce(F.sum("restart").over(inner), F.lit(0).cast("long")))
    parts = rows.groupBy(*SERIES, "chunk", "part").agg(*summed(finite(F.col("value"))))
    order = Window.partitionBy(*SERIES).orderBy("chunk", "part")
    opens = F.when(F.col("part") > 0, 1).otherwise(F.coalesce((F.col("first.step") <= F.lag("last.step").over(order)).cast("int"), F.lit(0)))
    parts = parts.withColumn("opens", opens).withColumn("segment", F.sum("opens").over(order))
    made = pooled(parts, *SERIES, "segment").groupBy(*SERIES, "segment").agg(*resummed())
    return made.withColumn("preempted_at", F.lead("first.step").over(Window.partitionBy(*SERIES).orderBy("segment")))


def merged_moments(parts: DataFrame, *keys: str) -> DataFrame:
    """Merge (n_finite, mean, m2) rows by key: pooled mean, and squared deviations within and between parts."""
    own = parts.select(*keys, F.col("n_finite").alias("n"), F.coalesce("mean", F.lit(0.0)).alias("own"), F.coalesce("m2", F.lit(0.0)).alias("within"))
    pooled = own.groupBy(*keys).agg(F.sum("n").alias("n_finite"), (F.sum(F.col("n") * F.col("own")) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("mean"))
    apart = F.when(F.col("n") > 0, F.col("n") * (F.col("own") - F.col("mean")) * (F.col("own") - F.col("mean"))).otherwise(0.0)
    return own.join(pooled, list(keys)).groupBy(*keys).agg(F.first("n_finite").alias("n_finite"), F.first("mean").alias("mean"), F.sum(F.col("within") + apart).alias("m2"))


def series(points: DataFrame, *firsts: str) -> DataFrame:
    """One row per series, exact over all points as written, restarts included; of the columns ``firsts`` the first value that is not null."""
    walled = F.when(F.col("wall") != 0, F.col("wall"))
    kept = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in firsts]
    parts = in_chunks(points).groupBy(*SERIES, "chunk").agg(*summed(finite(F.col("value"))), F.coalesce(F.sum("restart"), F.lit(0).cast("long")).alias("restarts"), F.min(walled).alias("first_wall"), F.max(walled).alias("last_wall"), *kept)
    return series_of_parts(parts, F.col("chunk"), *firsts)


def series_of_parts(parts: DataFrame, place: Column, *firsts: str) -> DataFrame:
    """Series from summaries of their parts in order of ``place``, with the ``restarts`` inside each."""
    order = Window.partitionBy(*SERIES).orderBy(place)
    joint = F.coalesce((F.col("first.step") <= F.lag("last.step").over(order)).cast("int"), F.lit(0))
    made = pooled(parts.withColumn("restarts", F.col("restarts") + joint), *SERIES).groupBy(*SERIES).agg(*resummed(place), (F.sum("restarts") + 1).alias("segments"), F.min("first_wall").alias("first_wall"), F.max("last_wall").alias("last_wall"), *(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in firsts))
    point = [F.struct(*(F.col(f"{c}.{x}").alias(x) for x in ("step", "wall", "value"))).alias(c) for c in ("first", "last")]
    return made.select(*SERIES, "count", "non_finite", "min", "max", "mean", (F.col("m2") / F.col("n_finite")).alias("variance"), *point, "segments", (F.col("segments") > 1).alias("preempted"), "first_wall", "last_wall", *firsts)


def merged_series(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two tables of series, of which the second holds later points of the same or other series: one, as if all had been read at once.

    Only rows of series are shuffled. Later points whose first step does not exceed the last one before open a segment.
    """
    o, n = old.select(*SERIES, F.struct("*").alias("o")), new.select(*SERIES, F.struct("*").alias("n"))
    a, b = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    real = lambda side: F.coalesce(side("count") - side("non_finite"), F.lit(0))
    total, apart = real(a) + real(b), b("mean") - a("mean")
    both = (real(a) > 0) & (real(b) > 0)
    mean = F.when(both, a("mean") + apart * real(b) / total).otherwise(F.coalesce(a("mean"), b("mean")))
    within = real(a) * a("variance") + real(b) * b("variance") + apart * apart * real(a) * real(b) / total
    joint = F.when(b("first").isNull(), 0).when(b("first.step") <= a("last.step"), 0).otherwise(1)
    cut = F.coalesce(a("segments") + b("segments") - joint, a("segments"), b("segments"))
    made = {
        "count": F.coalesce(a("count"), F.lit(0)) + F.coalesce(b("count"), F.lit(0)), "non_finite": F.coalesce(a("non_finite"), F.lit(0)) + F.coalesce(b("non_finite"), F.lit(0)), "min": F.least(a("min"), b("min")), "max": F.greatest(a("max"), b("max")), "mean": mean, "variance": F.when(both, within / total).otherwise(F.coalesce(a("variance"), b("variance"))),
        "first": F.coalesce(a("first"), b("first")), "last": F.coalesce(b("last"), a("last")), "segments": cut, "preempted": cut > 1, "first_wall": F.least(a("first_wall"), b("first_wall")), "last_wall": F.greatest(a("last_wall"), b("last_wall")),
    }
    more = {c: F.coalesce(a(c), b(c)) for c in old.columns if c not in made and c not in SERIES}
    return o.join(n, list(SERIES), "full").select(*SERIES, *(x.alias(c) for c, x in (made | more).items()))


def status(finished: Column, last_write: Column, now: float, window: float = 60.0) -> Column:
    """done, idle (silent for longer than the window), active, or ? where nothing was ever written."""
    return F.when(finished, "done").when(last_write.isNull(), "?").when(F.lit(now) - last_write > window, "idle").otherwise("active")


def runs(all_series: DataFrame, finished: Column | None = None, now: float = 0.0, window: float = 60.0) -> DataFrame:
    """One row per run, from its series."""
    rows = all_series.groupBy("run").agg(F.count("*").alias("series"), F.sum("count").alias("points"), F.sum(F.col("segments") - 1).alias("restarts"), F.max("last.step").alias("step"), F.min("first_wall").alias("first_wall"), F.max("last_wall").alias("last_wall"))
    return rows.withColumn("status", status(F.lit(False) if finished is None else finished, F.col("last_wall"), now, window))


def token_counter(all_series: DataFrame, tag: str | None = None) -> DataFrame:
    """Rows (run, counter): the tag given, exactly or as the only one that ends in /tag; else the first convention that fits so."""
    found = []
    for name in [tag] if tag else COUNTERS:
        ends = F.when(F.col("tag").endswith("/" + name), F.col("tag"))
        found += [F.max(F.when(F.col("tag") == name, F.col("tag"))), F.when(F.count(ends) == 1, F.max(ends))]
    return all_series.groupBy("run").agg(F.coalesce(*found).alias("counter")).where("counter is not null")
