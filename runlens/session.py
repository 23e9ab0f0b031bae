"""The logs under a folder as the tables that users ask for; also behind ``python -m runlens``."""

from __future__ import annotations

import os
import shutil
import time
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.functions.fmt import duration
from runlens.operators import axes, catalog, hist, restarts
from runlens.plans import predicate, scopes, tables
from runlens.plans.held import Held
from runlens.sources import eventlog, trainlog
from runlens.sources import store as stores

CLASSES = ("scalar", "histogram", "image", "text")
SHOWN, LISTED = 16, 20
RIDGES = 12
#: Signs of the levels 0 to 7 of a sparkline.
LEVELS = "▁▂▃▄▅▆▇█"


def series_of(rows: DataFrame) -> DataFrame:
    """Series of every class from rows of the source; ``class`` is the first known class of the tag's rows."""
    data = rows.where(F.col("kind").isNotNull() & ~F.col("kind").isin("run", "hparam"))
    known = F.when(F.col("kind").isin(*CLASSES), F.col("kind"))
    return catalog.series(data.select("run", "tag", "seq", "step", "wall", "value", known.alias("class")), "class").fillna("?", ["class"])


class Logs:
    """One root, as its files were when this was made: all tables agree while the files grow.

    Rows are read anew by every table, from the files that can hold them; with a ``store`` only bytes that are new since its
    last use are decoded. ``held_points`` and ``held_snapshots`` keep series between calls. With ``gather`` all is decoded
    once, at the beginning, and kept as Parquet in the shared folder until close(); only buckets are read from the files.
    """

    def __init__(self, spark: SparkSession, root: str, now: float | None = None, window: float = 60.0, store: str | None = None, verify: bool = False, gather: bool = False):
        self.spark, self.root, self.window = spark, root, window
        self.now = time.time() if now is None else now
        self.verify, self.frontier = verify, None if store else trainlog.pin(spark, root)
        self.gathered = None
        self.rows = stores.refresh(spark, root, store) if store else self.only()
        if gather and not store:
            self.gathered = eventlog.shared_folder(spark, "rows")
            trainlog.load(spark, root, verify, self.frontier, light=True).write.option("compression", "zstd").parquet(f"file://{self.gathered}")
            self.rows = spark.read.schema(trainlog.SCHEMA).parquet(f"file://{self.gathered}")
        self.held = Held({"scalar": 64, "histogram": 8})
        self.points, self.hparams = trainlog.points(self.only(kind="scalar")), trainlog.hparams(self.only(kind="hparam"))

    def only(self, **values: str) -> DataFrame:
        """The rows with these values of run, backend, kind or tag; files that can hold none are not opened."""
        if self.frontier is None or self.gathered and values.get("kind", "histogram") != "histogram":
            return self.rows.where(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in values.items())))
        return trainlog.load(self.spark, self.root, self.verify, self.frontier, {c: [v] for c, v in values.items()})

    def close(self) -> None:
        """Let go of held series and of the frontier; no table can be read afterwards unless it came from a store."""
        self.held.clear()
        if self.frontier:
            shutil.rmtree(os.path.dirname(self.frontier), ignore_errors=True)
        if self.gathered:
            shutil.rmtree(self.gathered, ignore_errors=True)

    def series(self) -> DataFrame:
        return series_of(self.rows)

    def files(self) -> DataFrame:
        """Rows (path, run, size, mtime) of the log files, as listed now."""
        found = stores.listing(self.root)
        columns = [f.path for f, *_ in found], [f.run for f, *_ in found], [size for _, size, _ in found], [mtime for *_, mtime in found]
        held = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.float64()), strict=True)], names=["path", "run", "size", "mtime"])
        return self.spark.createDataFrame(held)

    def losses(self) -> DataFrame:
        """Per run: backend, first and last wall time of any event, finished, dropped_records, dead_files."""
        own = F.col("kind") == "run"
        return self.rows.groupBy("run").agg(
            F.min("backend").alias("backend"), F.min(F.when(F.col("wall") != 0, F.col("wall"))).alias("first_wall"), F.max(F.when(F.col("wall") != 0, F.col("wall"))).alias("last_wall"), F.coalesce(F.max(own & (F.col("tag") == "finished")), F.lit(False)).alias("finished"),
            F.coalesce(F.sum(F.when(own, F.col("step"))), F.lit(0)).alias("dropped_records"), F.sum(F.when(own & (F.col("tag") == "dead"), 1).otherwise(0)).alias("dead_files"),
        )

    def runs(self) -> DataFrame:
        """One row per run, also of runs that have no series yet."""
        written = self.files().groupBy("run").agg(F.max("mtime").alias("last_write"))
        rows = self.losses().join(written, "run", "left").join(catalog.runs(self.series()).drop("status", "first_wall", "last_wall"), "run", "left")
        return rows.withColumn("status", catalog.status(F.col("finished"), F.col("last_write"), self.now, self.window)).fillna(0, ["series", "points", "restarts"])

    def ls(self, text: str = "") -> DataFrame:
        """run, backend, status, series, points, restarts, step, duration; ``text`` is a predicate or a part of the name."""
        rows = self.runs()
        if text:
            rows = predicate.filter_runs(rows, self.hparams, self.series(), text)
        span = F.col("last_wall") - F.col("first_wall")
        return rows.select("run", "backend", "status", "series", "points", "restarts", "step", F.when(span > 0, duration(span)).otherwise("").alias("duration")).orderBy("run")

    def summary(self, run: str) -> DataFrame:
        """The series of one run; ValueError lists the runs if there is none of that name."""
        rows = self.only(run=run)
        if rows.isEmpty():
            known = sorted(r.run for r in self.rows.select("run").distinct().collect())
            raise ValueError(f"no run {run!r}; runs: {', '.join(known)}")
        own = series_of(rows)
        return tables.run_summary(own, run).drop("class").join(own.select("tag", "class"), "tag").select("tag", "class", "count", "min", "max", "mean", "last", "step", "segments").orderBy("tag")

    def export(self, runs: DataFrame | None = None) -> DataFrame:
        """One row per run of the scope, with the hyperparameters and scalar tags that occur in it."""
        series, hparams = series_of(self.only(kind="scalar")), self.hparams
        if runs is not None:
            series, hparams = (rows.join(runs.select("run"), "run", "left_semi") for rows in (series, hparams))
        return tables.export(series, hparams).orderBy("run")

    def filtered(self, text: str = "") -> DataFrame:
        """Rows (run): the runs that the predicate lets through."""
        rows = self.runs()
        return (predicate.filter_runs(rows, self.hparams, self.series(), text) if text else rows).select("run")

    def scope(self, text: str = "", picked: scopes.WorkingSet | None = None) -> DataFrame:
        """Rows (run): the selection within the working set; without a selection the runs in it that the predicate lets through."""
        picked = picked or scopes.WorkingSet()
        return scopes.scope(self.rows.select("run").distinct(), self.filtered(text), picked)

    def runs_view(self) -> DataFrame:
        """Runs with ``trend``: the last values of the run's preferred scalar series as signs; the duration is also given where it is nought."""
        preferred = tables.preferred_tag(self.series().where(F.col("class") == "scalar"))
        cells = axes.sparkline(self.points.join(preferred, ["run", "tag"], "left_semi"))
        signs = F.array(*map(F.lit, LEVELS))
        drawn = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell", "level"))), lambda c: F.get(signs, c["level"])), "")
        trend = cells.groupBy("run").agg(drawn.alias("trend"))
        rows = self.runs()
        return tables.runs_table(rows, strict=False).join(trend, "run", "left").withColumn("trend", F.coalesce("trend", F.lit("")))

    def tags(self, needle: str = "", runs: DataFrame | None = None, kind: str = "scalar") -> DataFrame:
        """Rows (tag): the tags of a class in the scope, sorted."""
        return scopes.tags(self.series(), self.rows.select("run").distinct() if runs is None else runs, kind, needle)

    def scalars(self, runs: DataFrame | None = None, tag: str | None = None) -> DataFrame:
        """Live points (run, tag, step, wall, value) of the scope, of one tag if that is given: the scalars export."""
        points = self.points if tag is None else trainlog.points(self.only(kind="scalar", tag=tag))
        points = points if runs is None else points.join(runs.select("run"), "run", "left_semi")
        return restarts.with_live(points).where("is_live").select("run", "tag", "step", "wall", "value")

    def held_points(self, run: str, tag: str) -> DataFrame:
        """All points of a scalar series with ``is_live``, kept for the next call; the 64 last asked for stay."""
        return self.held.get("scalar", (run, tag), lambda: restarts.with_live(trainlog.points(self.only(kind="scalar", run=run, tag=tag))))

    def held_snapshots(self, run: str, tag: str) -> DataFrame:
        """The live histograms of a series, kept for the next call; those of the 8 last asked for stay."""
        return self.held.get("histogram", (run, tag), lambda: self.snapshots_of(self.only(kind="histogram", run=run, tag=tag)))

    def snapshots(self, runs: DataFrame | None = None) -> DataFrame:
        """Live histograms (run, tag, seq, step, wall, buckets) of the scope."""
        rows = self.only(kind="histogram")
        return self.snapshots_of(rows if runs is None else rows.join(runs.select("run"), "run", "left_semi"))

    def snapshots_of(self, rows: DataFrame) -> DataFrame:
        rows = rows.select("run", "tag", "seq", "step", "wall", "buckets")
        return restarts.with_live(rows).where("is_live").select("run", "tag", "seq", "step", "wall", "buckets")

    def histograms(self, runs: DataFrame | None = None) -> DataFrame:
        """Rows (run, tag, step, wall, left, right, count), one per bucket of a live histogram: the histograms export."""
        return self.snapshots(runs).select("run", "tag", "step", "wall", F.explode("buckets").alias("b")).select("run", "tag", "step", "wall", "b.*")

    def distribution(self, run: str | None = None, tag: str | None = None, runs: DataFrame | None = None, rows: int = RIDGES) -> DataFrame:
        """The ridgeline of at most ``rows`` live histograms of one series: that at the cursor, else the first."""
        scope = self.rows.select("run").distinct() if runs is None else runs
        chosen = scopes.target(self.series(), scope, run, tag)  # one row
        found = self.snapshots().join(F.broadcast(chosen), ["run", "tag"], "left_semi")
        return hist.ridgeline(hist.sample(found, rows))

    def chosen(self, tag: str, runs: DataFrame | None = None) -> DataFrame:
        """Rows (run, tag): the scalar series of the scope whose tag holds ``tag``."""
        rows = self.series().where((F.col("class") == "scalar") & F.col("tag").contains(tag)).select("run", "tag")
        return rows if runs is None else rows.join(runs.select("run"), "run", "left_semi")

    def counted(self, counter: str | None) -> DataFrame:
        """Live points of each run's token counter, with ``tokens``."""
        found = catalog.token_counter(self.series().where(F.col("class") == "scalar"), counter).withColumnRenamed("counter", "tag")
        return restarts.with_live(self.points.join(found, ["run", "tag"], "left_semi")).where("is_live").withColumnRenamed("value", "tokens")

    def notes(self, tag: str, axis: str = "step", counter: str | None = None, runs: DataFrame | None = None) -> DataFrame:
        """What a chart's title tells, in one row: runs, not_shown (series beyond the first 16), dropped_records, dead_files, without_counter (runs), outside (points beyond their run's counter)."""
        drawn = self.chosen(tag, runs)
        shown = drawn.orderBy("run", "tag").limit(SHOWN)
        parts = [shown.agg(F.countDistinct("run").alias("runs"), (-F.count("*")).alias("not_shown")), drawn.agg(F.count("*").alias("not_shown")), self.losses().agg(F.sum("dropped_records").alias("dropped_records"), F.sum("dead_files").alias("dead_files"))]
        if axis == "tokens":
            live = restarts.with_live(self.points.join(F.broadcast(shown), ["run", "tag"], "left_semi")).where("is_live")
            steps = self.counted(counter)
            placed = axes.tokens_axis(live, steps).join(steps.select("run").distinct().withColumn("counted", F.lit(True)), "run", "left")
            lacking = F.col("counted").isNull()
            parts.append(placed.agg(F.countDistinct(F.when(lacking, F.col("run"))).alias("without_counter"), F.count(F.when(~lacking & F.col("x").isNull(), 1)).alias("outside")))
        told = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)  # a few rows
        return told.agg(*(F.coalesce(F.sum(c) if c in told.columns else F.lit(0), F.lit(0)).cast("long").alias(c) for c in ("runs", "not_shown", "dropped_records", "dead_files", "without_counter", "outside")))

    def title(self, tag: str, axis: str = "step", counter: str | None = None, runs: DataFrame | None = None, live: str | None = None) -> str:
        """The title of a chart: the tag asked for, and what its notes hold that is not nought."""
        n = self.notes(tag, axis, counter, runs).first()
        said = [(n.runs > 1, f"{n.runs} runs"), (n.not_shown, f"+{n.not_shown} series not shown"), (n.dropped_records, f"{n.dropped_records} records lost"), (n.dead_files, f"{n.dead_files} dead files"), (n.without_counter, f"{n.without_counter} runs lack a token counter"), (n.outside, f"{n.outside} pts outside counter"), (live, live)]
        return " · ".join([tag, *(text for told, text in said if told)])

    def show(self, tag: str, axis: str = "step", smooth: float | None = None, counter: str | None = None, runs: DataFrame | None = None, ghosts: bool = False, log: bool = False, window: tuple[float, float] | None = None) -> DataFrame:
        """Live points (run, tag, seq, x, step, wall, value, with ``smooth`` also smoothed, with ``log`` also log_value) of the first 16 scalar series in scope whose tag holds ``tag``.

        With ``ghosts`` points that a restart took back are there too, told by ``is_live``; they are not smoothed. A
        ``window`` leaves the points with x from its first to its second value. ValueError lists tags if no series fits.
        """
        chosen = self.chosen(tag, runs).orderBy("run", "tag").limit(SHOWN)
        if chosen.isEmpty():
            known = [r.tag for r in self.tags().limit(LISTED).collect()]
            raise ValueError(f"no tag holds {tag!r}; tags: {', '.join(known)}")
        flagged = restarts.with_live(self.points.join(F.broadcast(chosen), ["run", "tag"], "left_semi"))  # at most SHOWN rows
        if axis == "tokens":
            drawn = axes.tokens_axis(flagged, self.counted(counter)).where("x is not null")
        elif axis == "relative":
            drawn = axes.relative_axis(flagged)
        else:
            drawn = {"step": axes.step_axis, "wall": axes.wall_axis}[axis](flagged)
        drawn = drawn.select("run", "tag", "seq", "x", "step", "wall", "value", "is_live")
        if smooth is not None:
            drawn = drawn.join(axes.ewma(drawn.where("is_live"), smooth), ["run", "tag", "seq"], "left")
        drawn = drawn if ghosts else drawn.where("is_live").drop("is_live")
        drawn = axes.log_y(drawn) if log else drawn
        drawn = drawn if window is None else drawn.where(F.col("x").between(*window))
        return drawn.orderBy("run", "tag", "seq")
