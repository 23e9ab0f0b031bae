"""Tables shown to users: runs, summaries, the runs x (parameters + metrics) pivot, scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions.fmt import duration, float_text_udf
from runlens.operators.catalog import finite

OVERLAY, GRID_TAGS, GRID_RUNS = 16, 12, 4


def runs_table(runs: DataFrame, strict: bool = True) -> DataFrame:
    """run, status, series, points, restarts, step, duration; the duration is empty unless the last wall time is later (or, not strict, as late)."""
    span = F.col("last_wall") - F.col("first_wall")
    known = span > 0 if strict else span >= 0
    return runs.select("run", "status", "series", "points", "restarts", "step", F.when(known, duration(span)).otherwise("").alias("duration"))


def run_summary(series: DataFrame, run: str) -> DataFrame:
    """The series of one run; ``last`` is null where it is NaN."""
    last = F.col("last.value")
    return series.where(F.col("run") == run).select("tag", F.lit("scalar").alias("class"), "count", "min", "max", "mean", F.when(~F.isnan(last), last).alias("last"), F.col("last.step").alias("step"), "segments")


def sorted_runs(runs: DataFrame, by: str = "points", reverse: bool = False) -> DataFrame:
    """Runs with their rank ``position``: by a column, ties by name, missing values first; reversal turns the whole order."""
    order = [F.col(by).desc_nulls_last(), F.col("run").desc()] if reverse else [F.col(by).asc_nulls_first(), F.col("run").asc()]
    return runs.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def hparam_text() -> Column:
    return F.coalesce("str", F.col("bool").cast("string"), float_text_udf("num"))


def export(series: DataFrame, hparams: DataFrame) -> DataFrame:
    """One row per run: hyperparameters as text, last values of scalar tags, keys in order; a tag named like a key gets ``#metric``."""
    keys = [r.key for r in hparams.select("key").distinct().orderBy("key").collect()]
    tags = [r.tag for r in series.select("tag").distinct().orderBy("tag").collect()]
    values = series.groupBy("run").pivot("tag", tags).agg(F.first("last.value"))
    values = values.select("run", *(F.col(f"`{t}`").alias(f"{t}#metric" if t in keys else t) for t in tags))
    if not keys:
        return values
    texts = hparams.select("run", "key", hparam_text().alias("text")).groupBy("run").pivot("key", keys).agg(F.first("text"))
    return values.join(texts, "run", "left").select("run", *(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`") for c in values.columns[1:]))


def hparams_wide(hparams: DataFrame, scope: DataFrame) -> DataFrame:
    keys = [r.key for r in hparams.select("key").distinct().orderBy("key").collect()]
    return hparams.join(scope.select("run"), "run", "left_semi").select("run", "key", hparam_text().alias("text")).groupBy("run").pivot("key", keys).agg(F.first("text"))


def subsequence(needle: str) -> str:
    """A pattern that matches texts which hold the needle's characters in order."""
    return "(?s)" + ".*".join("\\x{%x}" % ord(c) for c in needle)


def overlay(series: DataFrame, runs: DataFrame, tag: str, limit: int = OVERLAY) -> DataFrame:
    """The tag's series in the first ``limit`` runs of the scope, by name."""
    first = runs.select("run").orderBy("run").limit(limit)
    return series.where(F.col("tag") == tag).join(F.broadcast(first), "run", "left_semi")  # at most ``limit`` rows


def compare_grid(series: DataFrame, tags: int = GRID_TAGS, runs: int = GRID_RUNS) -> DataFrame:
    """The series of the first tags of the first runs."""
    t = series.select("tag").distinct().orderBy("tag").limit(tags)
    r = series.select("run").distinct().orderBy("run").limit(runs)
    return series.join(F.broadcast(t), "tag", "left_semi").join(F.broadcast(r), "run", "left_semi")


def preferred_tag(series: DataFrame) -> DataFrame:
    """Per run the first tag that holds ``loss``, else the first tag."""
    return series.groupBy("run").agg(F.coalesce(F.min(F.when(F.col("tag").contains("loss"), F.col("tag"))), F.min("tag")).alias("tag"))


def last_finite() -> Column:
    return finite(F.col("last.value"))
