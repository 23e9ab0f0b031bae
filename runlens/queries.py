"""Registered queries over the driver's tables, each with the same result as DuckDB SQL.

``events`` is read as a training log: a run per user, a tag per event type, steps that rewind every fifth point, a NaN
where the id is divisible by 97. ``customer`` gives the runs' hyperparameters, ``lineitem`` histograms of quantities. The queries named log_... write both
as event files to the shared folder, once a session, and read them back through the data source; those named formats_...
write ``events`` in the other three formats, with damage.
"""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.functions.fmt import duration, float_text_udf, significant_udf
from runlens.operators import axes, catalog, hist, restarts
from runlens.plans import predicate, scopes, tables
from runlens.session import Logs
from runlens.sources import eventlog, otherlogs, trainlog
from runlens.streaming import state, tail

NOW = 1704500000.0
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    rn = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    wall = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("run"), F.col("event_type").alias("tag"), F.col("event_id").alias("seq"), wall.alias("wall"), F.when(F.col("event_id") % 97 == 0, float("nan")).otherwise(F.col("value")).alias("value"), rn.alias("rn"), "user_id")
    return rows.select("run", "tag", "seq", (F.col("rn") - (3 + F.col("user_id") % 3) * F.floor(F.col("rn") / 5)).cast("long").alias("step"), "wall", "value")


def hparams(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("run"), "c_acctbal", "c_mktsegment", "c_nationkey")
    none = F.lit(None)
    return c.select("run", F.explode(F.array(F.struct(F.lit("balance").alias("key"), F.col("c_acctbal").alias("num"), none.cast("string").alias("str"), none.cast("boolean").alias("bool")), F.struct(F.lit("segment").alias("key"), none.cast("double").alias("num"), F.col("c_mktsegment").alias("str"), none.cast("boolean").alias("bool")), F.struct(F.lit("domestic").alias("key"), none.cast("double").alias("num"), none.cast("string").alias("str"), (F.col("c_nationkey") < 5).alias("bool")))).alias("h")).select("run", "h.*")


def quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits and counts of l_quantity per supplier (run) and month (seq): limits 10, 20, 30, 40, 50."""
    li = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("seq"), "l_quantity")
    q = F.col("l_quantity")
    n = [F.count(F.when((q > 10 * k) & (q <= 10 * k + 10), 1)).cast("double") for k in range(5)]
    rows = li.groupBy("run", "seq").agg(F.array(*n).alias("counts"), F.min(q).alias("low"), F.max(q).alias("high"))
    limits = F.array(*(F.lit(float(x)) for x in (10, 20, 30, 40, 50)))
    return rows.select("run", F.lit("quantity").alias("tag"), "seq", limits.alias("limits"), "counts", "low", "high")


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = hist.normalise(F.col("limits"), F.col("counts"), F.col("low"), F.col("high"))
    return quantities(spark, sf_dir).select("run", "tag", "seq", made.alias("buckets"))


P = """
WITH points AS (SELECT run, tag, seq, CAST(rn - (3 + user_id % 3) * (rn // 5) AS BIGINT) AS step, wall, value FROM (
  SELECT 'u' || user_id AS run, event_type AS tag, event_id AS seq, user_id, epoch(ts) AS wall,
    CASE WHEN event_id % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)),
seg AS (SELECT *, CAST(sum(p) OVER (PARTITION BY run, tag ORDER BY seq) AS BIGINT) AS segment, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM (
  SELECT *, CASE WHEN step <= lag(step) OVER (PARTITION BY run, tag ORDER BY seq) THEN 1 ELSE 0 END AS p FROM points)),
live AS (SELECT *, coalesce(min(step) OVER (PARTITION BY run, tag ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > step, true) AS is_live FROM seg),
ser AS (SELECT run, tag, count(*) AS n, count(v) AS nf, min(v) AS mn, max(v) AS mx, avg(v) AS mean, var_pop(v) AS variance, arg_min(step, seq) AS first_step, arg_max(step, seq) AS last_step,
  arg_max(value, seq) AS last_value, arg_min(value, seq) AS first_value, max(segment) + 1 AS segments, min(wall) AS first_wall, max(wall) AS last_wall FROM seg GROUP BY run, tag),
r AS (SELECT run, count(*) AS series, CAST(sum(n) AS BIGINT) AS points, CAST(sum(segments - 1) AS BIGINT) AS restarts, max(last_step) AS step, min(first_wall) AS fw, max(last_wall) AS lw FROM ser GROUP BY run)
"""  # noqa: E501


def span_sql(s: str) -> str:
    """Duration text of whole seconds s."""
    return f"CASE WHEN {s} < 120 THEN {s} || 's' WHEN {s} < 3600 THEN ({s} // 60) || 'm' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0') || 's' WHEN {s} < 172800 THEN ({s} // 3600) || 'h' || lpad(CAST({s} % 3600 // 60 AS VARCHAR), 2, '0') || 'm' ELSE ({s} // 86400) || 'd' || lpad(CAST({s} % 86400 // 3600 AS VARCHAR), 2, '0') || 'h' END"


def text_sql(v: str) -> str:
    return f"CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


STATUS_SQL = f"CASE WHEN lw IS NULL THEN '?' WHEN {NOW} - lw > 86400 THEN 'idle' ELSE 'active' END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in columns})


def series_of(spark, d) -> DataFrame:
    return catalog.series(points(spark, d))


def runs_of(spark, d) -> DataFrame:
    return catalog.runs(series_of(spark, d), now=NOW, window=86400.0)


@query(P + "SELECT run, tag, segment, arg_min(step, seq) AS first_step, arg_max(step, seq) AS last_step, arg_max(v, seq) FILTER (v IS NOT NULL) AS last_finite, count(*) AS count, count(*) - count(v) AS non_finite, min(v) AS min, max(v) AS max, round(avg(v), 7) AS mean, lead(arg_min(step, seq)) OVER (PARTITION BY run, tag ORDER BY segment) AS preempted_at FROM seg GROUP BY run, tag, segment")
def restart_segments(spark, d):
    p = points(spark, d)
    s = catalog.segments(p)
    last = catalog.segmented(p).where(~F.isnan("value")).groupBy("run", "tag", "segment").agg(F.max_by("value", "seq").alias("last_finite"))
    return rounded(s.join(last, ["run", "tag", "segment"], "left").select("run", "tag", "segment", F.col("first.step").alias("first_step"), F.col("last.step").alias("last_step"), "last_finite", "count", "non_finite", "min", "max", "mean", "preempted_at"), "mean")


@query(P + "SELECT run, tag, n AS count, n - nf AS non_finite, mn AS min, mx AS max, round(mean, 7) AS mean, round(variance, 1) AS variance, first_step, last_step, CASE WHEN isnan(last_value) THEN NULL ELSE last_value END AS last, segments, segments > 1 AS preempted FROM ser")
def series_summary(spark, d):
    last = F.col("last.value")
    return series_of(spark, d).select("run", "tag", "count", "non_finite", "min", "max", F.round("mean", 7).alias("mean"), F.round("variance", 1).alias("variance"), F.col("first.step").alias("first_step"), F.col("last.step").alias("last_step"), F.when(~F.isnan(last), last).alias("last"), "segments", "preempted")


@query(P + "SELECT run, tag, nf AS n_finite, round(mean, 7) AS mean, round(variance * nf, 0) AS m2 FROM ser")
def moments_merge(spark, d):
    merged = catalog.merged_moments(catalog.segments(points(spark, d)), "run", "tag")
    return merged.select("run", "tag", "n_finite", F.round("mean", 7).alias("mean"), F.round(F.when(F.col("n_finite") > 0, F.col("m2")), 0).alias("m2"))


@query(P + "SELECT run, restarts FROM r")
def run_preemptions(spark, d):
    return runs_of(spark, d).select("run", "restarts")


@query(P + f"SELECT run, {STATUS_SQL} AS status, series, points, restarts, step, CASE WHEN lw > fw THEN {span_sql('CAST(round(lw - fw) AS BIGINT)')} ELSE '' END AS duration FROM r")
def runs_table(spark, d):
    return tables.runs_table(runs_of(spark, d))


@query(P + "SELECT tag, 'scalar' AS class, n AS count, mn AS min, mx AS max, round(mean, 7) AS mean, CASE WHEN isnan(last_value) THEN NULL ELSE last_value END AS last, last_step AS step, segments FROM ser WHERE run = 'u3'")
def run_summary(spark, d):
    return rounded(tables.run_summary(series_of(spark, d), "u3"), "mean")


@query(P + "SELECT run, points, row_number() OVER (ORDER BY points DESC, run DESC) AS position FROM r")
def runs_sorted(spark, d):
    return tables.sorted_runs(runs_of(spark, d), "points", reverse=True).select("run", "points", F.col("position").cast("long").alias("position"))


@query(P + f"SELECT run, {STATUS_SQL} AS status, round(fw, 3) AS first_wall, round(lw, 3) AS last_wall FROM r")
def run_status(spark, d):
    return runs_of(spark, d).select("run", "status", F.round("first_wall", 3).alias("first_wall"), F.round("last_wall", 3).alias("last_wall"))


@query(P + "SELECT run, tag, seq, step, segment, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM live WHERE is_live")
def live_points(spark, d):
    return restarts.with_live(points(spark, d)).where("is_live").select("run", "tag", "seq", "step", "segment", catalog.finite(F.col("value")).alias("value"))


@query(P + "SELECT a.run, a.tag, a.seq, a.step, a.segment, min(b.segment) AS ghost_of FROM live a JOIN live b ON a.run = b.run AND a.tag = b.tag AND b.p = 1 AND b.segment > a.segment AND b.step <= a.step WHERE NOT a.is_live GROUP BY ALL")
def ghost_points(spark, d):
    return restarts.ghosts(restarts.with_live(points(spark, d))).select("run", "tag", "seq", "step", "segment", "ghost_of")


@query(P + "SELECT s.run, s.tag, s.segment, s.step AS start_step, (SELECT count(*) FROM seg a WHERE a.run = s.run AND a.tag = s.tag AND a.segment < s.segment AND NOT EXISTS (SELECT 1 FROM seg b WHERE b.run = s.run AND b.tag = s.tag AND b.p = 1 AND b.segment > a.segment AND b.segment <= s.segment AND b.step <= a.step)) AS cut FROM seg s WHERE s.p = 1")
def restart_cuts(spark, d):
    return restarts.cuts(restarts.with_live(points(spark, d)))


@query(P + """SELECT DISTINCT tag, step FROM (SELECT tag, arg_min(step, seq) AS step, segment FROM live WHERE is_live GROUP BY run, tag, segment) WHERE segment > 0""")
def boundary_steps(spark, d):
    return axes.boundaries(restarts.with_live(points(spark, d)))


H = P + """, c AS (SELECT 'u' || c_custkey AS run, c_acctbal AS balance, c_mktsegment AS segment, c_nationkey < 5 AS domestic FROM customer)
"""


@query(H + f"SELECT run, {text_sql('c.balance')} AS balance, CASE WHEN domestic THEN 'true' ELSE 'false' END AS domestic, c.segment, max(last_value) FILTER (tag = 'click' AND NOT isnan(last_value)) AS click, max(last_value) FILTER (tag = 'purchase' AND NOT isnan(last_value)) AS purchase FROM ser LEFT JOIN c USING (run) GROUP BY ALL")
def export_pivot(spark, d):
    wide = tables.export(series_of(spark, d), hparams(spark, d))
    return wide.select("run", "balance", "domestic", "segment", catalog.finite(F.col("click")).alias("click"), catalog.finite(F.col("purchase")).alias("purchase"))


@query(H + f"SELECT run, {text_sql('c.balance')} AS balance, CASE WHEN domestic THEN 'true' ELSE 'false' END AS domestic, c.segment FROM r JOIN c USING (run)")
def hparams_table(spark, d):
    return tables.hparams_wide(hparams(spark, d), runs_of(spark, d)).select("run", "balance", "domestic", "segment")


def filtered(spark, d, text: str) -> DataFrame:
    s = series_of(spark, d)
    return predicate.filter_runs(catalog.runs(s, now=NOW, window=86400.0), hparams(spark, d), s, text).select("run")


LAST = ", w AS (SELECT r.run, c.*, (SELECT CASE WHEN isnan(last_value) THEN NULL ELSE last_value END FROM ser WHERE ser.run = r.run AND tag = 'click') AS click FROM r LEFT JOIN c USING (run)) "


@query(H + LAST + "SELECT run FROM w WHERE (coalesce(balance > 1000, false) AND coalesce(segment = 'BUILDING', false)) OR coalesce(click >= 250, false)")
def predicate_filter(spark, d):
    return filtered(spark, d, "balance > 1000 and segment == BUILDING or click >= 250")


@query(H + LAST + "SELECT run FROM w WHERE coalesce(click <> 100, false)")
def predicate_missing(spark, d):
    return filtered(spark, d, "click != 100 or absent != 3")


@query(H + LAST + "SELECT run FROM w WHERE NOT (coalesce(domestic, false) OR coalesce(click < 200, false))")
def predicate_not(spark, d):
    return filtered(spark, d, "not (domestic == true or click < 200) and not absent == 1")


@query(P + "SELECT run FROM r WHERE contains(run, 'u1')")
def substring_fallback(spark, d):
    return filtered(spark, d, "u1")


@query(H + "SELECT run FROM r JOIN c USING (run) WHERE contains(c.segment, 'BUILD') AND run <> 'u3'")
def predicate_contains(spark, d):
    return filtered(spark, d, "segment ~ BUILD and name != u3")


@query(P + "SELECT run FROM ser WHERE tag = 'click' AND NOT isnan(last_value) AND last_value > 100")
def suffix_field(spark, d):
    s = series_of(spark, d).withColumn("tag", F.concat(F.lit("train/"), F.col("tag")))
    return predicate.filter_runs(catalog.runs(s, now=NOW), hparams(spark, d), s, "click > 100").select("run")


@query(P + "SELECT run, tag FROM ser WHERE contains(tag, 'l')")
def tag_substring(spark, d):
    return series_of(spark, d).where(F.col("tag").contains("l")).select("run", "tag")


@query(P + "SELECT run, tag FROM ser WHERE regexp_matches(tag, '(?s)c.*k')")
def tag_subsequence(spark, d):
    return series_of(spark, d).where(F.col("tag").rlike(tables.subsequence("ck"))).select("run", "tag")


@query(P + "SELECT run FROM r WHERE run IN ('u1', 'u2', 'u5')")
def working_set_keep(spark, d):
    kept = spark.createDataFrame([("u1",), ("u2",), ("u5",)], "run string")
    return runs_of(spark, d).join(F.broadcast(kept), "run", "left_semi").select("run")


@query(P + "SELECT run FROM r WHERE run NOT IN ('u1', 'u2')")
def working_set_exclude(spark, d):
    gone = spark.createDataFrame([("u1",), ("u2",)], "run string")
    return runs_of(spark, d).join(F.broadcast(gone), "run", "left_anti").select("run")


def live(spark, d) -> DataFrame:
    return restarts.with_live(points(spark, d)).where("is_live")


V = "CASE WHEN isnan(value) THEN NULL ELSE value END AS value"


@query(P + f"SELECT run, tag, seq, CAST(step AS DOUBLE) AS x, {V} FROM live WHERE is_live")
def axis_step(spark, d):
    return axes.step_axis(live(spark, d)).select("run", "tag", "seq", "x", catalog.finite(F.col("value")).alias("value"))


@query(P + f"SELECT run, tag, seq, round(wall, 3) AS x, {V} FROM live WHERE is_live")
def axis_wall(spark, d):
    return axes.wall_axis(live(spark, d)).select("run", "tag", "seq", F.round("x", 3).alias("x"), catalog.finite(F.col("value")).alias("value"))


@query(P + "SELECT run, tag, seq, is_live, round(wall - first_value(wall) OVER (PARTITION BY run, tag ORDER BY CASE WHEN is_live THEN seq END NULLS LAST), 2) AS x FROM live")
def axis_relative(spark, d):
    return axes.relative_axis(restarts.with_live(points(spark, d))).select("run", "tag", "seq", "is_live", F.round("x", 2).alias("x"))


def counter(spark, d) -> DataFrame:
    """A counter per run: at every third step of its live clicks, 1024 tokens a step."""
    return live(spark, d).where("tag = 'click' and step % 3 = 0").select("run", "step", (F.col("step") * F.col("step") * 1024.0).alias("tokens"))


@query(P + """, k AS (SELECT run, step, CAST(step * step * 1024 AS DOUBLE) AS tokens FROM live WHERE is_live AND tag = 'click' AND step % 3 = 0),
m AS (SELECT l.run, l.tag, l.seq, l.step, (SELECT max(step) FROM k WHERE k.run = l.run AND k.step <= l.step) AS a, (SELECT min(step) FROM k WHERE k.run = l.run AND k.step > l.step) AS b FROM live l WHERE is_live)
SELECT m.run, m.tag, m.seq, round(CASE WHEN m.a = m.step THEN ka.tokens ELSE ka.tokens + (kb.tokens - ka.tokens) * (m.step - m.a) / (m.b - m.a) END, 3) AS x
FROM m LEFT JOIN k ka ON ka.run = m.run AND ka.step = m.a LEFT JOIN k kb ON kb.run = m.run AND kb.step = m.b""")
def axis_tokens(spark, d):
    return axes.tokens_axis(live(spark, d), counter(spark, d)).select("run", "tag", "seq", F.round("x", 3).alias("x"))


@query(P + ", t AS (SELECT run, 'x/' || tag AS tag FROM ser) SELECT run, 'x/click' AS counter FROM t WHERE tag = 'x/click'")
def token_counter(spark, d):
    s = series_of(spark, d).withColumn("tag", F.concat(F.lit("x/"), F.col("tag")))
    return catalog.token_counter(s, "click")


@query(P + """, o AS (SELECT run, tag, seq, value, row_number() OVER (PARTITION BY run, tag ORDER BY seq) AS n FROM points WHERE NOT isnan(value))
SELECT a.run, a.tag, a.seq, round(sum(0.4 * pow(0.6, a.n - b.n) * b.value) / (1 - pow(0.6, max(a.n))), 7) AS smoothed FROM o a JOIN o b ON a.run = b.run AND a.tag = b.tag AND b.n <= a.n GROUP BY a.run, a.tag, a.seq""")
def ewma_debiased(spark, d):
    return axes.ewma(points(spark, d), 0.6).where(F.col("smoothed").isNotNull() & ~F.isnan("smoothed")).select("run", "tag", "seq", F.round("smoothed", 7).alias("smoothed"))


@query(P + "SELECT run, tag, min(v) AS y_min, max(v) AS y_max, count(v) AS n FROM live WHERE is_live AND step BETWEEN 2 AND 6 GROUP BY run, tag HAVING min(v) < max(v)")
def zoom_refit(spark, d):
    return axes.zoom(axes.step_axis(live(spark, d)), 2.0, 6.0)


@query(P + "SELECT tag, CAST(min(step) AS DOUBLE) AS x_min, CAST(max(step) AS DOUBLE) AS x_max FROM live WHERE is_live GROUP BY tag")
def x_extent(spark, d):
    return axes.extent(axes.step_axis(live(spark, d)))


@query(P + "SELECT run, tag, arg_min(CAST(step AS DOUBLE), abs(step - 3.5) * 1000000 + step) AS x, arg_min(coalesce(v, -1), abs(step - 3.5) * 1000000 + step) AS value FROM live WHERE is_live GROUP BY run, tag")
def nearest_point(spark, d):
    return axes.nearest(axes.step_axis(live(spark, d)).withColumn("value", F.coalesce(catalog.finite(F.col("value")), F.lit(-1.0))), 3.5)


@query(P + "SELECT run, tag, seq, round(CASE WHEN v > 100 THEN log10(v - 100) END, 6) AS log_value FROM live WHERE is_live")
def log_y(spark, d):
    return axes.log_y(live(spark, d).withColumn("value", F.col("value") - 100)).select("run", "tag", "seq", F.round("log_value", 6).alias("log_value"))


@query(P + """, b AS (SELECT *, min(step) OVER (PARTITION BY run, tag) AS lo, max(step) OVER (PARTITION BY run, tag) AS hi FROM live WHERE is_live),
k AS (SELECT *, CAST(CASE WHEN hi > lo THEN least(floor((step - lo) * 4.0 / (hi - lo)), 3) ELSE 0 END AS INTEGER) AS col FROM b)
SELECT run, tag, col, arg_min(v, step) AS first, arg_max(v, step) AS last, min(v) AS min, max(v) AS max FROM k WHERE v IS NOT NULL GROUP BY run, tag, col""")
def m4_reduce(spark, d):
    return axes.m4(axes.step_axis(live(spark, d)), 4)


@query(P + """, q AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY seq DESC) AS back FROM seg),
f AS (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY run, tag) AS n FROM q WHERE back <= 120 AND v IS NOT NULL),
g AS (SELECT run, tag, CAST(c AS INTEGER) AS cell, max(v) AS v FROM f, range(12) t(c) WHERE n >= 2 AND i >= c * n // 12 AND i < greatest((c + 1) * n // 12, c * n // 12 + 1) GROUP BY ALL),
h AS (SELECT *, min(v) OVER (PARTITION BY run, tag) AS lo, max(v) OVER (PARTITION BY run, tag) AS hi FROM g)
SELECT run, tag, cell, CAST(CASE WHEN hi > lo THEN round((v - lo) / (hi - lo) * 7) ELSE 3 END AS INTEGER) AS level FROM h""")
def sparkline(spark, d):
    return axes.sparkline(points(spark, d))


@query(P + "SELECT run, tag, n AS count FROM ser WHERE tag = 'click' AND run IN (SELECT run FROM r ORDER BY run LIMIT 16)")
def overlay_limit(spark, d):
    return tables.overlay(series_of(spark, d), runs_of(spark, d), "click").select("run", "tag", "count")


@query(P + "SELECT run, tag, n AS count FROM ser WHERE tag IN (SELECT DISTINCT tag FROM ser ORDER BY tag LIMIT 12) AND run IN (SELECT DISTINCT run FROM ser ORDER BY run LIMIT 4)")
def compare_grid(spark, d):
    return tables.compare_grid(series_of(spark, d)).select("run", "tag", "count")


@query(P + "SELECT DISTINCT tag FROM ser")
def visible_tags(spark, d):
    return series_of(spark, d).select("tag").distinct()


@query(P + "SELECT run, coalesce(min(CASE WHEN contains(tag, 'loss') THEN tag END), min(tag)) AS tag FROM ser GROUP BY run")
def preferred_tag(spark, d):
    return tables.preferred_tag(series_of(spark, d))


B = """
WITH q AS (SELECT 's' || l_suppkey AS run, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS seq, l_quantity AS q FROM lineitem),
g AS (SELECT run, seq, min(q) AS lo, max(q) AS hi FROM q GROUP BY ALL),
e AS (SELECT run, seq, k, lo, hi, CASE WHEN k = 0 THEN least(lo, CAST(10 AS DOUBLE)) ELSE CAST(10 * k AS DOUBLE) END AS l, CASE WHEN k = 4 THEN greatest(hi, CAST(40 AS DOUBLE)) ELSE CAST(10 * k + 10 AS DOUBLE) END AS rr FROM g, range(5) t(k)),
b AS (SELECT run, seq, k, l AS "left", rr AS "right", CAST((SELECT count(*) FROM q WHERE q.run = e.run AND q.seq = e.seq AND q.q > 10 * k AND q.q <= 10 * k + 10) AS DOUBLE) AS count FROM e)
"""


@query(B + 'SELECT run, seq, "left", "right", count FROM b')
def hist_normalize(spark, d):
    return histograms(spark, d).select("run", "seq", F.explode("buckets").alias("b")).select("run", "seq", "b.*")


@query(B + ', s AS (SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY seq) AS rn FROM g), t AS (SELECT run, seq, rn - 3 * (rn // 5) AS step FROM s), u AS (SELECT *, coalesce(min(step) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > step, true) AS ok FROM t) SELECT run, seq, CAST(step AS BIGINT) AS step FROM u WHERE ok')
def hist_live(spark, d):
    rn = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    snaps = histograms(spark, d).withColumn("rn", rn).withColumn("step", (F.col("rn") - 3 * F.floor(F.col("rn") / 5)).cast("long"))
    return restarts.with_live(snaps).where("is_live").select("run", "seq", "step")


@query(B + ", s AS (SELECT run, seq, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM g) SELECT run, seq FROM s WHERE n <= 12 OR pos IN (SELECT r * (n - 1) // 11 FROM range(12) t(r))")
def ridgeline_sample(spark, d):
    return hist.sample(histograms(spark, d), 12).select("run", "seq")


@query(B + ', z AS (SELECT *, count / greatest("right" - "left", 2.2250738585072014e-308) AS dd, dense_rank() OVER (PARTITION BY run ORDER BY seq) - 1 AS pos FROM b), y AS (SELECT *, max(dd) OVER (PARTITION BY run, seq) AS pk, max(pos) OVER (PARTITION BY run) AS top FROM z) SELECT run, seq, "left", round(CASE WHEN pk > 0 THEN dd / pk * CAST(1.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS height, round(CAST(top - pos AS DOUBLE) * CAST(0.55 AS DOUBLE), 6) AS lift FROM y')
def ridgeline(spark, d):
    return hist.ridgeline(histograms(spark, d)).select("run", "seq", "left", F.round("height", 6).alias("height"), F.round("lift", 6).alias("lift"))


@query(f"SELECT o_orderkey, {span_sql('o_orderkey * 37')} AS text FROM orders")
def fmt_duration(spark, d):
    return read(spark, d, "orders").select("o_orderkey", duration((F.col("o_orderkey") * 37).cast("double")).alias("text"))


@query(f"SELECT o_orderkey, {text_sql('o_totalprice')} AS text FROM orders")
def float_text(spark, d):
    return read(spark, d, "orders").select("o_orderkey", float_text_udf("o_totalprice").alias("text"))


@query("SELECT o_orderkey, regexp_replace(regexp_replace(CASE WHEN o_totalprice >= 100000 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) ELSE substr(CAST(o_totalprice AS VARCHAR), 1, 7) END, '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') AS text FROM orders")
def fmt_sig(spark, d):
    return read(spark, d, "orders").select("o_orderkey", significant_udf(F.col("o_totalprice"), 6).alias("text"))


WRITTEN: dict[tuple[str, str], str] = {}


def stepped_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histograms as snapshots with steps that rewind every fifth time."""
    rn = F.row_number().over(Window.partitionBy("run").orderBy("seq"))
    rows = quantities(spark, sf_dir).withColumn("rn", rn)
    return rows.select("run", "tag", "seq", (F.col("rn") - 3 * F.floor(F.col("rn") / 5)).cast("long").alias("step"), (F.col("seq") + 1.7e9).alias("wall"), F.lit(None).cast("double").alias("value"), F.struct("low", "high", "limits", "counts").cast(eventlog.BUCKETS).alias("buckets"))


def logged(spark: SparkSession, sf_dir: str) -> str:
    """The folder of event files of all points and histograms; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in WRITTEN:
        root = eventlog.shared_folder(spark, "logs")
        scalars = points(spark, sf_dir).withColumn("buckets", F.lit(None).cast(eventlog.BUCKETS))
        eventlog.write_events(scalars.unionByName(stepped_quantities(spark, sf_dir)), root)
        WRITTEN[key] = root
    return WRITTEN[key]


GATHERED: dict[str, Logs] = {}


def gathered(spark: SparkSession, root: str) -> Logs:
    """The logs below a folder that is written, decoded once a session."""
    if root not in GATHERED:
        GATHERED[root] = Logs(spark, root, now=NOW, gather=True)
    return GATHERED[root]


def logs_of(spark: SparkSession, sf_dir: str) -> Logs:
    return gathered(spark, logged(spark, sf_dir))


#: The points as event files hold them: values are floats of 32 bits.
PL = P.replace("ELSE value END AS value", "ELSE CAST(CAST(value AS FLOAT) AS DOUBLE) END AS value")
HL = PL + """, lq AS (SELECT 's' || l_suppkey AS run, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS seq, l_quantity AS q FROM lineitem),
hs AS (SELECT *, CAST(rn - 3 * (rn // 5) AS BIGINT) AS step, CAST(seq AS DOUBLE) + 1700000000.0 AS wall FROM (SELECT run, seq, min(q) AS lo, max(q) AS hi, row_number() OVER (PARTITION BY run ORDER BY seq) AS rn FROM lq GROUP BY run, seq)),
hp AS (SELECT *, CASE WHEN step <= lag(step) OVER (PARTITION BY run ORDER BY seq) THEN 1 ELSE 0 END AS p, coalesce(min(step) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) > step, true) AS is_live FROM hs),
hser AS (SELECT run, 'quantity' AS tag, count(*) AS n, CAST(sum(p) AS BIGINT) + 1 AS segments, arg_max(step, seq) AS last_step, min(wall) AS fw, max(wall) AS lw FROM hp GROUP BY run),
hb AS (SELECT run, seq, step, wall, k, CASE WHEN k = 0 THEN least(lo, CAST(10 AS DOUBLE)) ELSE CAST(10 * k AS DOUBLE) END AS "left", CASE WHEN k = 4 THEN greatest(hi, CAST(40 AS DOUBLE)) ELSE CAST(10 * k + 10 AS DOUBLE) END AS "right",
  CAST((SELECT count(*) FROM lq WHERE lq.run = hp.run AND lq.seq = hp.seq AND lq.q > 10 * k AND lq.q <= 10 * k + 10) AS DOUBLE) AS count FROM hp, range(5) t(k) WHERE is_live)
"""
ALL_SERIES = "SELECT run, tag, 'scalar' AS class, n AS count, mn AS min, mx AS max, round(mean, 7) AS mean, last_step AS step, segments FROM ser UNION ALL SELECT run, tag, 'histogram', n, NULL, NULL, NULL, last_step, segments FROM hser"


def flat_series(rows: DataFrame) -> DataFrame:
    return rows.select("run", "tag", "class", "count", "min", "max", F.round("mean", 7).alias("mean"), F.col("last.step").alias("step"), "segments")


@query(HL + f", a AS (SELECT run, series, points, restarts, step, fw, lw FROM r UNION ALL SELECT run, 1, n, segments - 1, last_step, fw, lw FROM hser) SELECT run, 'tfevents' AS backend, series, points, restarts, step, CASE WHEN lw > fw THEN {span_sql('CAST(round(lw - fw) AS BIGINT)')} ELSE '' END AS duration FROM a")
def log_runs(spark, d):
    return logs_of(spark, d).ls().drop("status")


@query(HL + ALL_SERIES)
def log_series(spark, d):
    return flat_series(logs_of(spark, d).series())


@query(HL + ALL_SERIES)
def log_stream_series(spark, d):
    """The same rows as log_series, kept by a stream."""
    state = eventlog.shared_folder(spark, "state")
    tail.follow_series(spark, logged(spark, d), f"{state}/series", f"{state}/checkpoint").awaitTermination()
    return flat_series(tail.followed_series(spark, f"{state}/series"))


@query(PL + "SELECT run, tag, step, round(wall, 3) AS wall, v AS value FROM live WHERE is_live")
def log_scalars(spark, d):
    return logs_of(spark, d).scalars().select("run", "tag", "step", F.round("wall", 3).alias("wall"), catalog.finite(F.col("value")).alias("value"))


@query(HL + """SELECT run, 'quantity' AS tag, step, wall, "left", "right", count FROM hb""")
def log_histograms(spark, d):
    return logs_of(spark, d).histograms()


@query(HL + """, c AS (SELECT min(run) AS run FROM hser), o AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS m FROM hp WHERE is_live AND run = (SELECT run FROM c)),
s AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS pos, count(*) OVER () AS n FROM o WHERE m <= 12 OR i IN (SELECT r * (m - 1) // 11 FROM range(12) t(r))),
z AS (SELECT hb.*, s.pos, s.n, count / greatest("right" - "left", 2.2250738585072014e-308) AS dd FROM hb JOIN s USING (seq) WHERE hb.run = (SELECT run FROM c))
SELECT run, 'quantity' AS tag, pos, "left", round(CASE WHEN max(dd) OVER (PARTITION BY seq) > 0 THEN dd / max(dd) OVER (PARTITION BY seq) * CAST(1.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 6) AS height, round(CAST(n - 1 - pos AS DOUBLE) * CAST(0.55 AS DOUBLE), 6) AS lift FROM z""")
def log_distribution(spark, d):
    return logs_of(spark, d).distribution().select("run", "tag", F.col("pos").cast("long").alias("pos"), "left", F.round("height", 6).alias("height"), F.round("lift", 6).alias("lift"))


@query(PL + "SELECT DISTINCT tag FROM ser WHERE run IN (SELECT run FROM ser WHERE tag = 'click' AND NOT isnan(last_value) AND last_value > 100) AND run NOT IN ('u1', 'u2') AND regexp_matches(tag, '(?s)c.*k')")
def log_scope_tags(spark, d):
    logs = logs_of(spark, d)
    return logs.tags("ck", logs.scope("click > 100", scopes.WorkingSet().select("u1", "u2").exclude()))


@query(PL + """, ch AS (SELECT run, tag FROM ser WHERE contains(tag, 'purch') ORDER BY run, tag LIMIT 16),
k AS (SELECT run, step, v AS tokens FROM live WHERE is_live AND tag = 'click'),
m AS (SELECT l.run, l.step, (SELECT max(step) FROM k WHERE k.run = l.run AND k.step <= l.step) AS a, (SELECT min(step) FROM k WHERE k.run = l.run AND k.step > l.step) AS b FROM live l JOIN ch USING (run, tag) WHERE is_live),
x AS (SELECT m.run, CASE WHEN m.a = m.step THEN ka.tokens ELSE ka.tokens + (kb.tokens - ka.tokens) * (m.step - m.a) / (m.b - m.a) END AS x, m.run IN (SELECT run FROM k) AS counted FROM m LEFT JOIN k ka ON ka.run = m.run AND ka.step = m.a LEFT JOIN k kb ON kb.run = m.run AND kb.step = m.b)
SELECT (SELECT count(DISTINCT run) FROM ch) AS runs, (SELECT count(*) FROM ser WHERE contains(tag, 'purch')) - (SELECT count(*) FROM ch) AS not_shown, CAST(0 AS BIGINT) AS dropped_records, CAST(0 AS BIGINT) AS dead_files,
  (SELECT count(DISTINCT run) FROM x WHERE NOT counted) AS without_counter, (SELECT count(*) FROM x WHERE counted AND x IS NULL) AS outside""")
def log_notes(spark, d):
    return logs_of(spark, d).notes("purch", "tokens", "click")


FOLLOWED: dict[tuple[str, str], str] = {}


def followed(spark: SparkSession, sf_dir: str) -> state.Followed:
    """What a stream kept of the event files while they grew, shrank and vanished; once a session.

    First poll: two fifths of each file (most end in a torn record), but every third one with all its events twice; and a
    second copy of all runs. Second: all of each, so the third ones have shrunk; the copies are gone.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in FOLLOWED:
        whole, root, kept = logged(spark, sf_dir), eventlog.shared_folder(spark, "growing"), eventlog.shared_folder(spark, "state")
        os.makedirs(kept, exist_ok=True)
        for share, again in ((0.4, 3), (1.0, 0)):
            eventlog.grow(spark, whole, root, share, again)
            if again:
                eventlog.grow(spark, whole, f"{root}/copy", 0.5)
            else:
                shutil.rmtree(f"{root}/copy", ignore_errors=True)
            state.follow_state(spark, root, f"{kept}/table", f"{kept}/checkpoint", f"{kept}/known.json").awaitTermination()
        FOLLOWED[key] = f"{kept}/table"
    return state.Followed(spark, FOLLOWED[key])


@query(HL + ALL_SERIES)
def log_state_series(spark, d):
    """The rows of log_series, kept by a stream while the files changed."""
    return flat_series(followed(spark, d).series())


@query(PL + f""", g AS (SELECT a.run, a.tag, a.seq, min(b.segment) AS ghost_of FROM live a JOIN live b ON a.run = b.run AND a.tag = b.tag AND b.p = 1 AND b.segment > a.segment AND b.step <= a.step WHERE NOT a.is_live GROUP BY ALL)
SELECT run, tag, step, round(wall, 3) AS wall, {V}, segment, is_live, ghost_of FROM live LEFT JOIN g USING (run, tag, seq)""")
def log_state_points(spark, d):
    """Live points and ghosts, kept by a stream that took back what later restarts outdid, while the files changed."""
    points = followed(spark, d).points().where("class = 'scalar'")
    return points.select("run", "tag", "step", F.round("wall", 3).alias("wall"), catalog.finite(F.col("value")).alias("value"), F.col("segment").cast("long").alias("segment"), "is_live", F.col("ghost_of").cast("long").alias("ghost_of"))


def other_logs(spark: SparkSession, sf_dir: str) -> str:
    """The folder of all points as logs of the three other formats, by user, each file with a record that cannot be read and a torn end."""
    key = (spark.sparkContext.applicationId, sf_dir, "others")
    if key not in WRITTEN:
        root = eventlog.shared_folder(spark, "others")
        user = F.substring("run", 2, 20).cast("long")
        backend = F.get(F.array(*(F.lit(b) for b in OTHERS)), (user % 3).cast("int"))
        otherlogs.write_logs(points(spark, sf_dir).withColumn("backend", backend), root, damaged=True)
        WRITTEN[key] = root
    return WRITTEN[key]


OTHERS = ("dvclive", "mlflow", "wandb")
BACKEND_SQL = "CASE CAST(substr(run, 2) AS BIGINT) % 3 WHEN 0 THEN 'dvclive' WHEN 1 THEN 'mlflow' ELSE 'wandb' END"


@query(P + f"SELECT run, {BACKEND_SQL} AS backend, tag, n AS count, n - nf AS non_finite, mn AS min, mx AS max, round(mean, 7) AS mean, last_step AS step, segments, CASE WHEN CAST(substr(run, 2) AS BIGINT) % 3 = 2 THEN last_wall ELSE floor(last_wall * 1000) / 1000 END AS last_wall FROM ser")
def formats_series(spark, d):
    """Two of the formats hold whole milliseconds."""
    logs = gathered(spark, other_logs(spark, d))
    rows = logs.series().join(logs.losses().select("run", "backend"), "run")
    return rows.select("run", "backend", "tag", "count", "non_finite", "min", "max", F.round("mean", 7).alias("mean"), F.col("last.step").alias("step"), "segments", "last_wall")


@query(P + f"SELECT run, {BACKEND_SQL} AS backend, CASE WHEN CAST(substr(run, 2) AS BIGINT) % 3 = 2 THEN 1 ELSE count(*) END AS dropped_records, 0 AS dead_files FROM ser GROUP BY run")
def formats_losses(spark, d):
    """Every file lost the one record that cannot be read; torn ends wait for their rest and are no loss."""
    return gathered(spark, other_logs(spark, d)).losses().select("run", "backend", "dropped_records", "dead_files")


@query(P + "SELECT run, tag, seq_of AS place, step, round(value, 7) AS value, is_live FROM (SELECT *, row_number() OVER (PARTITION BY run, tag ORDER BY seq) AS seq_of FROM live) WHERE tag = 'purchase'")
def formats_one_tag(spark, d):
    """One tag of all runs: of two formats only the files of that tag are opened."""
    logs = Logs(spark, other_logs(spark, d), now=NOW)
    rows = restarts.with_live(trainlog.points(logs.only(kind="scalar", tag="purchase")))
    place = F.row_number().over(Window.partitionBy("run", "tag").orderBy("seq"))
    return rows.select("run", "tag", place.alias("place"), "step", F.round("value", 7).alias("value"), "is_live")
