import math
import random

import pytest
from pyspark.sql import functions as F

from runlens.functions.fmt import duration, float_text, significant
from runlens.operators import axes, catalog, restarts
from runlens.plans import predicate, tables
from runlens.sources import sinks

POINT = "run string, tag string, seq long, step long, wall double, value double"


def log(spark, series: dict):
    rows = [(run, tag, k, s, 1.7e9 + 10 * k, float(v)) for (run, tag), points in series.items() for k, (s, v) in enumerate(points)]
    return spark.createDataFrame(rows, POINT)


def model(steps):
    """Live points, and for each restart its cut and ghosts, by a stack."""
    live, cuts, ghosts, segment = [], {}, {}, 0
    for k, s in enumerate(steps):
        if k and s <= steps[k - 1]:
            segment += 1
            for i in [i for i in live if steps[i] >= s]:
                ghosts[i] = segment
            live = [i for i in live if steps[i] < s]
            cuts[segment] = len(live)
        live.append(k)
    return set(live), cuts, ghosts


@pytest.mark.parametrize("bits", [16, 2, 0])
def test_live_ghosts_and_cuts_equal_a_stack(spark, monkeypatch, bits):
    monkeypatch.setattr(catalog, "CHUNK_BITS", bits)
    rng = random.Random(3)
    cases = {f"r{k}": [rng.randrange(12) for _ in range(rng.randrange(1, 30))] for k in range(60)}
    flagged = restarts.with_live(log(spark, {(r, "t"): [(s, s) for s in steps] for r, steps in cases.items()})).cache()
    live, ghosts, cuts = {}, {}, {}
    for r in flagged.where("is_live").collect():
        live.setdefault(r.run, set()).add(r.seq)
    for r in restarts.ghosts(flagged).collect():
        ghosts.setdefault(r.run, {})[r.seq] = r.ghost_of
    for r in restarts.cuts(flagged).collect():
        cuts.setdefault(r.run, {})[r.segment] = r.cut
    for r, steps in cases.items():
        assert (live[r], cuts.get(r, {}), ghosts.get(r, {})) == model(steps)


@pytest.mark.parametrize("bits", [3, 0])
def test_chunks_change_no_segment_and_no_series(spark, monkeypatch, bits):
    rng = random.Random(8)
    cases = {(f"r{k}", t): [(rng.randrange(30) if rng.random() < 0.3 else n, math.nan if rng.random() < 0.2 else rng.random() + 1e6) for n in range(rng.randrange(1, 60))] for k in range(20) for t in "ab"}
    points = log(spark, cases).withColumn("seq", F.col("seq") * F.col("seq"))  # chunks of different sizes
    held = points.withColumn("class", F.when(F.col("seq") > 9, F.concat("tag", F.col("step").cast("string"))))

    def rounded(df):
        return sorted(repr([round(x, 4) if isinstance(x, float) else x for x in r]) for r in df.collect())

    def all_of():
        return [rounded(catalog.segmented(points)), rounded(catalog.segments(points).drop("first", "last")), rounded(catalog.segments(points).select("run", "tag", "segment", "first.step", "last.seq")), rounded(catalog.series(held, "class").drop("first", "last")), rounded(catalog.series(points).select("run", "tag", "first.step", "last.wall"))]

    whole = all_of()
    monkeypatch.setattr(catalog, "CHUNK_BITS", bits)
    assert all_of() == whole


def test_one_series_of_all_points_spreads_over_tasks(spark):
    points = spark.range(1 << 20).selectExpr("'r' run", "'t' tag", "id seq", "id % 300000 step", "double(id) wall", "double(id) value")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = restarts.with_live(points)
        sizes = [r.n for r in rows.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("*").alias("n"), F.max("is_live")).collect()]
        assert sum(sizes) == 1 << 20 and max(sizes) <= 4 << catalog.CHUNK_BITS and len(sizes) > 6
        assert rows.where("is_live").count() == (1 << 20) % 300000
        assert catalog.series(points).first().segments == 4
        assert restarts.ghosts(rows).groupBy("ghost_of").count().orderBy("ghost_of").collect() == [(1, 300000), (2, 300000), (3, 300000)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equal_step_restarts_and_nan_is_a_gap(spark):
    s = {(r.run, r.tag): r for r in catalog.series(log(spark, {("a", "x"): [(5, 1), (5, 2)], ("b", "x"): [(0, 4), (1, math.nan), (2, 2)]})).collect()}
    assert s["a", "x"].segments == 2 and s["a", "x"].preempted
    b = s["b", "x"]
    assert (b["count"], b.non_finite, b.min, b.max, b.mean) == (3, 1, 2.0, 4.0, 3.0)


def test_preempted_at_and_moments_merge(spark):
    points = log(spark, {("a", "x"): [(k, k) for k in range(11)] + [(k, 100 + k) for k in range(8, 13)]})
    parts = catalog.segments(points)
    assert [r.preempted_at for r in parts.orderBy("segment").collect()] == [8, None]
    m, s = catalog.merged_moments(parts, "run", "tag").first(), catalog.series(points).first()
    assert m.mean == pytest.approx(s["mean"]) and m.m2 / m.n_finite == pytest.approx(s.variance)


def test_runs_table_golden(spark):
    adam = [(k, 8 / (k + 1)) for k in range(10)]
    points = log(spark, {("adam", "train/loss"): adam, ("adam", "train/acc"): [(k, 0.1 * k) for k in range(10)], ("sgd", "train/loss"): [(k, 9 - k) for k in range(6)] + [(k, 6.5 - k) for k in range(4, 8)]})
    s = catalog.series(points)
    got = [tuple(r) for r in tables.runs_table(catalog.runs(s, now=1.7e9 + 90, window=60.0)).orderBy("run").collect()]
    assert got == [("adam", "active", 2, 20, 0, 9, "90s"), ("sgd", "active", 1, 10, 1, 7, "90s")]
    one = tables.run_summary(s, "sgd").first()
    assert (one["count"], one["min"], one["max"], one["mean"], one["last"], one["segments"]) == (10, -0.5, 9.0, pytest.approx(4.3), -0.5, 2)


def test_tokens_axis(spark):
    points = log(spark, {("a", "loss"): [(k, 10 - k) for k in range(10)], ("b", "loss"): [(0, 1.0)]})
    counter = spark.createDataFrame([("a", s, 1024.0 * s) for s in (0, 2, 4, 6)], "run string, step long, tokens double")
    x = {(r.run, r.step): r.x for r in axes.tokens_axis(points, counter).collect()}
    assert [x["a", k] for k in range(10)] == [1024.0 * k if k <= 6 else None for k in range(10)] and x["b", 0] is None


def test_ewma_is_debiased(spark):
    values, level, weight, want = [4.0, 2.0, math.nan, 8.0], 0.0, 1.0, []
    for v in values:
        if v == v:
            level, weight = 0.9 * level + 0.1 * v, weight * 0.9
        want.append(level / (1 - weight) if v == v else None)
    got = [r.smoothed for r in axes.ewma(log(spark, {("a", "x"): list(enumerate(values))}), 0.9).orderBy("seq").collect()]
    assert got == [None if w is None else pytest.approx(w) for w in want]


RUNS = "run string, status string"


@pytest.mark.parametrize(
    ("text", "passes"),
    [("lr < 0.01", True), ("lr == 0.003", True), ("lr == 3e-3", True), ("optimizer == adam", True), ("optimizer != sgd", True), ("amsgrad == true", True), ("train/loss <= 0.25", True), ("loss > 0.3", False), ("status == active", True), ("name ~ adam", True), ("absent != 1", False), ("not absent != 1", True), ("optimizer > 1", False), ("lr == 0.003 and (optimizer == sgd or loss < 1)", True), ("'lr' ~ '0.00'", True), ("bad", False), ("amsgrad == 1", False), ("exp/adam", True)],
)
def test_predicates(spark, text, passes):
    runs = spark.createDataFrame([("exp/adam-1", "active")], RUNS)
    params = spark.createDataFrame([("exp/adam-1", "lr", 0.003, None, None), ("exp/adam-1", "optimizer", None, "adam", None), ("exp/adam-1", "amsgrad", None, None, True)], "run string, key string, num double, str string, bool boolean")
    series = catalog.series(log(spark, {("exp/adam-1", "train/loss"): [(0, 1.0), (1, 0.25)]}))
    assert predicate.filter_runs(runs, params, series, text).count() == passes


@pytest.mark.parametrize(("text", "says"), [("a = 1", "=="), ("a ! 1", "!="), ("a == 'x", "closed"), ("(a == 1", "missing"), ("a == 1 b", "unexpected"), ("== 1", "field"), ("a", "operator"), ("a ==", "value"), ("inf == 1", "field")])
def test_predicate_errors(text, says):
    with pytest.raises(ValueError, match=says):
        predicate.parse(text)


def test_number_texts():
    assert [float_text(v) for v in (3.0, 1e-7, 0.9000000357627869, 1e21, math.nan, -math.inf, -0.5)] == ["3", "0.0000001", "0.9000000357627869", "1000000000000000000000", "NaN", "-inf", "-0.5"]
    assert [significant(v, n) for v, n in ((0.9999999, 5), (487424.75, 5), (-0.0001234567, 4), (1.23456789e-7, 4))] == ["0.99999", "487424", "-0.0001234", "0.0000001234"]


def test_durations(spark):
    df = spark.createDataFrame([(45.0,), (245.0,), (7890.0,), (4712400.0,), (-1.0,), (math.nan,)], "s double")
    assert [r[0] for r in df.select(duration(F.col("s"))).collect()] == ["45s", "4m05s", "2h11m", "54d13h", "", ""]


def test_sinks(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("b,c", 22, math.nan)], "run string, n long, v double")
    assert [r.value for r in sinks.json_lines(df).collect()] == ['{"run":"a","n":1,"v":0.5}', '{"run":"b,c","n":22,"v":null}']
    assert [tuple(r) for r in sinks.csv_text(df).collect()] == [("a", "1", "0.5"), ("b,c", "22", "NaN")]
    assert sinks.render([["a", 1, None], ["bb", 22, 0.5]], ["run", "n", "v"]) == "run   n    v\na     1\nbb   22  0.5"


@pytest.mark.parametrize("text", ["or == 1", "and == 1", "lr == not", "not"])
def test_keywords_are_no_names_or_values(text):
    with pytest.raises(ValueError):
        predicate.parse(text)
    assert predicate.parse("'or' == 'not'").field == "or"


@pytest.mark.parametrize("factor", [0.0, 0.01, 0.6, 0.999])
def test_ewma_in_blocks_equals_the_recurrence(factor):
    import numpy as np

    from runlens.operators import axes

    values = np.random.default_rng(1).normal(3, 50, 5000)
    values[::97] = np.nan
    held, plain = axes.Average(factor), []
    got = np.concatenate([held.follow(("r", "t"), part) for part in np.split(values, [7, 1000, 1001, 3333])])
    level, weight = 0.0, 1.0
    for v in values.tolist():
        if v == v:
            level, weight = factor * level + (1 - factor) * v, weight * factor
        plain.append(level / (1 - weight) if v == v else v)
    assert np.allclose(got, plain, rtol=1e-9, atol=1e-9, equal_nan=True) and held.follow(("r", "u"), values[1:2])[0] == pytest.approx(values[1])
