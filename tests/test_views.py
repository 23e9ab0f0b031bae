"""Scopes, exports, distributions, titles, crosshair and the series that a stream keeps."""

import os

import pytest
from pyspark.sql import functions as F

import writers as w
from runlens.__main__ import main
from runlens.operators import axes
from runlens.plans.scopes import WorkingSet
from runlens.session import Logs
from runlens.sources import eventlog
from runlens.streaming.tail import follow_series, followed_series


def flat(df):
    rows = df.select("run", "tag", "class", "count", "non_finite", "min", "max", F.round("mean", 9), F.round("variance", 6), "first", "last", "segments", "preempted", "first_wall", "last_wall")
    return sorted(repr(tuple(r)) for r in rows.collect())


@pytest.fixture
def folder(tmp_path):
    """Runs a (loss restarts, histograms restart), b (no counter, one lost record) and c (a histogram too)."""
    hist = lambda step, *counts: w.event(step, 50.0 + step, w.histogram("w", 0.0, 3.0, [1.0, 2.0, 3.0], list(counts)))
    loss = lambda step, v: w.event(step, 10.0 + step, w.scalar("loss", v))
    held = {
        "a": [loss(0, 1), loss(1, 2), loss(2, 3), loss(1, 8), loss(5, 9), hist(0, 1, 2, 3), hist(1, 4, 4, 4), hist(1, 0, 2, 0), *(w.event(k, 1.0, w.scalar("tokens", 100 * k)) for k in (0, 2))],
        "b": [loss(0, 4), b"\x07"],
        "c": [hist(0, 1, 1, 1), w.event(0, 1.0, w.scalar("acc", 0.5))],
    }
    for run, events in held.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "events.tfevents.1").write_bytes(w.events_file(*events))
    return tmp_path


def test_exports_hold_what_is_live_and_in_scope(spark, folder):
    logs = Logs(spark, str(folder))
    assert [(r.run, r.step, r.value) for r in logs.scalars(tag="loss").orderBy("run", "step").collect()] == [("a", 0, 1.0), ("a", 1, 8.0), ("a", 5, 9.0), ("b", 0, 4.0)]
    only = logs.scope("", WorkingSet().select("a").exclude())
    assert sorted(r.run for r in only.collect()) == ["b", "c"]
    assert {r.run for r in logs.scalars(only).collect()} == {"b", "c"}
    assert [(r.step, r.left, r.right, r["count"]) for r in logs.histograms().where("run = 'a'").orderBy("step", "left").collect()] == [(0, 0.0, 1.0, 1.0), (0, 1.0, 2.0, 2.0), (0, 2.0, 3.0, 3.0), (1, 0.0, 1.0, 0.0), (1, 1.0, 2.0, 2.0), (1, 2.0, 3.0, 0.0)]
    assert [r.tag for r in logs.tags().collect()] == ["acc", "loss", "tokens"] and [r.tag for r in logs.tags("ls").collect()] == ["loss"] and logs.tags("LS").isEmpty()
    assert [r.tag for r in logs.tags(kind="histogram", runs=only).collect()] == ["w"]


def test_distribution_is_of_the_series_at_the_cursor_or_the_first(spark, folder):
    logs = Logs(spark, str(folder))
    assert {(r.run, r.tag) for r in logs.distribution().collect()} == {("a", "w")}
    assert {r.run for r in logs.distribution("c").collect()} == {"c"}
    assert {r.run for r in logs.distribution("b", "none").collect()} == {"a"}
    tall = logs.distribution().groupBy("pos").agg(F.max("height").alias("h")).orderBy("pos").collect()
    assert [(r.pos, r.h) for r in tall] == [(0, 1.6), (1, 1.6)]


def test_titles_tell_what_is_not_drawn(spark, folder):
    logs = Logs(spark, str(folder))
    assert logs.title("loss") == "loss · 2 runs · 1 records lost"
    # the counter reaches from step 0 to 2: of a's live points only that at step 5 lies beyond
    assert logs.title("loss", "tokens", "tokens", live="live") == "loss · 2 runs · 1 records lost · 1 runs lack a token counter · 1 pts outside counter · live"
    assert logs.notes("none").first().asDict() == {"runs": 0, "not_shown": 0, "dropped_records": 1, "dead_files": 0, "without_counter": 0, "outside": 0}


def test_charts_with_ghosts_log_and_window(spark, folder):
    logs = Logs(spark, str(folder))
    drawn = logs.show("loss", ghosts=True, smooth=0.5).where("run = 'a'").collect()
    assert [(r.step, r.is_live, r.smoothed is None) for r in drawn] == [(0, True, False), (1, False, True), (2, False, True), (1, True, False), (5, True, False)]
    assert [(r.x, round(r.log_value, 6)) for r in logs.show("loss", log=True, window=(1.0, 9.0)).collect()] == [(1.0, 0.90309), (5.0, 0.954243)]
    assert [(r.run, r.trend) for r in logs.runs_view().orderBy("run").collect()] == [("a", "▁▁▁▂▂▃▃▃▇▇██"), ("b", ""), ("c", "")]


def test_crosshair_steps_and_window(spark, folder):
    drawn = axes.step_axis(Logs(spark, str(folder)).show("loss").drop("x")).where("run = 'a'")
    at = lambda x, by: axes.stepped(drawn, x, by).first().x
    assert [at(None, 1), at(5.0, -1), at(1.0, -1), at(0.0, -1), at(5.0, 1), at(0.5, 1), at(99.0, -1)] == [5.0, 1.0, 0.0, 0.0, 5.0, 5.0, 1.0]
    assert axes.panned((2.0, 4.0), 1.0) == (1.0, 3.0) and axes.panned((2.0, 4.0), 5.0) == (3.0, 5.0) and axes.panned((2.0, 4.0), 3.0) == (2.0, 4.0)
    zoomed = drawn.withColumn("smoothed", F.lit(0.5))
    assert axes.zoom(zoomed, 0.0, 5.0).first()[2:] == (0.5, 9.0, 3) and axes.zoom(zoomed.withColumn("smoothed", F.lit(-1.0)), 0.0, 5.0, log=True).isEmpty()


def test_working_set():
    start = WorkingSet()
    assert start.keep() == start and start.exclude() == start
    assert start.select("a", "b").keep() == WorkingSet(kept=frozenset("ab")) and start.keep("c").kept == {"c"}
    assert start.select("a").exclude().exclude("b").gone == {"a", "b"} and start.exclude("a").reset() == start


def test_stream_keeps_series_as_a_batch_read_gives_them(spark, folder, tmp_path_factory):
    state = str(tmp_path_factory.mktemp("state"))

    def poll():
        follow_series(spark, str(folder), f"{state}/series", f"{state}/checkpoint").awaitTermination()
        assert flat(followed_series(spark, f"{state}/series")) == flat(Logs(spark, str(folder)).series())

    poll()
    with open(folder / "a/events.tfevents.1", "ab") as f:  # a restart across polls, a NaN, a new tag
        f.write(b"".join(w.record(w.event(s, 20.0 + s, w.scalar(t, v))) for s, t, v in ((5, "loss", 0.25), (6, "loss", float("nan")), (0, "new", 3))))
    poll()
    (folder / "d").mkdir()
    (folder / "d/events.tfevents.1").write_bytes(w.events_file(w.event(0, 1.0, w.scalar("loss", float("nan")))))
    poll()
    with open(folder / "d/events.tfevents.1", "ab") as f:
        f.write(w.record(w.event(1, 2.0, w.scalar("loss", 7.0))))
    poll()
    assert len([n for n in os.listdir(f"{state}/series") if n.startswith("batch-")]) == 2


def test_written_events_are_read_back(spark, tmp_path):
    rows = [("r", "x", 2, -1, 5.0, 0.5, None), ("r", "x", 1, 0, 0.0, None, None), ("s", "h", 0, 3, 2.0, None, (0.0, 9.0, [1.0, 2.0], [3.0, 4.0]))]
    made = spark.createDataFrame(rows, f"run string, tag string, seq long, step long, wall double, value double, buckets {eventlog.BUCKETS}")
    assert eventlog.write_events(made, str(tmp_path / "logs")) == 3
    logs = Logs(spark, str(tmp_path / "logs"))
    assert [(r.step, repr(r.value)) for r in logs.points.orderBy("seq").collect()] == [(0, "nan"), (-1, "0.5")]
    assert [tuple(r) for r in logs.histograms().orderBy("left").collect()] == [("s", "h", 3, 2.0, 0.0, 1.0, 3.0), ("s", "h", 3, 2.0, 1.0, 9.0, 4.0)]
    assert eventlog.write_events(made.limit(0), str(tmp_path / "none")) == 0


def test_views_on_the_command_line(spark, folder, capsys):
    said = {}
    for view in (["scalars", "loss", "--filter", "name == b", "--format", "csv"], ["histograms", "--format", "csv"], ["tags"], ["show", "loss"], ["distribution", "--format", "json"]):
        assert main([view[0], str(folder), *view[1:]], spark) == 0
        said[view[0]] = capsys.readouterr().out
    assert said["scalars"] == "run,tag,step,wall,value\nb,loss,0,10,4\n" and said["histograms"].startswith("run,tag,step,wall,left,right,count\n")
    assert said["tags"].split() == ["tag", "acc", "loss", "tokens"] and said["show"].startswith("loss · 2 runs · 1 records lost\n")
