"""Series kept by a stream, while files grow, shrink, vanish and come back, against batch reads of the same bytes."""

import os
import random

import writers as w
from pyspark.sql import functions as F

from runlens.operators import catalog, restarts
from runlens.session import series_of
from runlens.sources import trainlog
from runlens.streaming import state


def values(df, *columns):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in df.select(*columns).collect())


def same(spark, root, table):
    held, logs = state.Followed(spark, table), trainlog.load(spark, root)
    columns = ("run", "tag", "class", "count", "non_finite", "min", "max", "mean", "segments", "first.step", F.col("last.step").alias("last"), "last.value", "first_wall", "last_wall")
    assert values(held.series(), *columns) == values(series_of(logs), *columns)
    flagged = restarts.with_live(trainlog.points(logs))
    dead = restarts.ghosts(flagged)
    points = held.points().where("class = 'scalar'")
    columns = ("run", "tag", "step", "wall", "value", "segment")
    assert values(points.where("is_live"), *columns) == values(flagged.where("is_live"), *columns)
    assert values(points.where("not is_live"), *columns, "ghost_of") == values(dead, *columns, "ghost_of")
    return held


def test_growing_shrinking_and_vanishing_files_equal_a_batch_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BLOCK", 4)
    rng, root = random.Random(2), str(tmp_path / "logs")
    where = str(tmp_path / "table"), str(tmp_path / "checkpoint"), str(tmp_path / "known.json")

    def body(n):
        out, step = [w.events_file()], {"loss": 0, "acc": 0}
        for k in range(n):
            tag = rng.choice(("loss", "acc"))
            step[tag] = rng.randrange(max(1, step[tag])) if rng.random() < 0.2 else step[tag] + 1
            out.append(w.record(w.event(step[tag], 1.7e9 + k, w.scalar(tag, float("nan") if rng.random() < 0.1 else rng.random()))))
        return b"".join(out)

    def put(name, data):
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)

    def poll():
        state.follow_state(spark, root, *where).awaitTermination(120)
        return same(spark, root, where[0])

    whole = {f"{r}/events.out.tfevents.{k}": body(40) for r in "abc" for k in range(2)}
    for name, data in whole.items():
        put(name, data[: len(data) // 2])  # torn records
    put("d/dvclive/plots/metrics/loss.tsv", b"step\tloss\n0\t1.5\n1\t1.0\n")
    poll()
    for name, data in whole.items():
        if not name.startswith("c"):
            put(name, data)
    put("a/events.out.tfevents.0.5", body(9))  # between files that were read before
    put("d/dvclive/plots/metrics/loss.tsv", b"step\tloss\n0\t1.5\n1\t1.0\n0\t3.0\n")
    poll()
    os.remove(f"{root}/a/events.out.tfevents.1")
    put("b/events.out.tfevents.0", w.events_file(w.event(3, 1.0, w.scalar("other", 1.0))))  # shrank, without its former tags
    put("d/dvclive/plots/metrics/loss.tsv", b"step\tloss\n7\t9.0\n")
    os.remove(f"{root}/c/events.out.tfevents.0")
    os.remove(f"{root}/c/events.out.tfevents.1")
    held = poll()
    assert not held.series().where("run = 'c'").count()
    put("c/events.out.tfevents.0", whole["c/events.out.tfevents.0"])  # it comes back
    held = poll()
    assert held.series().where("run = 'c'").count() == 2
    last = held.rows.agg(F.max("batch")).first()[0]
    assert [r.run for r in held.rows.where((F.col("batch") == last) & (F.col("what") != "file")).select("run").distinct().collect()] == ["c"]  # a poll tells touched series only


def test_summaries_merge_as_if_read_at_once():
    import numpy as np

    rng = np.random.default_rng(1)
    value = np.where(rng.random(50) < 0.2, np.nan, rng.random(50))
    pos, step, wall = np.arange(50), np.arange(50), rng.random(50)
    for cut in (1, 20, 49):
        a, b = (state.part_of(pos[s], step[s], wall[s], value[s], None) for s in (slice(0, cut), slice(cut, 50)))
        got, want = state.merged(a, b), state.part_of(pos, step, wall, value, None)
        assert all(got[c] == want[c] or abs(got[c] - want[c]) < 1e-9 or got[c] != got[c] for c in state.PART_NAMES if c != "class")


def test_catalog_of_nothing(spark):
    assert catalog.series(spark.createDataFrame([], "run string, tag string, seq long, step long, wall double, value double")).count() == 0


def test_lists_and_arrays_are_summed_up_alike(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    value = np.where(rng.random(40) < 0.2, np.nan, rng.random(40))
    columns = np.arange(40), np.arange(40) * 2, np.where(rng.random(40) < 0.2, 0, rng.random(40)), value
    few = state.part_of(*(c.tolist() for c in columns), "scalar")
    monkeypatch.setattr(state, "FEW", 4)
    many = state.part_of(*(c.tolist() for c in columns), "scalar")
    assert all(few[c] == many[c] or abs(few[c] - many[c]) < 1e-12 for c in state.PART_NAMES if c not in ("class", "first_value", "last_value")) and few["class"] == "scalar"
    assert state.part_of([1], [1], [0.0], [float("nan")], None)["mean"] is None
