"""Reads of some runs or tags only, of one moment of a growing folder, and of series that are held."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F
from test_sources import put, root  # noqa: F401  (a fixture)

from runlens.__main__ import main
from runlens.plans.held import Held
from runlens.session import Logs
from runlens.sources import trainlog
from tests import writers as w


def opened(root, **only):
    reader = trainlog.BatchReader(str(root), only=only)
    return sorted(os.path.relpath(f.path, root) for p in reader.partitions() for f in getattr(p, "files", []))


def test_files_without_wanted_rows_stay_unopened(root):  # noqa: F811
    assert len(opened(root)) == 7
    assert opened(root, run=["warm"]) == ["mlruns/0/x/metrics/val/acc", "mlruns/0/x/params/lr"]
    assert opened(root, run=["a", "b"], backend=["dvclive"]) == ["b/dvclive/params.yaml", "b/dvclive/plots/metrics/train/loss.tsv"]
    assert opened(root, kind=["hparam"], run=["b"]) == ["b/dvclive/params.yaml"]
    assert opened(root, kind=["scalar"], tag=["val/acc"]) == ["a/events.out.tfevents.1", "a/events.out.tfevents.2", "mlruns/0/x/metrics/val/acc", "offline/run-1.wandb"]
    assert opened(root, run=["none"]) == []


@pytest.mark.parametrize("only", [{"run": ["a"]}, {"run": ["b", "warm"], "kind": ["scalar"]}, {"tag": ["loss"], "kind": ["scalar"]}, {"kind": ["run"]}, {"tag": ["finished"]}, {"backend": ["mlflow"]}, {"tag": [""]}, {"kind": ["hparam"], "tag": ["lr"]}, {"run": ["none"]}, {"kind": ["scalar", "histogram"], "run": ["a", "offline"]}])
def test_pruned_reads_equal_a_filter_of_all_rows(spark, root, only):  # noqa: F811
    want = trainlog.load(spark, str(root))
    for column, values in only.items():
        want = want.where(F.col(column).isin(values))
    assert sorted(map(repr, trainlog.load(spark, str(root), only=only).collect())) == sorted(map(repr, want.collect()))


def test_one_run_of_many_is_one_task(spark, tmp_path):
    for k in range(40):
        put(tmp_path / f"r{k}/events.out.tfevents.1", w.events_file(*(w.event(i, 1.7e9 + i, w.scalar("loss", i)) for i in range(3))))
    logs = Logs(spark, str(tmp_path))
    assert logs.rows.rdd.getNumPartitions() == trainlog.PARTITIONS
    assert logs.only(run="r7").rdd.getNumPartitions() == 1
    assert [tuple(r)[:3] for r in logs.summary("r7").collect()] == [("loss", "scalar", 3)]
    with pytest.raises(ValueError, match="r12"):
        logs.summary("none")


def test_tables_of_one_moment_agree_while_files_grow(spark, root):  # noqa: F811
    logs = Logs(spark, str(root))
    before = {name: sorted(map(repr, getattr(logs, name)().collect())) for name in ("series", "losses", "scalars", "snapshots")}
    with open(root / "a/events.out.tfevents.2", "ab") as f:
        f.write(w.record(w.event(1, 1.7e9 + 20, w.scalar("loss", 106))))
    with open(root / "b/dvclive/plots/metrics/train/loss.tsv", "a") as f:
        f.write("3.5\n3\t2.5\n")
    with open(root / "offline/run-1.wandb", "ab") as f:
        f.write(b"torn")
    put(root / "0/events.out.tfevents.1", w.events_file(w.event(0, 1.0, w.scalar("x", 1))))
    assert {name: sorted(map(repr, getattr(logs, name)().collect())) for name in before} == before
    later = Logs(spark, str(root))
    assert later.points.count() == logs.points.count() + 4 and "0" in {r.run for r in later.runs().collect()}
    logs.close()
    assert not os.path.exists(logs.frontier) and os.path.exists(later.frontier)


def test_a_torn_record_at_the_frontier_is_not_there_yet(spark, tmp_path):
    whole = w.events_file(*(w.event(k, 1.7e9 + k, w.scalar("loss", k)) for k in range(6)))
    gen = random.Random(5)
    for cut in [0, len(whole), *(gen.randrange(len(whole)) for _ in range(4))]:
        put(tmp_path / f"{cut}/events.out.tfevents.1", whole[:cut])
        logs = Logs(spark, str(tmp_path / str(cut)))
        put(tmp_path / f"{cut}/events.out.tfevents.1", whole)
        at, ends = 0, []
        while at < len(whole):
            at += 16 + struct.unpack_from("<Q", whole, at)[0]
            ends.append(at)
        assert logs.points.count() == max(0, sum(e <= cut for e in ends) - 1)  # the first record is no event


def test_export_keeps_to_the_filter(spark, root, capsys):  # noqa: F811
    logs = Logs(spark, str(root))
    assert [r.run for r in logs.export().collect()] == ["a", "b", "offline", "warm"]
    chosen = logs.export(logs.scope("lr > 0.01"))
    assert [r.run for r in chosen.collect()] == ["a", "warm"] and chosen.columns == ["run", "lr", "loss", "val/acc"]
    assert main(["export", str(root), "--format", "csv", "--filter", "lr > 0.05"], spark) == 0
    assert capsys.readouterr().out == "run,lr,loss\na,0.1,105\n"


def test_held_series_are_read_once(spark, root):  # noqa: F811
    logs = Logs(spark, str(root))
    first = logs.held_points("a", "loss")
    want = sorted(map(tuple, first.collect()))
    os.remove(root / "a/events.out.tfevents.2")
    os.remove(root / "a/events.out.tfevents.1")
    assert sorted(map(tuple, logs.held_points("a", "loss").collect())) == want and len(want) == 8
    assert "InMemoryTableScan" in logs.held_points("a", "loss").where("is_live")._jdf.queryExecution().executedPlan().toString()
    assert logs.points.where("run = 'a'").count() == 0
    logs.held.clear()
    assert not first.is_cached or not first.storageLevel.useMemory


def test_histograms_are_held_too(spark, root):  # noqa: F811
    logs = Logs(spark, str(root))
    assert sorted(map(repr, logs.held_snapshots("a", "h").collect())) == sorted(map(repr, logs.snapshots().where("run = 'a' and tag = 'h'").collect()))
    logs.close()


def test_the_least_recently_touched_series_goes(spark):
    held, made = Held({"scalar": 2, "histogram": 1}), []

    def of(kind, key):
        return held.get(kind, key, lambda: made.append(key) or spark.range(3).withColumn("key", F.lit(f"{kind} {key}")))

    a, b = of("scalar", "a"), of("scalar", "b")
    assert of("scalar", "a") is a
    c = of("scalar", "c")  # b is the one not touched for longest
    h = of("histogram", "a")  # counted by itself
    assert made == ["a", "b", "c", "a"]
    assert a.storageLevel.useMemory and c.storageLevel.useMemory and h.storageLevel.useMemory and not b.storageLevel.useMemory
    of("scalar", "b")
    assert made[-1] == "b" and not a.storageLevel.useMemory
    held.clear()
    assert not any(x.storageLevel.useMemory for x in (b, c, h))


def test_gathered_logs_decode_once(spark, root):  # noqa: F811
    plain, logs = Logs(spark, str(root)), Logs(spark, str(root), gather=True)
    names = ("series", "losses", "scalars", "snapshots", "tags")
    want = {name: sorted(map(repr, getattr(plain, name)().collect())) for name in names}
    assert {name: sorted(map(repr, getattr(logs, name)().collect())) for name in names} == want
    assert sorted(map(repr, logs.hparams.collect())) == sorted(map(repr, plain.hparams.collect()))
    for name in ("a/events.out.tfevents.1", "a/events.out.tfevents.2"):
        os.remove(root / name)
    assert sorted(map(repr, logs.series().collect())) == want["series"] and not logs.snapshots().count()
    logs.close()
    assert not os.path.exists(logs.gathered)
