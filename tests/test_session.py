import json
from pathlib import Path

import pytest

import writers as w
from runlens.__main__ import main
from runlens.session import Logs
from runlens.sources import store, trainlog
from runlens.streaming.tail import watch
from test_sources import root  # noqa: F401


def test_tables_of_a_mixed_folder(spark, root):  # noqa: F811
    logs = Logs(spark, str(root), now=0.0)
    rows = {r.run: tuple(r)[1:] for r in logs.ls().collect()}
    assert rows == {"a": ("tfevents", "active", 2, 13, 1, 5, "15s"), "b": ("dvclive", "active", 1, 2, 0, 1, ""), "offline": ("wandb", "done", 1, 2, 0, 1, rows["offline"][-1]), "warm": ("mlflow", "active", 1, 2, 0, 1, "1s")}
    assert [r.run for r in logs.ls("lr > 0.01").collect()] == ["a", "warm"] and [r.run for r in logs.ls("arm").collect()] == ["warm"]
    assert [(r.tag, r["class"], r["count"], r.segments) for r in logs.summary("a").collect()] == [("h", "histogram", 5, 1), ("loss", "scalar", 8, 2)]
    assert logs.export().columns[0] == "run" and "loss" in logs.export().columns and "h" not in logs.export().columns
    for axis in ("step", "wall", "relative"):
        assert {r.run for r in logs.show("loss", axis).collect()} == {"a", "b", "offline"}
    drawn = logs.show("loss", smooth=0.5).where("run = 'b'").collect()
    assert [(r.x, r.value, round(r.smoothed, 9)) for r in drawn] == [(0, 6.25, 6.25), (1, 4.5, round((0.5 * 3.125 + 2.25) / 0.75, 9))]
    for call in (lambda: logs.summary("none"), lambda: logs.show("none")):
        with pytest.raises(ValueError, match="none"):
            call()


def test_losses_and_runs_without_series(spark, tmp_path):
    (tmp_path / "r").mkdir()
    good = w.record(w.event(0, 1.0, w.scalar("a", 1)))
    (tmp_path / "r/events.tfevents.1").write_bytes(good + w.record(b"\x07") + good)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/events.tfevents.1").write_bytes(b"\0" * 40)
    logs = Logs(spark, str(tmp_path), now=9e12)
    assert {r.run: (r.dropped_records, r.dead_files) for r in logs.losses().collect()} == {"r": (1, 0), "s": (0, 1)}
    assert {r.run: (r.status, r.points) for r in logs.ls().collect()} == {"r": ("idle", 2), "s": ("idle", 0)}


def test_command_line(spark, root, capsys):  # noqa: F811
    assert main(["ls", str(root)], spark) == 0 and capsys.readouterr().out.splitlines()[0].split()[0] == "run"
    assert main(["summary", str(root), "a", "--format", "json"], spark) == 0 and json.loads(capsys.readouterr().out)[1]["segments"] == 2
    assert main(["export", str(root), "--format", "csv"], spark) == 0 and capsys.readouterr().out.startswith("run,")
    assert main(["summary", str(root), "zz"], spark) == 1 and "zz" in capsys.readouterr().err


def test_tokens_axis_drops_points_outside_the_counter(spark, tmp_path):
    (tmp_path / "r").mkdir()
    tokens = [w.event(k, 1.0 + k, w.scalar("tokens", 1024 * k)) for k in (0, 2, 4, 6)]
    (tmp_path / "r/events.tfevents.1").write_bytes(w.events_file(*(w.event(k, 1.0 + k, w.scalar("loss", k)) for k in range(10)), *tokens))
    assert [r.x for r in Logs(spark, str(tmp_path)).show("loss", "tokens").collect()] == [1024.0 * k for k in range(7)]


def content(df):
    """Rows in the order of ``seq``, whose own values leave gaps after appended parts, with each row's file number."""
    rows = sorted(df.where("kind <> 'run'").collect(), key=lambda r: r.seq)
    return [(r.run, r.backend, r.kind, r.tag, r.seq >> trainlog.ROW_BITS, r.step, r.wall, r.value, r.text, r.buckets) for r in rows]


def test_store_gives_what_a_cold_read_gives(spark, root, tmp_path_factory):  # noqa: F811
    folder = str(tmp_path_factory.mktemp("store"))
    opened = []

    def check():
        before = {n.name for n in Path(folder).iterdir()}
        assert content(store.refresh(spark, str(root), folder)) == content(trainlog.load(spark, str(root)))
        opened.append(sorted(n.name for n in Path(folder).iterdir() if n.name not in before))

    check()
    check()
    assert opened[1] == []  # nothing changed: nothing is decoded
    with open(root / "a/events.out.tfevents.2", "ab") as f:
        f.write(w.record(w.event(6, 1.7e9 + 20, w.scalar("loss", 106))) + b"torn")
    with open(root / "b/dvclive/plots/metrics/train/loss.tsv", "a") as f:
        f.write("3.5\n")
    check()
    assert spark.read.parquet(f"{folder}/rows-2").where("kind = 'scalar'").count() == 2  # only what was appended
    (root / "0").mkdir()
    (root / "0/events.tfevents.1").write_bytes(w.events_file(w.event(0, 1.0, w.scalar("x", 1))))  # moves the places of all others
    check()
    (root / "a/events.out.tfevents.1").write_bytes(w.events_file(w.event(0, 1.0, w.scalar("loss", 9))))
    (root / "offline/run-1.wandb").unlink()
    check()
    (root / "mlruns/0/x/params/lr").write_text("0.75")
    check()
    (Path(folder) / "files-5").rename(f"{folder}/gone")  # as if the last refresh had been cut off
    check()
    assert Logs(spark, str(root), store=folder).ls().count() == Logs(spark, str(root)).ls().count()


def test_payload_checksums_on_request(spark, tmp_path):
    (tmp_path / "r").mkdir()
    bad = bytearray(w.record(w.event(1, 1.0, w.scalar("a", 2))))
    bad[-1] ^= 1
    (tmp_path / "r/events.tfevents.1").write_bytes(w.record(w.event(0, 1.0, w.scalar("a", 1))) + bytes(bad))
    found = {verify: Logs(spark, str(tmp_path), verify=verify) for verify in (False, True)}
    assert [found[v].points.count() for v in (False, True)] == [2, 1]
    assert [found[v].losses().first().dropped_records for v in (False, True)] == [0, 1]


def test_watch_waits_draws_on_change_and_goes_stale(spark, tmp_path):
    polls = watch(spark, str(tmp_path / "later"), lambda logs: ",".join(str(r.value) for r in logs.show("loss").collect()), interval=0.01, polls=6)
    assert next(polls) == "waiting for data"
    (tmp_path / "later").mkdir()
    (tmp_path / "later/events.tfevents.1").write_bytes(w.events_file(w.event(0, 1.0, w.scalar("loss", 4))))
    assert next(polls) == "4.0" and next(polls) in ("live", "stale")
    assert set(polls) <= {"live", "stale"}
    assert main(["tail", str(tmp_path / "later"), "loss", "--polls", "1"], spark) == 0
