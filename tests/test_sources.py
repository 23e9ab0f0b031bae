import os

import pytest

import writers as w
from runlens.operators import catalog
from runlens.sources import textlogs, trainlog, wire
from runlens.streaming.tail import follow


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_checksums():
    assert wire.crc32c(b"123456789") == 0xE3069283 and wire.crc32c(bytes(32)) == 0x8A9136AA


def test_torn_records_wait_at_every_byte():
    data = w.record(b"abc") + w.record(b"defg")
    whole = [(end, p) for end, p, _ in wire.records(data)]
    for cut in range(len(data)):
        assert [(end, p) for end, p, _ in wire.records(data[:cut])] == [x for x in whole if x[0] <= cut]


def test_bad_length_kills_the_file_bad_message_one_record():
    good, bad = w.record(w.event(0, 1.0, w.scalar("a", 1))), bytearray(w.record(w.event(1, 1.0, w.scalar("a", 2))))
    bad[9] ^= 1
    rows = list(trainlog.event_rows(good + bytes(bad), 0))
    assert [r[0] for r in rows] == ["scalar", "run"] and rows[-1][1] == "dead" and rows[-1][4] == len(good)
    rows = list(trainlog.event_rows(good + w.record(b"\x07") + good, 0))
    assert [r[0] for r in rows] == ["scalar", "scalar", "run"] and rows[-1][2] == 1


def test_histogram_edges():
    v = wire.summary_value(w.histogram("h", -1, 3, [0, 1, 2], [3, 4, 3]))
    assert wire.buckets(v) == [(-1, 0, 3), (0, 1, 4), (1, 3, 3)] and wire.kind_of(v) == "histogram"


def test_session_parameters():
    v = wire.summary_value(w.session(lr=0.001, optimizer="adam", amsgrad=True))
    assert wire.session_hparams(v) == {"lr": 0.001, "optimizer": "adam", "amsgrad": True}


def test_block_log_spans_blocks_and_waits_for_torn_tails():
    payloads = [b"x" * n for n in (5, 40000, 32768 - 7, 1, 70000)]
    data = w.block_log(*payloads)
    assert [p for _, p in wire.log_records(data)] == payloads
    whole = [end for end, _ in wire.log_records(data)]
    for cut in range(7, len(data), 977):
        assert [end for end, _ in wire.log_records(data[:cut])] == [e for e in whole if e <= cut]


def test_text_parsers():
    assert textlogs.metric_line("1700000000000 0.5 3") == (3, 1.7e9, 0.5) and textlogs.metric_line("1 2") is None
    assert textlogs.Columns("timestamp\tstep\tloss").row("1000\t4\tnan")[0] == 4
    assert textlogs.params("lr: 0.005\nopt:\n  name: adamw\n  list: [1]\n# c\nflag: true\n") == {"lr": 0.005, "opt.name": "adamw", "opt.list": "[1]", "flag": True}
    assert textlogs.params('a: "x # y"\nkey : 3 # c\nb: {x: 1}\nno blank key: 1\n') == {"a": "x # y", "key": "3 # c", "b": "{x: 1}"}
    row = textlogs.Columns("timestamp\tstep\tloss").row
    assert row(" 2000 \t 3\t0.5 \textra\r") == (3, 2.0, 0.5) and row("2000\t3") is None
    assert [textlogs.typed(t) for t in ("1_000", "'x'", "1d", "-.5")] == ["1_000", "x", "1d", -0.5]


@pytest.fixture
def root(tmp_path):
    put(tmp_path / "a/events.out.tfevents.1", w.events_file(w.event(0, 1.7e9, w.session(lr=0.1)), *(w.event(k, 1.7e9 + k, w.scalar("loss", k), w.histogram("h", 0, 1, [0.5, 1], [1, 2])) for k in range(5))))
    put(tmp_path / "a/events.out.tfevents.2", w.events_file(*(w.event(k, 1.7e9 + 10 + k, w.scalar("loss", 100 + k)) for k in range(3, 6))))
    put(tmp_path / "b/dvclive/plots/metrics/train/loss.tsv", "step\tloss\n0\t6.25\n1\t4.5\n2\t")
    put(tmp_path / "b/dvclive/params.yaml", "lr: 0.005\noptimizer: adamw\n")
    put(tmp_path / "mlruns/0/x/meta.yaml", "run_id: abc\nrun_name: warm\n")
    put(tmp_path / "mlruns/0/x/metrics/val/acc", "1700000000000 0.5 0\n1700000001000 0.75 1\n")
    put(tmp_path / "mlruns/0/x/params/lr", "0.02")
    put(tmp_path / "offline/run-1.wandb", w.block_log(w.config(lr=0.003, name="q"), w.history(0, loss=5.0), w.history(1, loss=4.0), w.field(18, 2, b"")))
    put(tmp_path / ".hidden/events.out.tfevents.9", w.events_file(w.event(0, 1.0, w.scalar("x", 1))))
    return tmp_path


def test_mixed_folder_in_one_read(spark, root):
    logs = trainlog.load(spark, str(root)).cache()
    s = {(r.run, r.tag): r for r in catalog.series(trainlog.points(logs)).collect()}
    assert {k: (v["count"], v.segments) for k, v in s.items()} == {("a", "loss"): (8, 2), ("b", "train/loss"): (2, 1), ("warm", "val/acc"): (2, 1), ("offline", "loss"): (2, 1)}
    params = {(r.run, r.key): r.num if r.num is not None else r.str for r in trainlog.hparams(logs).collect()}
    assert params == {("a", "lr"): 0.1, ("b", "lr"): 0.005, ("b", "optimizer"): "adamw", ("warm", "lr"): 0.02, ("offline", "lr"): 0.003, ("offline", "name"): "q"}
    assert logs.where("kind = 'histogram'").count() == 5 and logs.where("tag = 'finished'").count() == 1
    assert trainlog.load(spark, str(root / "none")).count() == 0


def test_stream_equals_batch_and_continues(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    where = str(out / "table"), str(out / "checkpoint")
    follow(spark, str(root), *where).awaitTermination(60)
    with open(root / "b/dvclive/plots/metrics/train/loss.tsv", "a") as f:
        f.write("3.5\n3\t2.5\n")
    with open(root / "a/events.out.tfevents.2", "ab") as f:
        f.write(w.record(w.event(6, 1.7e9 + 20, w.scalar("loss", 106))) + b"torn")
    follow(spark, str(root), *where).awaitTermination(60)

    def of(df):
        return sorted((r.run, r.tag, r.step, r.value) for r in trainlog.points(df).collect())

    got = of(spark.read.parquet(where[0]))
    assert got == of(trainlog.load(spark, str(root))) and ("b", "train/loss", 2, 3.5) in got and ("a", "loss", 6, 106.0) in got


def test_unreadable_names_do_not_matter(root):
    os.symlink(root / "a", root / "link")
    assert not any(f.run == "link" for f in trainlog.discover(str(root)))


def test_plain_scalars_decode_as_any_event(tmp_path):
    import random

    gen = random.Random(3)
    for _ in range(3000):
        tag = "".join(gen.choice("ab/é_\x15\n*") for _ in range(gen.choice((0, 1, 5, 40, 119, 130))))
        data = bytearray(w.event(gen.choice((0, 1, 127, 128, 1 << 40, -1)), gen.random(), w.scalar(tag, gen.random())))
        for _ in range(gen.choice((0, 0, 1, 3))):
            data[gen.randrange(len(data))] = gen.randrange(256)
        plain = wire.plain_scalar(bytes(data))
        if plain:
            e = wire.event(bytes(data))
            assert repr([(v["tag"], e["step"], e["wall"], wire.scalar(v)) for v in e["values"]]) == repr([plain]) and wire.kind_of(e["values"][0]) == "scalar"
    assert wire.plain_scalar(w.event(5, 1.0, w.scalar("loss", 2))) == ("loss", 5, 1.0, 2.0)


def test_small_files_share_partitions(tmp_path):
    for k in range(100):
        put(tmp_path / f"r{k}/events.tfevents.1", w.events_file(w.event(0, 1.0, w.scalar("x", k))))
    parts = trainlog.BatchReader(str(tmp_path)).partitions()
    assert len(parts) == trainlog.PARTITIONS and sorted(f.run for p in parts for f in p.files) == sorted(f"r{k}" for k in range(100))


def test_odd_values_of_a_block_log(spark, tmp_path):
    odd = [w.item("_step", v) + w.item("_timestamp", t) + w.item("loss", x) for v, t, x in ((None, "text", 1.0), ("x", [1], 2.0), (float("nan"), None, float("nan")), (float("-inf"), True, 4.0), (7.9, 10**400, 10**4000), (True, {}, "text"))]
    nested = w.field(2, 2, w.field(1, 2, w.field(1, 2, b"plain") + w.field(2, 2, b"a") + w.field(2, 2, b"b") + w.field(16, 2, b"3")))
    put(tmp_path / "o/run-1.wandb", w.block_log(w.config(name="\ud800x"), w.history(0, loss=1.0), w.history(1 << 70, loss=2.0), *(w.field(2, 2, o) for o in odd), nested))
    rows = trainlog.load(spark, str(tmp_path))
    assert [r.text for r in rows.where("kind = 'hparam'").collect()] == ["?x"] and rows.where("kind = 'run'").first().step == 0
    got = [(r.tag, r.step, r.wall, r.value) for r in trainlog.points(rows).orderBy("seq").collect()]
    top, least = (1 << 63) - 1, -(1 << 63)
    assert list(map(repr, got)) == list(map(repr, [("loss", 0, 1.7e9, 1.0), ("loss", top, 1.7e9 + 2.0**70, 2.0), ("loss", 0, 0.0, 1.0), ("loss", 0, 0.0, 2.0), ("loss", 0, 0.0, float("nan")), ("loss", least, 0.0, 4.0), ("loss", 7, float("inf"), float("inf")), ("a/b", 0, 0.0, 3.0)]))


@pytest.mark.parametrize("low, high, limits, counts, want", [
    (-1, 3, [0, 1, 2], [3, 4, 3], [(-1, 0, 3), (0, 1, 4), (1, 3, 3)]),
    (-1, 1, [-10, 0, 10], [0, 3, 4], [(-10, -10, 0), (-10, 0, 3), (0, 1, 4)]),
    (0, 1, [5, 6, 7], [1, 1, 1], [(0, 5, 1), (5, 6, 1), (6, 6, 1)]),
    (3, 1, [9], [2], [(1, 1, 2)]), (0, 1, [], [1], []), (0, 2, [1, 2, 3], [1], [(0, 2, 1)]),
])
def test_only_outer_edges_give_way(spark, low, high, limits, counts, want):
    from pyspark.sql import functions as F

    from runlens.operators import hist

    assert wire.buckets(wire.summary_value(w.histogram("h", low, high, limits, counts))) == want
    both = (F.array(*(F.lit(float(x)) for x in v)).cast("array<double>") for v in (limits, counts))
    row = spark.range(1).select(hist.normalise(*both, F.lit(float(low)), F.lit(float(high))).alias("b")).first()
    assert [tuple(b) for b in row.b] == want


def test_a_grown_file_is_read_from_where_it_ended(root):
    """Rows read from every possible start are the last rows of a whole read, and only new bytes are opened."""
    for f in trainlog.discover(str(root)):
        whole = list(trainlog.rows(f))
        size, ends = os.path.getsize(f.path), set()
        for n in range(0, size, 7):
            ends.add(trainlog.complete(f) if n == 0 else min(n, trainlog.complete(f)))
        done = trainlog.complete(f)
        if f.backend.endswith(("param", "params")):
            continue
        for since in sorted({0, done}):
            f.start = since
            got = [r for r in trainlog.rows(f) if r[2] != "run"]
            assert [r[2:4] + r[5:] for r in got] == ([] if since == done else [r[2:4] + r[5:] for r in whole if r[2] != "run"])
            assert trainlog.complete(f, since) == done


def test_records_from_an_offset(tmp_path):
    events = [w.event(k, 1.7e9 + k, w.scalar("loss", k)) for k in range(50)]
    data = w.events_file(*events)
    put(tmp_path / "e/events.tfevents.1", data)
    put(tmp_path / "w/run-1.wandb", w.block_log(*(w.history(k, loss=float(k), text="x" * 3000) for k in range(50))))
    for f in trainlog.discover(str(tmp_path)):
        whole = [r[5] for r in trainlog.rows(f) if r[2] == "scalar"]
        steps = [after for after, *_ in (wire.records(data) if f.backend == "tfevents" else wire.log_records(open(f.path, "rb").read()))]
        for since in steps[::7]:
            f.start = since
            got = list(trainlog.rows(f))
            rest = [r[5] for r in got if r[2] == "scalar"]
            assert rest == whole[len(whole) - len(rest) :] and len(rest) <= 50 and got[-1][7] == steps[-1] == trainlog.complete(f, since)


def test_polls_open_only_what_changed(root, monkeypatch):
    reader, opened = trainlog.StreamReader(str(root)), []
    first = reader.latestOffset()
    monkeypatch.setattr(trainlog, "complete", lambda f, since=0: opened.append((f.path, since)) or since)
    assert reader.latestOffset() == first and not opened
    path = next(p for p in first if "tfevents" in p)
    with open(path, "ab") as f:
        f.write(b"torn")
    assert reader.latestOffset() == first and opened == [(path, first[path])]


def test_events_without_values_count_for_the_span(spark, tmp_path):
    from runlens.session import Logs

    put(tmp_path / "r/events.tfevents.1", w.events_file(w.event(0, 1.7e9 + 5, w.scalar("loss", 1.0)), w.event(1, 1.7e9 + 9)))
    row = Logs(spark, str(tmp_path)).runs().first()
    assert (row.first_wall, row.last_wall, row.points) == (1.7e9, 1.7e9 + 9, 1)


def test_polls_of_many_files_share_partitions(tmp_path):
    for k in range(100):
        put(tmp_path / f"r{k}/events.tfevents.1", w.events_file(w.event(0, 1.0, w.scalar("x", k))))
    for reader in (trainlog.StreamReader(str(tmp_path)), trainlog.VersionedReader(str(tmp_path), False, str(tmp_path / ".known.json"))):
        end = reader.latestOffset()
        parts = reader.partitions({}, end)
        assert len(parts) == trainlog.PARTITIONS and sorted(f.run for p in parts for f in p.files) == sorted(f"r{k}" for k in range(100))
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist() if r["kind"] == "scalar"]
        assert sorted((r["run"], r["value"]) for r in rows) == sorted((f"r{k}", float(k)) for k in range(100))
        assert reader.partitions(end, end) == []


def test_events_of_a_batch_equal_single_ones(tmp_path):
    import random

    import pyarrow as pa

    from runlens.sources import eventlog

    gen, rows = random.Random(1), []
    for k in range(600):
        n = gen.choice((0, 1, 5, 40))
        wide = {"low": gen.random(), "high": gen.random(), "limits": [gen.random() for _ in range(n)], "counts": [gen.random() for _ in range(gen.choice((n, n, 2)))]}
        rows.append({"run": "a", "tag": gen.choice(("x", "é" * 70, "")), "seq": k, "step": gen.choice((0, 1, 200, -3, 1 << 40)), "wall": gen.random(), "value": gen.choice((None, 1.5)), "buckets": gen.choice((None, wide))})
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.struct([("low", pa.float64()), ("high", pa.float64()), ("limits", pa.list_(pa.float64())), ("counts", pa.list_(pa.float64()))])]
    batch = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(rows[0], kinds, strict=True)], names=list(rows[0]))
    made = eventlog.events_of(batch)
    assert made == [eventlog.event(r) for r in rows] and eventlog.events_of(batch.slice(100, 50)) == made[100:150]
    assert wire.masked_all(made) == [wire.masked(p) for p in made]
    told = 0
    for payload in made:
        damaged = bytearray(payload)
        damaged[gen.randrange(len(damaged))] = gen.randrange(256)
        for data in (payload, bytes(damaged), payload[: gen.randrange(len(payload))]):
            plain = wire.plain_histogram(data)
            if plain:
                told += 1
                e = wire.event(data)
                assert [wire.kind_of(v) for v in e["values"]] == ["histogram"]
                assert repr((e["values"][0]["tag"], e["step"], e["wall"], wire.buckets(e["values"][0]))) == repr(plain)
    assert told >= sum(r["buckets"] is not None for r in rows)
