"""op12 and op13 against brute force on made conversations: nulls, ties, repeated rows, empty tables, clashing names, long and nested ones."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from runlens.llm import prefix_trie, turn_repair

TALKS = "conv_id long, turn long, role string, text string, depth long, a long, kind string, there string"
WORDS = ("Yes.", "no", "What is it?", "well then", "", " \n", "Go on!", "é.", "a  b\tc.")
rng = random.Random(7)


def made():
    rows = []
    for c in [*range(0, 64), 100, 101, 121, 140, 161, None]:
        for t in range(rng.randint(1, 9)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None)) if t else rng.choice(("system", "user"))
            rows.append((c, rng.choice((t, t, t, t + 3, None)), role, rng.choice((*WORDS, None))))
    rows += [(200, t, ("user", "assistant")[t % 2], "Snapshot.") for t in range(40)]
    for c in range(201, 216):  # the same talk, each later copy longer
        rows += [(c, t, ("user", "assistant")[t % 2], "Snapshot.") for t in range(2 * (c - 200))]
    rows += [(300, t, "system", f"s{t}." if t % 7 else "") for t in range(1400)]
    rows += [(320, t, ("user", "assistant")[t % 3 == 1], f"turn {t}" + "." * (t % 5 > 0)) for t in range(1200)]
    rows += rows[:5]
    return rows


ROWS = made()


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("talks") / "conversations.parquet")
    spark.createDataFrame([(*r, 9, 9, "k", "x") for r in ROWS], TALKS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def key(row):
    return (row[1] is not None, row[1] or 0, row[2], row[3])


def brute_repair(rows):
    """Cheapest (cost, audit) over all edit sequences, by memo on (row, what stands before); written independently of the parser."""
    @lru_cache(maxsize=None)
    def best(at, state, inserted):
        # states: 0 nothing, 1 after system, 2 after user, 3 after assistant
        ways = []
        if at == len(rows) and state in (0, 3):
            ways.append((0, ""))
        if at < len(rows):
            role, _, faulty, cut = rows[at]
            cost, audit = best(at + 1, state, 0)
            ways.append((cost + 2, "D" + audit))
            if not faulty:
                for to, fits, names in ((1, state == 0, "s"), (2, state in (0, 1, 3), "u"), (3, state == 2, "a")):
                    if fits:
                        edit = ("K", 0) if role[:1] == names else ("R", 1) if names in "ua" else None
                        if edit:
                            cost, audit = best(at + 1, to, 0)
                            ways.append((cost + edit[1] + 5 * cut, edit[0] + audit))
        if inserted < 2:
            for to, fits in ((2, state in (0, 1, 3)), (3, state == 2)):
                if fits:
                    cost, audit = best(at, to, inserted + 1)
                    ways.append((cost + 5, "I" + audit))
        return min(ways, default=(10**9, ""))

    for at in range(len(rows), -1, -1):  # fill the memo from the end, so that recursion stays shallow
        for state in range(4):
            best(at, state, 0)
    return best(0, 0, 0)


def told(rows, audit):
    out, at, headed = [], 0, False
    for letter in audit:
        role, text = "", ""
        if letter != "I":
            role, text = rows[at][:2]
            at += 1
        if letter == "D":
            continue
        if letter == "K" and not out and role[:1] == "s":
            headed = True
        if letter != "K":
            role = ("user", "assistant")[(len(out) - headed) % 2]
        out.append(f"{role}:{text}")
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_repairs():
    after = {}
    for c, t, role, text in ROWS:
        known = [" " if x is None else str(x) for x in (c, t, role, text)]
        kind = zlib.crc32(f"{known[0]}:{known[1]}".encode()) % 20
        role, text = known[2:]
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        after.setdefault(c, []).extend([row] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for c, rows in after.items():
        rows.sort(key=key)
        seen, flagged, counts = set(), [], [0, 0, 0]
        for _, _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            if fault is not None:
                counts[fault] += 1
            flagged.append((role, text, fault in (0, 1), fault == 2))
            seen.add((role, text))
        turns = [t for _, t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit = brute_repair(tuple(flagged))
        out.append((c, gaps, *counts, illegal, cost, audit, told(flagged, audit)))
    return sorted(out, key=lambda r: (r[0] is None, r[0]))


def test_repair_equals_brute_force_for_short_and_long_conversations(talks):
    got = sorted(map(tuple, turn_repair.repair(talks).collect()), key=lambda r: (r[0] is None, r[0]))
    want = brute_repairs()
    assert [r[0] for r in got] == [r[0] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a == b
    assert any(len(r[7]) > 2 * turn_repair.STRIDE for r in got)


def test_repair_keeps_conversations_of_which_all_rows_are_dropped(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    got = turn_repair.repair(spark.createDataFrame([(c, 0, "user", "x.") for c in gone], "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in gone]


def test_short_strides_change_nothing(monkeypatch):
    rows = [(rng.choice(("user", "assistant", "system", "x")), f"{k}", rng.random() < 0.2, rng.random() < 0.2) for k in range(300)]
    results = set()
    for stride in (1, 2, 7, 64, 1000):
        monkeypatch.setattr(turn_repair, "STRIDE", stride)
        parse = turn_repair.Parse()
        for r in rows:
            parse.read(*r)
        results.add(parse.repair())
    cost, audit = brute_repair(tuple(rows))
    assert results == {(cost, audit, told(rows, audit))}


def brute_trie():
    own = {}
    for c, t, role, text in ROWS:
        if c is not None:
            own.setdefault(c, []).append((c, t, role or "", text or ""))

    def place(r):
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())

    turns = {c: [(r[2], r[3]) for r in sorted(rows, key=place)] for c, rows in own.items()}
    members, ends = {}, {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple([*turns.get(c - c % 20, [])[:h], *mine[h:]])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, m in members.items()]


def test_trie_equals_brute_force_also_for_long_and_nested_conversations(talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 8)
    got = sorted(map(repr, map(tuple, prefix_trie.trie(talks).collect())))
    assert got == sorted(map(repr, brute_trie()))


def test_turns_are_told_apart_by_role_and_text(spark):
    rows = [(1, 0, "a", "bc"), (2, 0, "ab", "c"), (3, 0, "a", "bc"), (3, 1, None, None), (21, 0, "", "")]
    got = prefix_trie.trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.where("depth = 0").select("n_convs", "parent_conv_id").first() == (4, None)
    assert got.where("depth = 1").agg(F.sum("n_convs")).first()[0] <= 4


def test_empty_tables(talks):
    none = talks.where("conv_id < -1")
    assert turn_repair.repair(none).count() == 0 == prefix_trie.trie(none).count()
