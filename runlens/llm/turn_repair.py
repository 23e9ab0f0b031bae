"""Conversation structure repair by error-correcting Earley parsing over a weighted grammar of roles.

A sound conversation is nothing, or pairs of user and assistant with at most one system turn before them. The grammar is
left-linear, so every chart item begins at the conversation's start, and a column holds a dozen items however long the
conversation is. Besides reading a turn as it stands, an item may pass over a row (delete), read it under another role
(rerole) or go on without one (insert). Items retain the least (cost, audit), the audit being the initials of the edits.

Audits end with an edit that consumes a row whenever a column begins, so none is the beginning of another of the same
column. Hence every STRIDE rows the audits so far can be replaced by their rank, and the rows behind them be hashed once for
each audit still alive: a conversation is read as a stream, in memory bounded by STRIDE rows and the audits.

One shuffle, by conversation. SHA-256 of a joined conversation can only be computed in order, so the rows of a conversation
pass through one task, sorted by Spark (which spills) and never held together.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import importable

#: Left-linear rules: all but the first symbol of a right side are terminals, the initials of roles.
RULES = (("Talk", ()), ("Talk", ("Pairs",)), ("Pairs", ("Open", "a")), ("Open", ("u",)), ("Open", ("Head", "u")), ("Open", ("Pairs", "u")), ("Head", ("s",)))
GOAL, NAMES = "Talk", {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
STRIDE, STRIDE_CHARS = 512, 4 << 20
BLANKS = "\t\n\x0b\x0c\r "
FOLLOWS = ("su", "ua", "au")
SCHEMA = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

#: Items are (rule, dot) by number; per item the terminal that comes next, the item behind it, and the items that its completion advances.
ITEMS = [(r, d) for r, (_, right) in enumerate(RULES) for d in range(len(right) + 1)]
AT = {item: k for k, item in enumerate(ITEMS)}
NEXT = [RULES[r][1][d] if d < len(RULES[r][1]) else None for r, d in ITEMS]
BEHIND = [AT.get((r, d + 1)) for r, d in ITEMS]
ADVANCED = [[AT[r2, 1] for r2, (_, right) in enumerate(RULES) if right[:1] == (RULES[r][0],)] if d == len(RULES[r][1]) else [] for r, d in ITEMS]
FIRST = [AT[r, 0] for r, (_, right) in enumerate(RULES) if not right or right[0] in "sua"]
DONE = [k for k, (r, d) in enumerate(ITEMS) if RULES[r][0] == GOAL and d == len(RULES[r][1])]


class Told:
    """What an audit has told so far: its letters, linked to those before, and the hash of the repaired turns."""

    __slots__ = ("before", "count", "hash", "headed", "letters")

    def __init__(self, before: Told | None, letters: str, rows: list[tuple[str, str, str]]):
        self.before, self.letters = before, letters
        self.hash = before.hash.copy() if before else hashlib.sha256()
        self.count, self.headed = (before.count, before.headed) if before else (0, False)
        at = 0
        for letter in letters:
            role, text = "", ""
            if letter != "I":
                role, text, initial = rows[at]
                at += 1
                if letter == "D":
                    continue
                self.headed |= not self.count and letter == "K" and initial == "s"
            if letter != "K":
                role = NAMES["a" if (self.count - self.headed) % 2 else "u"]
            self.hash.update(("\n" * bool(self.count) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.count += 1

    def audit(self) -> str:
        parts, at = [], self
        while at:
            parts.append(at.letters)
            at = at.before
        return "".join(reversed(parts))


class Parse:
    """The chart's newest column for one conversation: per item (cost, rank of the audit before the stride, audit since)."""

    def __init__(self):
        self.told: list[Told | None] = [None]
        self.rows: list[tuple[str, str, str]] = []
        self.chars = 0
        self.column = dict.fromkeys(FIRST, (0, 0, ""))

    def closed(self) -> dict[int, tuple[int, int, str]]:
        """The column with all that completion and insertion reach, cheapest first."""
        agenda, final = [(w, k) for k, w in self.column.items()], {}
        heapq.heapify(agenda)
        while agenda:
            w, k = heapq.heappop(agenda)
            if k in final:
                continue
            final[k] = w
            for to in ADVANCED[k]:
                if to not in final:
                    heapq.heappush(agenda, (w, to))
            if NEXT[k] in NAMES and BEHIND[k] not in final:
                heapq.heappush(agenda, ((w[0] + INSERT, w[1], w[2] + "I"), BEHIND[k]))
        return final

    def read(self, role: str, text: str, faulty: bool, cut_off: bool) -> None:
        initial, made = role[:1], {}
        for k, (cost, rank, letters) in self.closed().items():
            ways = [(k, (cost + DELETE, rank, letters + "D"))]
            if NEXT[k] and not faulty:
                more = CUT_OFF if cut_off else 0
                if NEXT[k] == initial:
                    ways.append((BEHIND[k], (cost + more, rank, letters + "K")))
                elif NEXT[k] in NAMES:
                    ways.append((BEHIND[k], (cost + REROLE + more, rank, letters + "R")))
            for to, w in ways:
                if to not in made or w < made[to]:
                    made[to] = w
        self.column = made
        self.rows.append((role, text, initial))
        self.chars += len(text)
        if len(self.rows) >= STRIDE or self.chars >= STRIDE_CHARS:
            ranked = sorted({w[1:] for w in made.values()})
            self.told = [Told(self.told[rank], letters, self.rows) for rank, letters in ranked]
            place = {x: n for n, x in enumerate(ranked)}
            self.column = {k: (w[0], place[w[1:]], "") for k, w in made.items()}
            self.rows, self.chars = [], 0

    def repair(self) -> tuple[int, str, str]:
        """Cost, audit and the hash of the repaired turns."""
        final = self.closed()
        cost, rank, letters = min(final[k] for k in DONE if k in final)
        end = Told(self.told[rank], letters, self.rows)
        return cost, end.audit(), end.hash.hexdigest()


def damaged(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there) with damage dealt by crc32 of ``conv_id:turn``; a dropped row stays as one that is not there.

    A null id, turn, role or text counts as one space in what is hashed and in the rows; conv_id and turn stay null.
    """
    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), "kind")
    return rows.withColumn("_", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_", "kind")


def faults(rows: DataFrame) -> DataFrame:
    """Rows sorted within their conversation's partition, with flags ``blank``, ``duplicate`` and ``cut_off`` of which at most one is set.

    Order: turn, null first, then role and text. A row whose role and text were seen earlier is a duplicate.
    """
    rest = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"blank": rest == "", "last": F.right(rest, F.lit(1)), "held": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)})
    earlier = F.row_number().over(Window.partitionBy("conv_id", "there", "held").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.repartition("conv_id").withColumn("duplicate", ~F.col("blank") & (earlier > 1))
    rows = rows.withColumn("cut_off", ~F.col("blank") & ~F.col("duplicate") & ~F.col("last").isin(".", "!", "?"))
    return rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "duplicate")  # of equal rows the duplicates last


class Talk:
    """One conversation while its rows pass."""

    def __init__(self, conv_id: object):
        self.conv_id, self.parse = conv_id, Parse()
        self.least = self.most = self.turn = self.role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def read(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, cut_off: bool) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + cut_off
        self.illegal += self.role is not None and self.role + role[:1] not in FOLLOWS
        self.role = role[:1]
        self.parse.read(role, text, blank or duplicate, cut_off)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.parse.repair())


def repair(talks: DataFrame) -> DataFrame:
    """One row per conversation: counts of faults, the cheapest repair's cost, audit and hash.

    Empty table: no rows. A null conv_id is a conversation of its own. Repeated rows are duplicates, but for the first.
    Roles count by their initial, so an unknown one is kept only where its initial fits. Further columns are ignored.
    """
    importable(talks.sparkSession)
    id_type = talks.schema["conv_id"].dataType
    rows = faults(damaged(talks)).select("conv_id", "turn", "role", "text", "there", "blank", "duplicate", "cut_off")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        talk, kind = None, pa.string()

        def made(done: list[Talk]) -> pa.RecordBatch:
            columns = list(zip(*(t.row() for t in done), strict=True))
            types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *(c.split()[0] for c in SCHEMA.split(", "))])

        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for conv, turn, role, text, there, *flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if talk is None or talk.conv_id != conv:
                    done += [talk] if talk else []
                    talk = Talk(conv)
                if there:
                    talk.read(turn, role, text, *flags)
            if done:
                yield made(done)
        if talk:
            yield made([talk])

    return rows.mapInArrow(read, f"conv_id {id_type.simpleString()}, {SCHEMA}")


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    step = "CASE WHEN k & 1 = 1 THEN xor(k >> 1, 3988292384) ELSE k >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda k, z: {step})), 4294967295)"


def oracle() -> str:
    """The same rows by dynamic programming over four states (nothing yet, after system, after user, after assistant), folded over each conversation's rows."""
    def more(state: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST({state}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{letter}'"

    far = "'900000000'"
    def way(start: str, want: str) -> str:
        return f"CASE WHEN x.faulty THEN {far} WHEN x.i = '{want}' THEN {more(start, 'x.more', 'K')}" + (f" ELSE {more(start, 'x.more + 1', 'R')} END" if want != "s" else f" ELSE {far} END")

    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, range(CASE WHEN kind = 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS rest FROM d),
f2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again FROM f),
g AS (SELECT conv_id, turn, role, text, pos, role[1:1] AS i, rest = '' AS blank, rest <> '' AND again > 1 AS dup, rest <> '' AND again = 1 AND right(rest, 1) NOT IN ('.', '!', '?') AS cut, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY pos) AS i0 FROM f2),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS n, {far} AS h, '000000005I' AS o, '000000010II' AS p FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, pos, n, h, least(o, {more('n', '5', 'I')}, {more('h', '5', 'I')}, {more('p', '5', 'I')}), least(p, {more('o', '5', 'I')}, {more('n', '10', 'II')}, {more('h', '10', 'II')}) FROM (
  SELECT x.conv_id, x.pos, {more('c.n', '2', 'D')} AS n, least({more('c.h', '2', 'D')}, {way('c.n', 's')}) AS h, least({more('c.o', '2', 'D')}, {way('c.n', 'u')}, {way('c.h', 'u')}, {way('c.p', 'u')}) AS o, least({more('c.p', '2', 'D')}, {way('c.o', 'a')}) AS p
  FROM s c JOIN (SELECT *, blank OR dup AS faulty, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM g) x ON x.conv_id IS NOT DISTINCT FROM c.conv_id AND x.pos = c.pos + 1)),
e AS (SELECT conv_id, CAST(w[1:9] AS BIGINT) AS cost, w[10:] AS audit FROM (SELECT conv_id, arg_max(least(n, p), pos) AS w FROM s GROUP BY conv_id)),
l AS (SELECT conv_id, j, audit[j:j] AS letter, length(regexp_replace(audit[1:j], 'I', '', 'g')) AS pos, length(regexp_replace(audit[1:j], 'D', '', 'g')) AS n FROM e, range(1, length(audit) + 1) t(j)),
m AS (SELECT l.conv_id, j, letter, n, g.role, coalesce(g.text, '') AS text, g.i, max(CASE WHEN n = 1 AND letter = 'K' AND g.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS headed FROM l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.pos = l.pos AND letter <> 'I' WHERE letter <> 'D'),
r AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (n - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j) AS told FROM m GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (i0 IS NOT NULL AND i0 || i NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(told, '')) AS repaired_sha256
FROM e LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""  # noqa: E501
