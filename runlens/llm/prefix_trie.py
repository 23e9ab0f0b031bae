"""The trie of conversation prefixes, with subtree totals by leaf-peeling message passing.

A node is named by an XOR over its turns of hashes of (depth, role and text): 128 bits that a window adds up in one pass, so
no prefix is ever built. Nodes hold the number of children that have not reported. Each round the nodes that wait for none
are done; they send their totals up. Where a parent waited for that child alone it is done as well, and so on: the whole
chain up to the first node that waits for another child is peeled in the same round, its totals summed along the path of one
conversation that runs through it. A node thus outlives a round only if two of its branches do, and the number of rounds
is at most 1 + log2(leaves), also for conversations of any length. Rounds end when the root is done.

Hot nodes (a first turn that all share, the root) are counted before they are shuffled and joined by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import discard, importable, join_counted, settle

NODE = ["a", "b"]
#: Parts of a node's list of conversations, in characters, that travel as one row.
PIECE = 1 << 16
GROUP, SHARED = 20, 4


def ordered(talks: DataFrame) -> DataFrame:
    """Rows (conv_id, at, turn_hash, words): turns from 0 by turn (null first, ties by role and text); null role or text is empty, rows without conv_id belong to no conversation."""
    own = talks.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    told = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_hash")
    return own.select("conv_id", "turn", "role", told.alias("turn_hash"), words.alias("words")).select("conv_id", (F.row_number().over(order) - 1).alias("at"), "turn_hash", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, turn_hash, words) of conversations that share their beginnings: the first h turns of c - c % 20, then c's own after its first h; depth 0 is every conversation's empty beginning.

    h is crc32 of the decimal c, modulo 4.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    convs = turns.where("at = 0").select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("at") < SHARED - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "turn_hash", "words"))).alias("head"))
    convs = convs.join(heads, "base", "left").select("conv_id", "h", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<at:int,turn_hash:string,words:bigint>>")).alias("head"))
    begun = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.at") + 1).alias("depth"), "t.turn_hash", "t.words")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("n") + 1).alias("depth"), "turn_hash", "words")
    none = convs.select("conv_id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("turn_hash"), F.lit(0).cast("long").alias("words"))
    return none.unionByName(begun).unionByName(own)


def paths(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, a, b, pa, pb, words, ends): for each prefix of a conversation its node and that of the prefix before it; the root is (0, 0)."""
    def lane(seed: str) -> Column:
        return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "turn_hash"))

    order = Window.partitionBy("conv_id").orderBy("depth")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "words", lane("a").alias("x"), lane("b").alias("y"))
    rows = rows.withColumns({"a": F.bit_xor("x").over(so_far), "b": F.bit_xor("y").over(so_far), "ends": F.lead("depth").over(order).isNull()})
    above = [F.when(F.col("depth") > 0, F.col(c).bitwiseXOR(F.col(x))) for c, x in (("a", "x"), ("b", "y"))]
    return rows.select("conv_id", "depth", "a", "b", above[0].alias("pa"), above[1].alias("pb"), "words", "ends")


def nodes(steps: DataFrame) -> DataFrame:
    """Rows (a, b, pa, pb, conv_id, depth, n_convs, words, n_children), one per node."""
    own = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    counted = own.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    return own.join(counted, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def peel(tree: DataFrame, steps: DataFrame) -> DataFrame:
    """Rows (a, b, n_leaves, saved_tokens): each node's totals over its subtree.

    ``tree`` are the nodes, ``steps`` the paths of all conversations; both settled.
    """
    total = steps.count()
    state = tree.select(*NODE, "conv_id", "depth", "n_convs", F.col("n_children").alias("waits"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    routes, done, scratch = steps.select("conv_id", "depth", *NODE), None, []
    while True:
        state = settle(state, "trie-state")
        tips = state.where("waits = 0").select("conv_id", F.col("depth").alias("tip"))
        # every conversation has at most one tip on its path: nodes below a tip are done
        active = settle(routes.join(tips, "conv_id").where("depth <= tip").select(F.col("conv_id").alias("via"), "depth", *NODE), "trie-routes")
        known = state.select(*NODE, "n_convs", "waits", "leaves", "saved")
        held = join_counted(active, known, NODE, "n_convs", total)
        whole = Window.partitionBy("via")
        held = held.withColumn("stop", F.coalesce(F.max(F.when(F.col("waits") > 1, F.col("depth"))).over(whole), F.lit(-1).cast("long")))
        up = whole.orderBy(F.col("depth").desc())
        chain = settle(held.where("depth >= stop").select(*NODE, "depth", "stop", F.sum(F.when(F.col("depth") > F.col("stop"), F.col("leaves"))).over(up).alias("n_leaves"), F.sum(F.when(F.col("depth") > F.col("stop"), F.col("saved"))).over(up).alias("saved_tokens")), "trie-chain")
        own = chain.where("depth > stop").select(*NODE, "n_leaves", "saved_tokens")
        done = own if done is None else done.unionByName(own)
        sent = chain.where("depth = stop").groupBy(*NODE).agg(F.count("*").alias("told"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        if sent.isEmpty():
            return done
        left = state.join(own.select(*NODE), NODE, "left_anti").join(sent, NODE, "left")
        zero = F.lit(0).cast("long")
        before = state
        state = left.select(*NODE, "conv_id", "depth", "n_convs", (F.col("waits") - F.coalesce("told", zero)).alias("waits"), (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved"))
        scratch.append((before, active))
        if len(scratch) > 1:
            for old in scratch.pop(0):
                discard(old)


def end_hashes(steps: DataFrame) -> DataFrame:
    """Rows (a, b, ends_sha256) of the nodes at which conversations end: of their ids, ascending, joined by commas.

    Ids are dealt by range of (node, id), so a node with very many is spread over tasks, which join them to pieces of PIECE
    characters; only pieces of one node meet, as a stream.
    """
    ends = steps.where("ends").select(*NODE, "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, part, size, out = None, None, [], 0, []

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[*NODE, "first", "ids"])

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != node or size > PIECE:
                    if part:
                        out.append((*node, first, ",".join(part)))
                    node, first, part, size = (a, b), conv, [], 0
                part.append(str(conv))
                size += len(part[-1]) + 1
            if out:
                yield made(out)
                out = []
        if part:
            yield made([(*node, first, ",".join(part))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (a, b) != node:
                    if sha:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[*NODE, "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], names=[*NODE, "ends_sha256"])

    pieces = ends.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(joined, "a long, b long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "a long, b long, ends_sha256 string")


def trie(talks: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Empty table: no rows. Repeated rows are turns of their own; further columns are ignored.
    """
    importable(talks.sparkSession)
    steps = settle(paths(rebuilt(settle(ordered(talks), "trie-turns"))), "trie-paths")
    tree = settle(nodes(steps), "trie-nodes")
    if tree.isEmpty():
        totals = tree.select(*NODE, F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    else:
        totals = peel(tree, steps)
    parents = tree.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = join_counted(tree.where("depth > 0").select(*NODE, "pa", "pb"), parents, ["pa", "pb"], "n_children", tree.count())
    none = hashlib.sha256().hexdigest()
    all_of = tree.join(totals, NODE).join(below.select(*NODE, "parent_conv_id"), NODE, "left").join(end_hashes(steps), NODE, "left")
    return all_of.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def oracle() -> str:
    """The same rows from whole prefixes as lists; totals by comparing each node with the prefixes of all others."""
    from runlens.llm.turn_repair import crc_sql

    return f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc_sql('CAST(conv_id AS VARCHAR)')} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, x, words FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h UNION ALL SELECT c.conv_id, 1, pos, x, words FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos >= c.h),
o AS (SELECT conv_id, words, list(x) OVER w AS path, lead(pos) OVER (PARTITION BY conv_id ORDER BY part, pos) IS NULL AS ends FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
m AS (SELECT conv_id, array_to_string(path, ',') AS p, len(path) AS depth, array_to_string(path[:-2], ',') AS up, words, ends FROM o
  UNION ALL SELECT conv_id, '', 0, NULL, 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT p, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY p, depth),
k AS (SELECT n.p, count(b.p) AS n_children FROM n LEFT JOIN n b ON b.up = n.p GROUP BY n.p),
s AS (SELECT n.p, count(*) FILTER (k.n_children = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens FROM n JOIN n b ON n.p = '' OR b.p = n.p OR starts_with(b.p, n.p || ',') JOIN k ON k.p = b.p GROUP BY n.p)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256 FROM n JOIN k USING (p) JOIN s USING (p) LEFT JOIN n q ON q.p = n.up
"""  # noqa: E501
