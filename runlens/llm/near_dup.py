"""Near-duplicates by SimHash over word shingles, searched with a vantage-point tree.

Fingerprints are reduced to the distinct ones. A vantage-point tree, built from a bounded sample, partitions them by
Hamming distance. A fingerprint whose distance lies within half the radius of a node's threshold goes to both sides,
so by the triangle bound every pair within the radius meets in at least one shard. A shard splits on by vantage points
of its own until its blocks are small enough for exact comparison. Shards that are too large for a task are sampled and
routed again by trees of their own, in Spark; what the bounded sample of a turn cannot serve, and a ball too dense to
split, in a task or in Spark, is joined by one-bit neighbours instead, which is exact for a radius of two and linear: two fingerprints two bits apart have a neighbour in
common. A shard returns a spanning forest of its links, not
all pairs, and the components are contracted in Spark by alternating large and small stars.

Defined results: a null or empty text has fingerprint zero and links like any other. Repeated rows and exact copies
share a fingerprint and so a component. A null doc_id never names a component unless all of its members are null.
An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runlens.llm.common import discard, join_counted, settle, text_blocks

RADIUS = 2
#: Distinct fingerprints sampled for the tree at least and at most (the driver holds them), of the sample in a leaf at
#: least, wanted in a shard, compared all with all. The sample grows with the number of shards.
SAMPLE, MOST, LEAF, SHARD, BLOCK = 4096, 1 << 18, 32, 8192, 768
#: Fingerprints of a shard above which it is routed again, and how often.
LARGE, TURNS = 8 * SHARD, 3
ONE = np.uint64(1)
FLIPS = np.concatenate([[np.uint64(0)], ONE << np.arange(64, dtype=np.uint64)])


def simhash(text: str | None, words: int = 3) -> int:
    """64 bits: each is 1 if it is set in over half of the shingles' hashes (XXH64, seed 42), repeats included."""
    raw = (text or "").encode().lower().split()
    if not raw:
        return 0
    joined = b" ".join(raw)
    if len(raw) <= words:
        hashes = [xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in raw])
        starts = np.concatenate([[0], ends[:-words]]).tolist()
        view = memoryview(joined)
        hashes = [xxh64_intdigest(view[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for block in text_blocks(batches, "text"):
            values = np.array([simhash(t, words) for t in block.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(values)], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int]:
    """Of a few candidates, the point whose threshold parts the rest most evenly with the fewest rows on the boundary."""
    best = None
    for p in rng.choice(points, min(5, len(points)), replace=False):
        d = distance(points, p)
        mu = int(np.median(d))
        for m in (mu - 1, mu):
            inside, edge = int((d <= m).sum()), int(((d == m) | (d == m + 1)).sum())
            cost = max(inside, len(points) - inside) + edge
            if best is None or cost < best[0]:
                best = (cost, p, m)
    return best[1], best[2]


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple | None:
    """A tree (point, threshold, near, far) of at most 2 ** depth shards; None is a shard."""
    if depth == 0 or len(sample) < LEAF:
        return None
    point, mu = vantage(sample, rng)
    d = distance(sample, point)
    return int(point), mu, grow(sample[d <= mu], depth - 1, rng), grow(sample[d > mu], depth - 1, rng)


def shards(tree: tuple | None, fps: np.ndarray, at: np.ndarray, half: int, path: int = 1):
    """Yield (shard, rows): rows within ``half`` of a threshold go both ways."""
    if tree is None or not len(at):
        yield path, at
        return
    point, mu, near, far = tree
    d = distance(fps[at], np.uint64(point))
    yield from shards(near, fps, at[d <= mu + half], half, 2 * path)
    yield from shards(far, fps, at[d > mu - half], half, 2 * path + 1)


def settle_labels(labels: np.ndarray, groups: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Minimum label over each group (sorted group numbers of members), repeated until nothing changes."""
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(groups) > 0]))
    lengths = np.diff(np.concatenate([cuts, [len(groups)]]))
    while True:
        least = np.repeat(np.minimum.reduceat(labels[members], cuts), lengths)
        new = labels.copy()
        np.minimum.at(new, members, least)
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def forest(fps: np.ndarray, radius: int = RADIUS, seed: int = 7, both: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a < b, that join the same fingerprints as all pairs within the radius do. ``fps`` are distinct.

    Where a vantage point sends more than the share ``both`` to both sides, they are joined without further splits.
    """
    rng, half, links = np.random.default_rng(seed), radius // 2 + radius % 2, []

    def exact(own: np.ndarray) -> None:
        pairs = distance(own[:, None], own[None, :]) <= radius
        if pairs.sum() == len(own):
            return
        label = np.arange(len(own))
        while True:
            new = np.where(pairs, label[None, :], len(own)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        links.append((own[label], own))

    def dense(own: np.ndarray) -> None:
        variants = (own[:, None] ^ FLIPS[None, :]).ravel()
        order = np.argsort(variants, kind="stable")
        ranked = variants[order]
        same = np.concatenate([[False], ranked[1:] == ranked[:-1], [False]])
        shared = np.flatnonzero(same[1:] | same[:-1])  # variants of two or more
        if len(shared):
            label = settle_labels(np.arange(len(own)), np.cumsum(~same[shared]), order[shared] // 65)
            moved = np.flatnonzero(label != np.arange(len(own)))
            links.append((own[label[moved]], own[moved]))

    def search(own: np.ndarray) -> None:
        if len(own) <= BLOCK:
            return exact(own)
        point, mu = vantage(own if len(own) <= SAMPLE else rng.choice(own, SAMPLE, replace=False), rng)
        d = distance(own, point)
        near, far = own[d <= mu + half], own[d > mu - half]
        if max(len(near), len(far)) > 0.9 * len(own) or len(near) + len(far) > (1 + both) * len(own):
            if radius == 2:
                return dense(own)
            for k in range(0, len(own), BLOCK):  # exact, block against the rest
                for j in range(k, len(own), BLOCK):
                    exact(np.unique(np.concatenate([own[k : k + BLOCK], own[j : j + BLOCK]])))
            return None
        search(near)
        search(far)

    search(np.unique(fps))
    if not links:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
    return both[0], both[1]


def sampled(fps: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` fingerprints, those with the smallest hashes."""
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(size).toArrow()
    return rows.column("fp").combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def depth(n: int, shard: int) -> int:
    return max(0, math.ceil(math.log2(max(1, n / shard))))


def spanning(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that span each shard of ``rows`` (shard, fp), one shard a group."""

    def join(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return rows.groupBy("shard").applyInArrow(join, "a long, b long")


def neighbours(rows: DataFrame) -> DataFrame:
    """Links (a, b) that span what lies within a radius of two, by the fingerprints one bit away; no group is held by a task."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64 if k == 63 else 0)) for k in range(64)))
    variants = rows.select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    least = settle(variants.groupBy("variant").agg(F.min("fp").alias("b"), F.count("*").alias("copies")).where("copies > 1"), "variants")
    return variants.join(least.select("variant", "b"), "variant").where("fp <> b").select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()


def links(distinct: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD, large: int = LARGE, turns: int = TURNS, most: int = MOST) -> DataFrame:
    """Rows (a, b) that span every component of the distinct fingerprints (column fp, ``n`` rows).

    A turn samples at most about ``most`` fingerprints for the trees of its large shards, the largest first. At a radius
    of two, large shards beyond that, and those that stay large after the last turn, are joined by one-bit neighbours, so
    no task holds over ``large`` fingerprints as a group. At another radius they are held whole by a task.
    """
    half = radius // 2 + radius % 2
    rng = np.random.default_rng(11)
    trees = {0: grow(sampled(distinct, min(most, max(SAMPLE, 2 * LEAF * n // shard))), depth(n, shard), rng)}
    rows, found, dense = distinct.select(F.lit(0).cast("long").alias("shard"), "fp"), [], []

    def routed(rows: DataFrame, trees: dict) -> DataFrame:
        def route(batches):
            for batch in batches:
                fps, owner = batch.column("fp").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
                for own in np.unique(owner).tolist():
                    for path, at in shards(trees[own], fps, np.flatnonzero(owner == own), half):
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), (own << 18) + path, np.int64)), batch.column("fp").take(pa.array(at))], names=["shard", "fp"])

        return settle(rows.mapInArrow(route, "shard long, fp long"), "shards")

    for turn in range(turns):
        rows = routed(rows, trees)
        big = settle(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > large), "large")
        wanted = min(SAMPLE, most)  # of a shard's fingerprints
        sizes = {r.shard: r.n for r in big.orderBy(F.desc("n"), "shard").limit(max(1, most // wanted)).collect()} if turn < turns - 1 else {}
        found.append(spanning(rows.join(big, "shard", "left_anti"), radius))
        keys = F.broadcast(distinct.sparkSession.createDataFrame([(k, v // wanted + 1) for k, v in sizes.items()], "shard long, one_in long"))  # at most most / wanted rows
        rest = big.join(keys, "shard", "left_anti")
        if not rest.isEmpty():
            dense.append(rows.join(rest, "shard", "left_semi"))
        if not sizes:
            break
        rows = rows.join(keys, "shard")
        samples = rows.where(F.pmod(F.xxhash64("fp"), F.col("one_in")) == 0).select("shard", "fp").toArrow()  # about ``most`` rows
        owner, points = samples.column("shard").to_numpy(), samples.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        trees = {k: grow(points[owner == k], depth(v, shard), rng) for k, v in sizes.items()}
        rows = rows.select("shard", "fp")
    if dense:
        dense = reduce(DataFrame.union, dense)
        found.append(neighbours(dense) if radius == 2 else spanning(dense, radius))
    return reduce(DataFrame.union, found)


def contract(edges: DataFrame) -> DataFrame:
    """Connected components by alternating large and small stars: rows (fp, root) for every linked fingerprint."""
    now = settle(edges.where("a <> b").distinct(), "links")
    before, n = None, now.count()
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies")).select("u", F.least("u", "m").alias("m"), "copies"), "least")
        large = join_counted(both, least, "u", "copies", 2 * n).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        small = settle(small.where("a <> b").distinct(), "stars")
        state = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        discard(now), discard(least)
        now, n = small, state.n
        if (state.n, state.h) == before:
            return now.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias("root"))
        before = (state.n, state.h)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable)."""
    own = settle(fingerprints(docs, words), "fingerprints")
    distinct = settle(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    size = distinct.agg(F.count("*").alias("n"), F.sum("copies").alias("total")).first()
    found = settle(contract(links(distinct, size.n, radius)), "components")
    linked = found.select("fp", "root").union(found.select(F.col("root").alias("fp"), "root").distinct())
    linked = settle(linked.join(distinct, "fp"), "linked")
    least = settle(linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("members")), "roots")
    named = distinct.join(join_counted(linked.select("fp", "root"), least, "root", "members", linked.count()).select("fp", "component"), "fp", "left").select("fp", "copies", F.coalesce("component", "first").alias("component_id"))
    return join_counted(own, settle(named, "named"), "fp", "copies", size.total or 0).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
