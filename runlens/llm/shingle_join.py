"""Near-duplicates by the Jaccard similarity of five-word shingle sets: an exact similarity join on the vantage-point tree.

Two sets of similarity ``least`` or more differ in at most D members, which their sizes tell. Dealt by hash to D // 3 + 1
parts, they differ in at most two members in one part at least. A part's fingerprint has 64 bits, each the parity of
its members that hash to it, so those of that part lie at most ``RADIUS`` bits apart, as near_dup's vantage-point tree finds
them: no pair is lost. How many parts there are depends on the size of the larger set, by size classes (``schemes``); a
smaller set is also dealt as the next class does it. Parts of the same number and class are one space. A space of up to
near_dup.LARGE sets is a shard and searched in a task, by vantage points as long as they part it, then by one-bit neighbours;
a larger one is dealt to shards by the value of each of three blocks of the fingerprint's bits, of which two fingerprints within
the radius share one at least: every row goes three times, however large the space is. What is twice that large nevertheless, because so many
rows hold the same value, is joined by one-bit neighbours in Spark. Such links alone chain
parts of few members, the more the more sets there are, so a shard is parted again by what follows a part: of the parts in a ring, one
differs in at most its share of D together with the next, with the next two and so on (else the shares would sum up to over D), so a second fingerprint, of a part
and the ``CHAIN`` - 1 after it, differs there in no more bits than their share. What still hangs together is a group, and the pairs in it
within the radius are the candidates: similar sets lie within it in one space at least. Of these, pairs go whose sets differ too much for sure (parity bitmaps differ in no more bits than the sets
in members; a bitmap has a bit a member or more, so that it tells long sets apart, too), and what is
left is verified on the whole sets. Equal sets are reduced to one first. In a group
of over ``BIG`` rows a few pivots are compared with all first; once the components are known, only rows of different
components are still compared, by fingerprint, size and bitmap, and only pairs that these do not rule out are ever written.

Words and their lower case are those of near_dup.simhash; a text of fewer than five words is one shingle, null and empty
texts are equal. Shingles and sets stand for themselves by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from runlens.llm.common import among, discard, ranges, settle, text_blocks
from runlens.llm.near_dup import LARGE, RADIUS, contract, forest, neighbours

WORDS, LEAST = 5, 0.8
#: Ratio of the sizes that bound a class of sets. Share of a space on both sides of a vantage point above which a task splits it no further.
RATIO, BOTH = 1.5, 0.25
#: Parts in a row, at most, that the second fingerprint of a part covers; fingerprints of a shard compared with the rest at once.
CHAIN, FRONT = 3, 64
#: Bits (from, to) of a fingerprint: two within the radius are equal in one of these blocks at least. Sets whose parts are placed at once.
BLOCKS, AT_ONCE = ((0, 21), (21, 42), (42, 64)), 8192
#: Rows of a group that are compared all with all at once; pivots of larger groups; rows of a larger group that a task holds, and that pass by.
BIG, PIVOTS, PART, SLICE = 64, 8, 4096, 1 << 16
#: Bits of the smallest parity bitmap, a power of two. Bytes of the sets that are verified together.
BITS, BUNDLE = 128, 32 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    encoded = lists.flatten().dictionary_encode()
    hashed = np.array([xxh64_intdigest(w, 42) if w else 0 for w in encoded.dictionary.to_pylist()], np.uint64)
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    all_words = hashed[codes] if len(codes) else np.zeros(0, np.uint64)
    spoken = all_words != 0  # white space at the ends gives empty words
    edges = np.concatenate([[0], np.cumsum(spoken)])[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
    all_words, out = all_words[spoken], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        width = min(words, b - a)
        hashes = np.zeros(b - a - width + 1 if width else 0, np.uint64)
        for k in range(width):
            hashes = hashes * MULTIPLIER + all_words[a + k : b - width + 1 + k]
        out.append(np.unique(hashes))
    return out


def needed(n, least: float):
    """Members that a set of ``n`` must share with any set as similar as ``least``."""
    return np.ceil(least * n - 1e-9).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Jaccard similarity of two sorted sets of at least ``least``; two empty sets are equal."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= least * (len(both) - shared) - 1e-9


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(27))


def schemes(least: float) -> np.ndarray:
    """Rows (low, high, parts, bits, chain, within): pairs whose larger set is of a size from one class's bounds, members in [low, high), are dealt to so many parts, a member to so many bits; so many parts in a row differ in at most ``within`` members, from one part on at least."""
    out, edge = [], 2
    while edge < 1 << 31:
        high = max(edge + 1, int(edge * RATIO))
        differ = int(2 * (high - 1) * (1 - least) / (1 + least) + 1e-6)
        parts = differ // (RADIUS + 1) + 1
        if differ:  # else only equal sets are as similar
            chain = min(CHAIN, parts)
            out.append((max(1, int(needed(edge, least))), high, parts, max(1, RADIUS // (differ // parts)), chain, chain * differ // parts))
        edge = high
    return np.array(out, np.int64)


def layout(sizes: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets of these sizes, one after another: (set, scheme) of each time that a set is dealt, and the space of each part."""
    low, high, parts = schemes(least).T[:3]
    own, scheme = np.nonzero((sizes[:, None] >= low) & (sizes[:, None] < high))
    count = parts[scheme]
    return own, scheme, np.repeat(scheme << 48, count) | ranges(np.zeros(len(count), np.int64), count).astype(np.int64) << 24


def part_fingerprints(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, offsets by set) of the parts of all sets; those of different spaces are as far apart as random ones."""
    out, _, ends = chained_fingerprints(sets, least)
    return out, ends


def chained_fingerprints(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, second fingerprints, offsets by set) of the parts of all sets; the second ones have a bit for each member of a part and of those after it in its chain."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own, scheme, space = layout(sizes, least)
    _, _, parts, bits, chain, _ = schemes(least).T
    count, held = parts[scheme], sizes[own]
    members = mixed(np.concatenate(sets))[ranges((np.cumsum(sizes) - sizes)[own], held)]
    at = np.repeat(np.cumsum(count) - count, held) + ((members >> np.uint64(32)) * np.repeat(count.astype(np.uint64), held) >> np.uint64(32)).astype(np.int64)
    out = constant(space)
    for k in range(RADIUS):
        asked = np.repeat(bits[scheme] > k, held)
        np.bitwise_xor.at(out, at[asked], np.uint64(1) << (members[asked] >> np.uint64(6 * k) & np.uint64(63)))
    alone = np.zeros(len(out), np.uint64)
    np.bitwise_xor.at(alone, at, np.uint64(1) << (members >> np.uint64(6 * RADIUS) & np.uint64(63)))
    chained, place = alone.copy(), ranges(np.zeros(len(count), np.int64), count).astype(np.int64)
    first, ring, length = np.arange(len(out)) - place, np.repeat(count, count), np.repeat(chain[scheme], count)
    for k in range(1, CHAIN):
        chained ^= np.where(length > k, alone[first + (place + k) % ring], np.uint64(0))
    return out, chained, np.concatenate([[0], np.cumsum(np.bincount(own, count, len(sets)))]).astype(np.int32)


def bitmap(own: np.ndarray) -> bytes:
    """The parity bitmap of a set, the next power of two above its size in bits, ``BITS`` at least."""
    bits = max(BITS, 1 << max(0, len(own) - 1).bit_length())
    places = (own & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(bool)).tobytes()


class Bitmaps:
    """Parity bitmaps of different sizes, as 64-bit words one after another."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        column = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
        self.words = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
        self.size = pc.binary_length(column).to_numpy().astype(np.int64) // 8
        self.start = np.cumsum(self.size) - self.size

    def differ(self, at: np.ndarray, other: Bitmaps, there: np.ndarray) -> np.ndarray:
        """Bits in which rows ``at`` differ from the other's rows ``there``; the larger bitmap is folded to the smaller, which loses no member that both hold."""
        out = np.zeros(len(at), np.int64)
        kinds = self.size[at] << 32 | other.size[there]
        for kind in np.unique(kinds).tolist():
            one, two = kind >> 32, kind & 0xFFFFFFFF
            same, least = np.flatnonzero(kinds == kind), min(one, two)
            step = max(1, (1 << 21) // max(one, two))  # words held at once
            for k in range(0, len(same), step):
                now = same[k : k + step]
                a, b = (x.words[x.start[i[now], None] + np.arange(n)] for x, i, n in ((self, at, one), (other, there, two)))
                a, b = (np.bitwise_xor.reduce(x.reshape(len(now), -1, least), axis=1) for x in (a, b))
                out[now] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
        return out


def described(rows: DataFrame, words: int, least: float) -> DataFrame:
    """Rows (row, doc_id, fp, n, parts, chains, sketch): the set's hash, its size, both fingerprints of its parts, its parity bitmap."""

    def run(batches):
        for block in text_blocks(batches, "text"):
            sets = shingle_sets(block.column("text"), words)
            sketches = [bitmap(own) for own in sets]
            fps = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64)
            *both, ends = chained_fingerprints(sets, least)
            parts, chains = (pa.ListArray.from_arrays(pa.array(ends), pa.array(x.view(np.int64))) for x in both)
            yield pa.RecordBatch.from_arrays([block.column("row"), block.column("doc_id"), pa.array(fps.view(np.int64)), pa.array([len(s) for s in sets], pa.int64()), parts, chains, pa.array(sketches, pa.binary())], names=["row", "doc_id", "fp", "n", "parts", "chains", "sketch"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(run, f"row long, doc_id {kind}, fp long, n long, parts array<long>, chains array<long>, sketch binary")


def hang_together(points: np.ndarray, chains: np.ndarray, linked: np.ndarray, within: int) -> np.ndarray:
    """The smallest row that each row (distinct by both fingerprints) hangs together with: of the same number in ``linked`` and, from row to row, within the radius and ``within``."""
    label, order = np.arange(len(points)), np.argsort(linked, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(linked[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
    for start in np.flatnonzero(np.diff(cuts) > 1).tolist():
        rest = order[cuts[start] : cuts[start + 1]]
        while len(rest) > 1:
            root, front, rest = rest[0], rest[:1], rest[1:]
            while len(front) and len(rest):
                now, front = front[:FRONT], front[FRONT:]
                one, other = np.nonzero(np.bitwise_count(points[now, None] ^ points[rest]) <= RADIUS)
                hit = np.zeros(len(rest), bool)
                hit[other[np.bitwise_count(chains[now[one]] ^ chains[rest[other]]) <= within]] = True
                label[rest[hit]] = root
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return label


def constant(space: np.ndarray) -> np.ndarray:
    """What tells the fingerprints of a space from those of others."""
    return mixed(mixed(space.astype(np.uint64) + MULTIPLIER))


def packed(space: int, part: np.ndarray, chain: np.ndarray, row: np.ndarray) -> bytes:
    """Rows of one space, compressed: of few members a part has few bits, and rows that follow one another differ little."""
    after = np.diff(row, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return pa.Codec("zstd").compress((part ^ constant(np.array([space]))).tobytes() + chain.tobytes() + after.tobytes(), asbytes=True)


def unpacked(shard: int, many: int, held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, chain, row) as they were packed."""
    raw = pa.Codec("zstd").decompress(held, 24 * many, asbytes=True)
    part, chain = np.frombuffer(raw, np.uint64, 2 * many).reshape(2, many)
    after = np.frombuffer(raw, np.uint8, 8 * many, 16 * many).reshape(8, many).T
    return part ^ constant(np.array([shard >> 24 << 24])), chain, np.cumsum(np.ascontiguousarray(after).view("<i8").ravel())


def dealt(sizes: np.ndarray, parts: np.ndarray, least: float, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, place, set), in order of shards, of the parts of sets one after another: that of its space, or, where that goes in ``pieces``, one by each block of its bits."""
    own, scheme, space = layout(sizes, least)
    count = schemes(least)[scheme, 2]
    split = np.repeat(pieces[scheme], count)
    whole, apart = np.flatnonzero(split == 0), np.flatnonzero(split)
    shard, at = [space[whole]], [whole]
    for k, (low, high) in enumerate(BLOCKS if len(apart) else ()):
        value = parts[apart] >> np.uint64(low) & np.uint64((1 << high - low) - 1)
        shard.append(space[apart] | (k + 1) << 22 | (mixed(mixed(value + MULTIPLIER)) >> np.uint64(16)).astype(np.int64) % split[apart])
        at.append(apart)
    shard, at = np.concatenate(shard), np.concatenate(at)
    order = np.argsort(shard, kind="stable")
    return shard[order], at[order], np.repeat(own, count)[at[order]]


def groups(own: DataFrame, least: float) -> DataFrame:
    """Rows (shingle, point, fp, n): the sets of rows (row, fp, n, parts, chains) that hang together in a shard, with their own fingerprint there and a number of the group; a group may come once a block."""
    large = LARGE
    plan = schemes(least)
    held = own.agg(*(F.count_if((F.col("n") >= int(low)) & (F.col("n") < int(high))) for low, high, *_ in plan)).first()
    pieces = np.array([min(math.ceil(4 * k / large), (1 << 22) - 1) if k > large else 0 for k in held], np.int64)

    def place(batches, count: bool):
        for batch in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
            parts, chains = (batch.column(c).flatten().to_numpy().view(np.uint64) for c in ("parts", "chains"))
            shard, at, who = dealt(batch.column("n").to_numpy(), parts, least, pieces)
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, np.int64)
            shard, many = shard[cuts[:-1]], np.diff(cuts)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(many)], names=["shard", "many"])
                continue
            part, chain, row = parts[at], chains[at], batch.column("row").to_numpy()[who]
            blocks = [packed(s >> 24 << 24, part[a:b], chain[a:b], row[a:b]) for s, a, b in zip(shard.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(many), pa.array(blocks, pa.binary())], names=["shard", "many", "held"])

    def opened(group: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*map(unpacked, *(group.column(c).to_pylist() for c in ("shard", "many", "held"))), strict=True))

    def join(group: pa.Table) -> pa.Table:
        part, chain, row = opened(group)
        points, at = np.unique(part, return_inverse=True)
        a, b = (np.searchsorted(points, x) for x in forest(points, RADIUS, both=BOTH))
        label = np.arange(len(points))
        while True:
            new = label.copy()
            np.minimum.at(new, b, label[a])
            np.minimum.at(new, a, label[b])
            new = new[new]
            if (new == label).all():
                break
            label = new
        rows, at = np.unique(np.stack([at, chain.view(np.int64)]), axis=1, return_inverse=True)
        own, chains = rows[0].astype(np.int64), rows[1].view(np.uint64)
        together = hang_together(points[own], chains, label[own], int(plan[group.column("shard")[0].as_py() >> 48, 5]))[at.ravel()]
        more = np.flatnonzero(np.bincount(together)[together] > 1)
        root = together[more]
        return pa.table({"shingle": pa.array(mixed(points[own[root]] ^ mixed(chains[root] + MULTIPLIER)).view(np.int64)), "point": pa.array(part[more].view(np.int64)), "row": pa.array(row[more])})

    def alone(batches):
        for batch in batches:
            if batch.num_rows:
                part, _, row = opened(batch)
                yield pa.RecordBatch.from_arrays([pa.array(part.view(np.int64)), pa.array(row)], names=["point", "row"])

    given = own.select("row", "n", "parts", "chains")
    placed, kind = given.mapInArrow(lambda x: place(x, False), "shard long, many long, held binary"), "shingle long, point long, row long"
    if not pieces.any():
        found = placed.groupBy("shard").applyInArrow(join, kind)
    else:
        counted = given.mapInArrow(lambda x: place(x, True), "shard long, many long")
        big = settle(counted.groupBy("shard").agg(F.sum("many").alias("rows")).where(F.col("rows") > 2 * large).select("shard"), "large")
        found = placed.join(F.broadcast(big), "shard", "left_anti").groupBy("shard").applyInArrow(join, kind)
        if not big.isEmpty():
            rest = settle(placed.join(F.broadcast(big), "shard", "left_semi").mapInArrow(alone, "point long, row long").distinct(), "dense")
            roots = contract(neighbours(rest.select(F.col("point").alias("fp")))).select(F.col("fp").alias("point"), "root")
            found = found.unionByName(rest.join(roots, "point", "left").select(F.coalesce("root", "point").alias("shingle"), "point", "row"))
    return found.join(own.select("row", "fp", "n"), "row").select("shingle", "point", "fp", "n")


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """Rows (a, b, shingle, point, large) from rows (shingle, point, fp, n): the pairs of a group that are near enough in fingerprint and size, and the members (fp, n, shingle, point) of large groups, of which only the pivots are paired."""

    def run(batches):
        held, carried = None, []
        for batch in batches:
            now = np.stack([batch.column(c).to_numpy() for c in ("shingle", "fp", "n", "point")])
            if not now.shape[1]:
                continue
            now = now[:, np.concatenate([[True], (now[:, 1:] != now[:, :-1]).any(axis=0)])]  # a group that came by several blocks
            held = now if held is None else np.concatenate([held, now], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1]))  # the last group may go on in the next batch
            if not last and held.shape[1] > 1 << 16:  # a huge group: its pivots stay, the rest goes on
                carried = [held[0, 0]]
                yield from pairs(held, carried)
                held = held[:, np.sort(np.argsort(held[1])[:PIVOTS])]
                continue
            yield from pairs(held[:, :last], carried)
            held = held[:, last:]
        if held is not None:
            yield from pairs(held, carried)

    def pairs(part, carried):
        cuts = np.flatnonzero(np.concatenate([[True], part[0, 1:] != part[0, :-1], [True]])) if part.shape[1] else np.zeros(1, np.int64)
        many = np.flatnonzero(np.diff(cuts) > 1)
        out, size = [], 0
        for start, end in zip(cuts[many].tolist(), cuts[many + 1].tolist(), strict=True):
            shingle, fp, n, point = part[:, start:end]
            own = point.view(np.uint64)
            large = end - start > BIG or shingle[0] in carried
            for i in np.argsort(fp)[: PIVOTS if large else None].tolist():
                ok = (fp != fp[i]) & (np.bitwise_count(own ^ own[i]) <= RADIUS) & (np.minimum(n, n[i]) >= least * np.maximum(n, n[i]) - 1e-9)
                if ok.any():
                    none = np.zeros(int(ok.sum()), np.int64)
                    out.append((np.minimum(fp[ok], fp[i]), np.maximum(fp[ok], fp[i]), none, none, none))
                    size += int(ok.sum())
            if large:
                out.append((fp, n, np.ones(len(fp), np.int64), shingle, point))
            if size > 1 << 16:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    def batch_of(out):
        a, b, large, shingle, point = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(large.astype(bool)), pa.array(shingle), pa.array(point)], names=["a", "b", "large", "shingle", "point"])

    return rows.select("shingle", "fp", "n", "point").repartition("shingle").sortWithinPartitions("shingle", "fp", "point").mapInArrow(run, "a long, b long, large boolean, shingle long, point long")


def strangers(members: DataFrame, least: float) -> DataFrame:
    """Rows (a, b): the pairs of large groups, rows (shingle, point, fp, n, label, sketch), that differ in label and that fingerprints, sizes and bitmaps do not rule out.

    Rows of the commonest label of a group need no comparison with one another. The others are dealt to parts of about
    ``PART`` rows and compared within a part; what is in no part or an earlier one passes by, in slices of about ``SLICE``,
    batch by batch, so no task holds a group and a group of one part goes through the shuffle once.
    """
    counts = members.groupBy("shingle", "label").agg(F.count("*").alias("n"))
    groups = counts.groupBy("shingle").agg(F.max_by("label", F.struct("n", "label")).alias("commonest"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("size")).where("others > 0")
    groups = groups.select("shingle", "commonest", F.ceil(F.col("others") / PART).cast("int").alias("parts"), F.ceil(F.col("size") / SLICE).cast("int").alias("slices"))
    placed = members.join(groups, "shingle").withColumn("h", F.xxhash64("fp")).withColumn("own", F.when(F.col("label") != F.col("commonest"), F.pmod("h", F.col("parts")).cast("int")).otherwise(-1))
    held = F.when(F.col("own") >= 0, F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda k: F.struct(F.col("own").alias("part"), k.alias("slice"), F.lit(0).alias("role"))))
    later = F.when(F.col("own") < F.col("parts") - 1, F.transform(F.sequence(F.col("own") + 1, F.col("parts") - 1), lambda k: F.struct(k.alias("part"), F.pmod("h", F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"))))
    sent = placed.select("shingle", F.explode(F.concat(F.coalesce(held, F.array()), F.coalesce(later, F.array()))).alias("to"), "point", "fp", "n", "label", "sketch").select("shingle", "to.*", "point", "fp", "n", "label", "sketch")

    def run(batches):
        key, held, seen = None, [], set()
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, part, place, role = (batch.column(c).to_numpy() for c in ("shingle", "part", "slice", "role"))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(shingle) != 0) | (np.diff(part) != 0) | (np.diff(place) != 0) | (np.diff(role) != 0), [True]]))
            for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if (now := (shingle[start], part[start], place[start])) != key:
                    key, held = now, []
                block = batch.slice(start, end - start)
                rows = (*(block.column(c).to_numpy() for c in ("point", "fp", "n", "label")), Bitmaps(block.column("sketch")))
                asks = role[start] == 0
                found = [near(x, rows) for x in held if not asks or place[start] == 0]
                if asks:
                    held.append(rows)
                    if place[start] == 0:
                        found.append(near(rows, rows))
                fresh = {p for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)} - seen
                if fresh:
                    seen |= fresh  # the same pair stands in many groups
                    if len(seen) > 1 << 18:
                        seen.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*fresh, strict=True)], names=["a", "b"])

    def near(asked, rows):
        found = [(np.zeros(0, np.int64),) * 2]
        (xa, fa, na, la, sa), (xb, fb, nb, lb, sb) = asked, rows
        xa, xb = xa.view(np.uint64), xb.view(np.uint64)
        step = max(1, (1 << 20) // len(xb))
        for k in range(0, len(xa), step):
            i, j = np.nonzero(np.bitwise_count(xa[k : k + step, None] ^ xb[None, :]) <= RADIUS)
            i += k
            ok = (la[i] != lb[j]) & (np.minimum(na[i], nb[j]) >= least * np.maximum(na[i], nb[j]) - 1e-9)
            if asked is rows:
                ok &= i < j
            i, j = i[ok], j[ok]
            ok = sa.differ(i, sb, j) <= (na[i] + nb[j]) * (1 - least) / (1 + least) + 1e-6
            i, j = i[ok], j[ok]
            found.append((np.minimum(fa[i], fb[j]), np.maximum(fa[i], fb[j])))
        return map(np.concatenate, zip(*found, strict=True))

    return sent.repartition("shingle", "part", "slice").sortWithinPartitions("shingle", "part", "slice", "role").mapInArrow(run, "a long, b long")


def possible(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs but for those whose parity bitmaps tell that they are less similar than ``least``."""

    def run(batches):
        for batch in batches:
            at = np.arange(batch.num_rows)
            most = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) * (1 - least) / (1 + least)
            yield batch.select(["a", "b"]).filter(pa.array(Bitmaps(batch.column("xa")).differ(at, Bitmaps(batch.column("xb")), at) <= most + 1e-6))

    own = sketches.select("fp", "n", "sketch")
    return pairs.join(own.toDF("a", "na", "xa"), "a").join(own.toDF("b", "nb", "xb"), "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long")


def bundled(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows (a, b, bundle): each pair in one bundle, so that the sets of a bundle take about ``BUNDLE`` bytes and a set stands in few.

    A pair (a, b), a < b, goes where the least neighbour of ``a`` goes, so what is paired with the same sets shares a bundle, small clusters by
    hash; a cluster of over ``BUNDLE`` bytes is dealt to slices, and a bundle has the pairs of two slices.
    """
    least = pairs.groupBy("b").agg(F.min("a").alias("root")).withColumnRenamed("b", "a")
    owned = settle(pairs.join(least, "a", "left").select("a", "b", F.coalesce("root", "a").alias("root")), "clusters")
    members = owned.select("root", F.col("a").alias("fp")).union(owned.select("root", F.col("b").alias("fp"))).distinct()
    sizes = settle(members.join(sketches.select("fp", "n"), "fp").groupBy("root").agg((8 * F.sum("n")).alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    heavy = sizes.where(F.col("size") > BUNDLE).select("root", F.ceil(F.col("size") / BUNDLE).cast("int").alias("slices"))  # at most total / BUNDLE rows
    owned = owned.join(F.broadcast(heavy), "root", "left")
    one, other = (F.pmod(F.xxhash64(c), F.col("slices")) for c in ("a", "b"))
    light = F.pmod(F.xxhash64("root"), F.lit(4 * total // BUNDLE + 1))
    return owned.select("a", "b", F.when(F.col("slices").isNull(), light).otherwise(F.xxhash64("root", F.least(one, other), F.greatest(one, other))).alias("bundle"))


def verified(pairs: DataFrame, rows: DataFrame, sketches: DataFrame, words: int, least: float) -> DataFrame:
    """Of distinct pairs (a, b), a < b, of set hashes those whose sets are as similar as ``least``. A set goes to each of its bundles once, not to each of its pairs."""
    pairs = settle(possible(pairs, sketches, least), "candidates")
    pairs = settle(bundled(pairs, sketches), "bundles")
    own = pairs.select(F.col("a").alias("fp"), "bundle").union(pairs.select(F.col("b").alias("fp"), "bundle")).groupBy("fp").agg(F.collect_set("bundle").alias("bundles"))
    wanted = settle(sketches.select("fp", "row").join(own, "fp"), "wanted")  # few, so that texts need no shuffle
    texts = among(rows.select("row", "text"), wanted).join(wanted, "row").select("fp", "bundles", "text")

    def sets(batches):
        for block in text_blocks(batches, "text"):
            made, bundles = [s.tobytes() for s in shingle_sets(block.column("text"), words)], block.column("bundles")
            at = pc.list_parent_indices(bundles)
            yield pa.RecordBatch.from_arrays([bundles.flatten(), block.column("fp").take(at), pa.array(made, pa.binary()).take(at)], names=["bundle", "fp", "members"])

    def check(asked: pa.Table, held: pa.Table) -> pa.Table:
        members = dict(zip(held.column("fp").to_pylist(), (np.frombuffer(x.as_py(), np.uint64) for x in held.column("members")), strict=True))
        ok = [similar(members[a], members[b], least) for a, b in zip(asked.column("a").to_pylist(), asked.column("b").to_pylist(), strict=True)]
        return asked.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    made = texts.mapInArrow(sets, "bundle long, fp long, members binary")
    return settle(pairs.groupBy("bundle").cogroup(made.groupBy("bundle")).applyInArrow(check, "a long, b long"), "similar")


def representatives(rows: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Of rows (row, doc_id, text) one of each component of similar ones (row, doc_id): the smallest doc_id, nulls last, then row.

    ``rows`` is read several times and must be settled; ``row`` is a distinct long.
    """
    own = settle(described(rows, words, least), "parts")
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    distinct = settle(own.groupBy("fp").agg(F.min(ranked).alias("first"), F.min("row").alias("row")), "distinct")
    single = among(own, distinct)
    sketches = settle(single.select("fp", "row", "n", "sketch"), "sketches")
    found = settle(candidates(groups(single, least), least), "groups")
    discard(own)
    edges = verified(found.where("not large").select("a", "b").distinct(), rows, sketches, words, least)
    roots = settle(contract(edges), "components")
    large = found.where("large").select("shingle", "point", F.col("a").alias("fp")).distinct()
    if large.limit(1).count():
        labelled = large.join(roots, "fp", "left").withColumn("label", F.coalesce("root", "fp")).join(sketches.select("fp", "n", "sketch"), "fp")
        rest = settle(strangers(settle(labelled, "large"), least).distinct(), "strangers")
        more = None if rest.isEmpty() else verified(rest, rows, sketches, words, least)
        if more is not None and not more.isEmpty():
            roots = settle(contract(roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(more)), "components")
    named = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return named.select("first.row", "first.doc_id")
