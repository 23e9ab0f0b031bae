"""Best-fit packing of tokenized documents by a grouping genetic algorithm on islands.

Documents are tokenized, documents longer than a sequence are cut, and the pieces are packed. Pieces are dealt by row
number to shards of bounded size; only row numbers and lengths travel. In every shard several islands breed packings of
their own from different founders: crossover injects whole well-filled bins of one parent into the other, removes the
bins that hold duplicates, lets displaced pieces take the places of smaller ones where that fills a bin better, and
best-fits the rest; mutation opens the emptiest bins and some others. The elites of a shard's islands then migrate to one
population, which breeds on. Breeding ends when a lower bound proves the packing best, or after ``STALE`` children
without a gain. The emptiest bins of every shard then migrate to a next level of shards, which breed anew, until one
shard is left: so the last open bins of different shards meet.

Defined results: a null or empty text is one token (the closing id). Repeated rows are packed as often as they occur.
Null ids stay null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.bpe import tokenizer
from runlens.llm.common import settle, text_blocks

SEQUENCE, END = 4096, 1
#: Pieces a shard holds on average; islands a shard has; packings an island keeps.
SHARD, ISLANDS, POPULATION = 8192, 3, 6
#: Children bred in a phase at most, and in a row without a gain.
ROUNDS, STALE = 200, 30
#: Of a shard's bins, the emptiest that migrate to the next level: one in so many, and so many at least, but half of few bins.
OPEN, FEWEST = 32, 16
#: UTF-8 bytes tokenized at once.
BLOCK = 16 << 20


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end: int = END) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids plus the closing id, cut only where longer."""

    def run(batches):
        bpe = tokenizer(vocabulary)
        for block in text_blocks(batches, "text", BLOCK):
            ids, edges = bpe.encode(block.column("text"))
            doc, at, start, size, crc = [], [], [], [], []
            close = np.array([end], "<u4")
            for k in range(block.num_rows):
                own = np.concatenate([ids[edges[k] : edges[k + 1]].astype("<u4"), close])
                for i, s in enumerate(range(0, len(own), sequence)):
                    part = own[s : s + sequence]
                    doc.append(k), at.append(i), start.append(s), size.append(len(part)), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(at, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(order: np.ndarray, size: np.ndarray, room: int, bins: list[list[int]]) -> list[list[int]]:
    """Put pieces, in this order, each where the least room is left; new bins where none fits. ``bins`` is extended."""
    left = [room - int(size[b].sum()) for b in bins]
    free = sorted((r, k) for k, r in enumerate(left) if r > 0)
    for i in order.tolist():
        n = int(size[i])
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, k = free.pop(at)
        else:
            r, k = room, len(bins)
            bins.append([])
        bins[k].append(i)
        if r > n:
            bisect.insort(free, (r - n, k))
    return bins


def lower_bound(size: np.ndarray, room: int) -> int:
    """No packing has fewer bins: total size, pieces of which a bin holds k at most, and for every threshold the pieces too large to share a bin."""
    if not len(size):
        return 0
    own = np.sort(size)
    ends = np.concatenate([[0], np.cumsum(own)])
    half = int(np.searchsorted(own, room / 2, side="right"))
    cuts = np.unique(np.concatenate([[0], own[:half]]))
    alone = len(own) - np.searchsorted(own, room - cuts, side="right")  # no piece of at least the threshold fits beside
    above = len(own) - half - alone
    free = above * room - (ends[len(own) - alone] - ends[half])
    below = ends[half] - ends[np.searchsorted(own[:half], cuts, side="left")]
    crowd = max(-(-(len(own) - int(np.searchsorted(own, room / (k + 1), side="right"))) // k) for k in range(1, 17))
    return int(max(math.ceil(int(ends[-1]) / room), crowd, (alone + above + np.maximum(0, -(-(below - free) // room))).max()))


def fullest_fit(order: np.ndarray, size: np.ndarray, room: int) -> list[list[int]]:
    """Bins opened by the pieces in this order, each filled as full as one or two further pieces can, until nothing fits."""
    where: list[list[int]] = [[] for _ in range(room + 1)]
    for i in order[::-1].tolist():
        where[size[i]].append(i)
    count = np.array([len(w) for w in where])
    known, bins, used = np.flatnonzero(count), [], np.zeros(len(size), bool)
    gone = 0
    for i in order.tolist():
        if used[i]:
            continue
        n = int(size[i])
        where[n].remove(i) if where[n][-1] != i else where[n].pop()
        used[i], own, left = True, [i], room - n
        count[n] -= 1
        gone += not count[n]
        while left > 0:
            if gone > 64:
                known, gone = known[count[known] > 0], 0
            fits = known[: np.searchsorted(known, left, side="right")]
            fits = fits[count[fits] > 0]
            if not len(fits):
                break
            one = int(fits[-1])
            take = [one]
            if one < left:
                rest = left - fits
                second = fits[np.maximum(np.searchsorted(fits, rest, side="right") - 1, 0)]
                total = np.where((second <= rest) & ((second != fits) | (count[fits] > 1)), fits + second, fits)
                best = int(np.argmax(total))
                if total[best] > one:
                    take = [int(fits[best]), int(total[best] - fits[best])]
            for t in take:
                if t:
                    k = where[t].pop()
                    used[k] = True
                    own.append(k)
                    count[t] -= 1
                    gone += not count[t]
                    left -= t
        bins.append(own)
    return bins


def fitness(bins: list[list[int]], size: np.ndarray, room: int) -> tuple[int, float]:
    """Fewer bins first; among as many, the more uneven fill, which leaves room to empty a bin."""
    fill = fills(bins, size) / room
    return len(bins), -float((fill**2).sum())


def fills(bins: list[list[int]], size: np.ndarray) -> np.ndarray:
    if not bins:
        return np.zeros(0, np.int64)
    starts = np.cumsum([0, *(len(b) for b in bins[:-1])])
    return np.add.reduceat(size[np.concatenate([np.array(b) for b in bins])], starts)


def swap(bins: list[list[int]], loose: list[int], size: np.ndarray, room: int) -> list[int]:
    """Displaced pieces take the places of smaller ones, or of two, where a bin gets fuller; what is displaced in the end."""
    held = sorted((int(size[i]), i) for i in loose)
    left = room - fills(bins, size)
    for k in np.flatnonzero(left > 0).tolist():
        b, free, best = bins[k], int(left[k]), None
        for x in range(len(b)):
            for y in range(x, len(b)):
                out = int(size[b[x]]) + (int(size[b[y]]) if y > x else 0)
                at = bisect.bisect_right(held, (out + free, 1 << 60)) - 1
                gain = held[at][0] - out if at >= 0 else 0
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, x, y, at
        if best:
            _, x, y, at = best
            out = {b[x], b[y]}
            n, i = held.pop(at)
            bins[k] = [j for j in b if j not in out] + [i]
            for j in out:
                bisect.insort(held, (int(size[j]), j))
    return [i for _, i in held]


def cross(mother: list[list[int]], father: list[list[int]], size: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    """Inject some of the father's fullest bins into the mother; her bins with duplicates go, their rest is fitted again."""
    fullest = np.argsort(-fills(father, size), kind="stable")[: max(1, len(father) // 2)]
    most = max(1, min(64, len(fullest) // 4))
    take = rng.choice(fullest, size=int(rng.integers(1, most + 1)), replace=False)
    injected = [list(father[k]) for k in take]
    inside = np.zeros(len(size), bool)
    inside[[i for b in injected for i in b]] = True
    return refit(injected + [list(b) for b in mother if not inside[b].any()], len(injected), size, room, rng)


def mutate(bins: list[list[int]], size: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    return refit([list(b) for b in bins], 0, size, room, rng)


def refit(kept: list[list[int]], fixed: int, size: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    """Open the emptiest bins and a few others, but not the first ``fixed``, and fit all that is displaced."""
    free = len(kept) - fixed
    if free > 0:
        fill = fills(kept[fixed:], size)
        some = {int(k) + fixed for k in np.argsort(fill, kind="stable")[: int(rng.integers(1, 4))]}
        some |= {int(k) + fixed for k in rng.integers(0, free, int(rng.integers(0, 9)))}
        kept = [b for k, b in enumerate(kept) if k not in some]
    held = np.zeros(len(size), bool)
    held[[i for b in kept for i in b]] = True
    loose = swap(kept, np.flatnonzero(~held).tolist(), size, room)
    loose = np.array(sorted(loose, key=lambda i: (-size[i], i)), np.int64)
    if rng.random() < 0.5 and len(loose):  # displaced pieces may fill bins of their own better than gaps
        packed = fullest_fit(loose, size, room)
        fill = fills(packed, size)
        good = [b for b, f in zip(packed, fill, strict=True) if f >= 0.99 * room]
        done = {i for b in good for i in b}
        kept, loose = kept + good, loose[[i not in done for i in loose.tolist()]] if done else loose
    return best_fit(loose, size, room, kept)


def founder(k: int, size: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    """The k-th founder: best fit in decreasing order, fullest fit, and both in noisy orders; every island has its own noise."""
    noise = rng.uniform(0, 0.05 * room * (k // 2), len(size)) if k > 1 else 0
    order = np.argsort(-(size + noise), kind="stable")
    return fullest_fit(order, size, room) if k % 2 else best_fit(order, size, room, [])


def evolve(size: np.ndarray, room: int, seed: int, start: list[list[list[int]]] = (), population: int = POPULATION, rounds: int = ROUNDS, stale: int = STALE) -> list[list[int]]:
    """The best packing bred from ``start``, or from founders of its own; ends when it is proved best or gains stop."""
    rng, least = np.random.default_rng(seed), lower_bound(size, room)
    people = list(start)
    for k in range(0 if not people else population, population):
        people.append(founder(k, size, room, rng))
        if len(people[-1]) <= least:
            return people[-1]
    ranked = sorted(((fitness(b, size, room), k, b) for k, b in enumerate(people)), key=lambda x: x[:2])
    quiet = 0
    for k in range(rounds):
        if ranked[0][0][0] <= least or quiet >= stale:
            break
        if len(ranked) > 1 and rng.random() < 0.7:
            a, b = sorted(rng.choice(len(ranked), 2, replace=False).tolist())
            child = cross(ranked[a][2], ranked[b][2], size, room, rng)
        else:
            child = mutate(ranked[0][2], size, room, rng)
        own = fitness(child, size, room)
        quiet = 0 if own < ranked[0][0] else quiet + 1
        if all(own != r[0] for r in ranked):
            ranked.append((own, population + k, child))
            ranked.sort(key=lambda x: x[:2])
            del ranked[population:]
    return ranked[0][2]


def numbered_bins(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def grouped(bins: np.ndarray) -> list[list[int]]:
    order = np.argsort(bins, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)]


def level(rows: DataFrame, shards: int, number: int, sequence: int, islands: int) -> DataFrame:
    """Rows (row, length) bred in shards: (row, length, shard, bin, open); ``open`` bins may still meet others."""
    last = shards == 1

    def island(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("row", ignore_index=True)
        part["bin"] = numbered_bins(evolve(part["length"].to_numpy(), sequence, seed=1000 * key[0] + 10 * number + key[1]), len(part))
        return part

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        elites = [p.sort_values("row", ignore_index=True) for _, p in part.groupby("island")]
        out = elites[0][["row", "length", "shard"]].copy()
        size = out["length"].to_numpy()
        bins = evolve(size, sequence, seed=key[0], start=[grouped(p["bin"].to_numpy()) for p in elites])
        leave = np.zeros(len(bins), bool)
        if not last:
            leave[np.argsort(fills(bins, size), kind="stable")[: max(min(FEWEST, len(bins) // 2), len(bins) // OPEN)]] = True
        out["bin"] = numbered_bins(bins, len(out))
        out["open"] = leave[out["bin"].to_numpy()]
        return out

    spread = rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(shards)).cast("int"))
    spread = spread.withColumn("island", F.explode(F.array(*(F.lit(i) for i in range(islands)))))
    bred = spread.groupBy("shard", "island").applyInPandas(island, "row long, length long, shard int, island int, bin long")
    return bred.groupBy("shard").applyInPandas(meet, "row long, length long, shard int, bin long, open boolean")


def pack(items: DataFrame, sequence: int = SEQUENCE, shard: int = SHARD, islands: int = ISLANDS) -> DataFrame:
    """Add sequence_id and offset to pieces with a ``length`` of at most ``sequence``; offsets are gapless from 0.

    ``items`` has a column ``row``, a distinct long that stays the same when it is read again (a settled table); it is dropped.
    """
    columns = [c for c in items.columns if c != "row"]
    rows, placed, number = items.select("row", "length"), [], 0
    n = rows.count()
    while True:
        shards = max(1, math.ceil(n / shard))
        bred = settle(level(rows, shards, number, sequence, islands), f"bred{number}")
        placed.append(bred.where("not open").select("row", ((F.lit(number).cast("long") * (1 << 56)) + F.col("shard").cast("long") * (1 << 32) + F.col("bin")).alias("sequence_id")))
        if shards == 1:
            break
        rows, number = bred.where("open").select("row", "length"), number + 1
        n = rows.count()
    found = reduce(DataFrame.unionByName, placed)
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return items.join(found, "row").withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenize once into a settled table of pieces, then pack them."""
    return pack(settle(pieces(docs, vocabulary, sequence).withColumn("row", F.monotonically_increasing_id()), "pieces"), sequence)
