"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of lower-cased words without punctuation. Seeds are windows of ``least``
words that a document shares with an item (found by a rolling polynomial hash over the benchmark's vocabulary and
checked word by word). For every document and item with enough seeds, the longest common tiles that do not overlap are
marked again and again, longest first, down to ``least`` words. An item is leaked if tiles cover at least ``coverage`` of
its words, in whatever order its passages stand.

The benchmark is sent to the workers in blocks of about ``BLOCK`` bytes; a larger benchmark takes several passes over
the documents, one block after another, so driver and workers hold one block. No shuffle is needed. A worker makes the
index of a block once. Where a document and an item hold few pairs of places with the same seed, these are listed and
runs of them on a diagonal are the matches; where words repeat so that there are over ``PAIRS`` of them, matches of each
length are found by Karp-Rabin hashes instead, longest length first, in memory linear in both texts. Both mark the same
tiles.

Defined results: items of fewer than ``least`` words are too short to be evidence and never match. Null or empty texts
never match. Repeated rows are reported as often as they occur, and every row of the benchmark is an item of its own, its
id null or repeated or not. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from runlens.llm.common import settle, text_blocks, word_codes

LEAST, COVERAGE = 5, 0.5
#: Bytes of benchmark text in a pass.
BLOCK = 32 << 20
#: Pairs of places of a document and an item that are written out.
PAIRS = 1 << 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")


def bare(word: str) -> str:
    return "".join(WORD.findall(word.lower()))


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all windows of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * MULTIPLIER + ids[k : k + n].astype(np.uint64)
    return out


class Benchmark:
    """Items as word ids, and the seeds that lead to them."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST):
        self.least, self.vocabulary = least, {}
        self.names = [name for name, _ in items]
        self.words = {}
        for key, (_, text) in enumerate(items):  # by position, as ids may be null or repeat
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in map(bare, (text or "").split()) if w]
            if len(ids) >= least:
                self.words[key] = np.array(ids, np.int64)
        places = defaultdict(list)
        for key, ids in self.words.items():
            for at, h in enumerate(rolling(ids, least).tolist()):
                places[h].append((key, at))
        self.hashes = np.array(sorted(places), np.uint64)
        self.places = [places[h] for h in self.hashes.tolist()]

    def seeds(self, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in concatenated documents where a seed begins, and which seed. Words outside the vocabulary are 0."""
        if not len(self.hashes) or len(ids) < self.least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(ids) - self.least + 1
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        good = known[self.least :] - known[:-self.least] == self.least
        for k in range(1, self.least):  # not across two documents
            inner = edges[1:-1] - k
            good[inner[(inner >= 0) & (inner < n)]] = False
        at = np.flatnonzero(good)
        h = np.zeros(len(at), np.uint64)
        for k in range(self.least):
            h = h * MULTIPLIER + ids[at + k].astype(np.uint64)
        found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[found] == h
        return at[hit], found[hit]

    def matches(self, ids: np.ndarray, edges: np.ndarray, coverage: float):
        """Yield (document, item, covered words, tiles, longest tile) of every leak."""
        at, seed = self.seeds(ids, edges)
        owner = np.searchsorted(edges, at, side="right") - 1
        for doc in np.unique(owner):
            by_item = defaultdict(list)  # per item, pairs (places in the document, places in the item) of each seed
            first, last = np.searchsorted(owner, [doc, doc + 1])
            order = first + np.argsort(seed[first:last], kind="stable")
            cuts = np.flatnonzero(np.diff(seed[order])) + 1
            for here in np.split(order, cuts):
                there = defaultdict(list)
                for key, j in self.places[seed[here[0]]]:
                    there[key].append(j)
                for key, js in there.items():
                    by_item[key].append((at[here], js))
            for key, held in by_item.items():
                item = self.words[key]
                reach = np.zeros(len(item), bool)
                for _, there in held:
                    for j in there:
                        reach[j : j + self.least] = True
                if reach.sum() < coverage * len(item):  # tiles lie within seeds, so they cannot cover more
                    continue
                if sum(len(here) * len(there) for here, there in held) > PAIRS:
                    start = min(int(here[0]) for here, _ in held)
                    end = max(int(here[-1]) for here, _ in held) + self.least
                    sizes = running_tiles(ids[start:end], item, self.least)
                else:
                    i = np.concatenate([np.repeat(here, len(there)) for here, there in held])
                    j = np.concatenate([np.tile(there, len(here)) for here, there in held])
                    same = np.ones(len(i), bool)
                    for k in range(self.least):
                        same &= ids[i + k] == item[j + k]
                    sizes = tiles(i[same], j[same], self.least, len(item))
                if sizes and sum(sizes) >= coverage * len(item):
                    yield int(doc), key, sum(sizes), len(sizes), max(sizes)


def tiles(i: np.ndarray, j: np.ndarray, least: int, size: int) -> list[int]:
    """Greedy string tiling over verified seeds (places in the document, places in the item): the tiles' lengths, longest first.

    Runs of seeds on one diagonal are the maximal matches; the longest unmarked one is marked, what is left of others
    that it touches is tried again, until the item has no room for a tile.
    """
    if not len(i):
        return []
    order = np.lexsort((j, i - j))
    i, j = i[order], j[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(j) > 1)]))
    last = np.concatenate([cut[1:], [len(j)]]) - 1
    length = j[last] - j[cut] + least
    base = int(i.min())
    item, doc, out = np.zeros(size, bool), np.zeros(int(i.max()) + least - base, bool), []
    queue = list(zip((-length).tolist(), j[cut].tolist(), (i[cut] - base).tolist(), strict=True))
    heapq.heapify(queue)
    room = size
    while queue and room >= least:
        n, y, x = heapq.heappop(queue)
        taken = item[y : y - n] | doc[x : x - n]
        if not taken.any():
            item[y : y - n] = doc[x : x - n] = True
            out.append(-n)
            room += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= least:
                heapq.heappush(queue, (start - end, y + start, x + start))
    return out


class Windows:
    """Karp-Rabin hashes of the windows of one sequence, of any width, modulo two primes."""

    PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1220703125)

    def __init__(self, ids: np.ndarray, reach: int):
        self.ids, self.sums, self.powers = ids, [], []
        for prime, base in zip(self.PRIMES, self.BASES, strict=True):
            power = np.ones(1, np.int64)
            while len(power) < reach:  # base ** k, doubled in length each time
                power = np.concatenate([power, power * (int(power[-1]) * base % prime) % prime])
            terms = (ids.astype(np.int64) + 2) % prime * power[: len(ids)] % prime
            self.sums.append(np.concatenate([[0], np.cumsum(terms)]))  # below 2 ** 63 for 2 ** 32 words
            self.powers.append(power[:reach])

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        """Equal words give equal hashes, in every sequence made with the same reach."""
        first, second = (
            (sums[places + width] - sums[places]) % prime * power[len(power) - 1 - places] % prime
            for sums, power, prime in zip(self.sums, self.powers, self.PRIMES, strict=True)
        )
        return first << 31 | second


def running_tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[int]:
    """What tiles() gives, without the pairs of places: running Karp-Rabin, from the longest common length down.

    A halving search finds the longest length at which unmarked windows share a hash, all tiles of that length are
    checked word by word and marked in order of their places, then shorter ones are sought. A tile's length occurs in
    a bounded number of rounds: different lengths add up to no more than the item.
    """
    reach = max(len(doc), len(item))
    mine, theirs = Windows(doc, reach), Windows(item, reach)
    marked = [np.zeros(len(doc), bool), np.zeros(len(item), bool)]
    out, upper = [], min(len(doc), len(item))

    def free(side: int, width: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(marked[side])])
        return np.flatnonzero(sums[width:] == sums[: len(sums) - width])

    def common(width: int) -> tuple:
        x, y = free(0, width), free(1, width)
        hx, hy = mine.at(x, width), theirs.at(y, width)
        x, hx = (v[np.isin(hx, hy)] for v in (x, hx))
        y, hy = (v[np.isin(hy, hx)] for v in (y, hy))
        return x, hx, y, hy

    while upper >= least:
        low, high = least - 1, upper
        while low < high:  # no longer length than high has a match
            middle = (low + high + 1) // 2
            if len(common(middle)[0]):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        x, hx, y, hy = common(low)
        order = np.argsort(hx, kind="stable")
        ranked, places = hx[order], x[order]
        first, last = np.searchsorted(ranked, hy), np.searchsorted(ranked, hy, side="right")
        begun: dict[int, int] = {}  # of each hash, the places before this one are marked
        for b, start, end in zip(y.tolist(), first.tolist(), last.tolist(), strict=True):
            if marked[1][b] or marked[1][b + low - 1]:
                continue
            at = begun.get(start, start)
            while at < end and (marked[0][places[at]] or marked[0][places[at] + low - 1]):
                at += 1
            begun[start] = at
            for k in range(at, end):  # the first that is free and really equal, as a rule this one
                a = int(places[k])
                if not marked[0][a] and not marked[0][a + low - 1] and np.array_equal(doc[a : a + low], item[b : b + low]):
                    marked[0][a : a + low] = marked[1][b : b + low] = True
                    out.append(low)
                    break
        upper = low - 1
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``limit`` bytes (a longer item alone), one after another."""
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 if total <= limit else 2 * (total // limit) + 1
    parts = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).alias("part"))
    for k in range(n):
        yield [(r.item_id, r.text) for r in parts.where(F.col("part") == k).select("item_id", "text").collect()]


#: The last block of the benchmark that this worker made an index of.
LAST: dict = {}


def leaks_in(docs: DataFrame, items: list[tuple[int, str]], item_type: DataType, least: int, coverage: float, keep: bool) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK bytes
    name = uuid.uuid4().hex

    def found(block):
        """Leaks in a block, by its rows."""
        from runlens.llm import decontaminate as worker  # this module as the worker knows it, for all its tasks

        if name not in worker.LAST:
            worker.LAST.clear()
            worker.LAST[name] = Benchmark(items.value, least)
        bench = worker.LAST[name]
        codes, edges, words = word_codes(block.column("text"))
        ids = np.array([(bench.vocabulary.get(w, 0) if w else -1) for w in map(bare, words.to_pylist())], np.int64)
        ids = ids[codes] if len(codes) else np.zeros(0, np.int64)
        spoken = ids >= 0  # marks without letters or digits are no words
        return list(bench.matches(ids[spoken], np.concatenate([[0], np.cumsum(spoken)])[edges], coverage)), bench

    def pairs(batches):
        for block in text_blocks(batches, "text"):
            rows, bench = found(block)
            rows = [(d, bench.names[k], len(bench.words[k]), n, n / len(bench.words[k]), t, m) for d, k, n, t, m in rows]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [None, kind, *[None] * 5], strict=True)] if rows else None
            if columns:
                yield pa.RecordBatch.from_arrays([block.column("doc_id").take(columns[0]), *columns[1:]], names=names)

    def clean(batches):
        for block in text_blocks(batches, "text"):
            bad = {row[0] for row in found(block)[0]}
            yield block.filter(pa.array([k not in bad for k in range(block.num_rows)])) if bad else block

    kind = to_arrow_type(item_type)
    names = ["doc_id", "item_id", "item_words", "covered_words", "coverage", "n_tiles", "longest_tile"]
    if keep:
        return docs.mapInArrow(clean, docs.schema)
    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(pairs, f"doc_id {own}, item_id {item_type.simpleString()}, item_words long, covered_words long, coverage double, n_tiles long, longest_tile long")


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """One row per leaked item and document: doc_id, item_id, item_words, covered_words, coverage, n_tiles, longest_tile."""
    kind = benchmark.schema["item_id"].dataType
    found: list[DataFrame] = []
    for part in blocks(benchmark):
        if found:  # of several blocks, each is done with before the next is sent
            found[-1] = settle(found[-1], "leaks")
        found.append(leaks_in(docs, part, kind, least, coverage, keep=False))
    return reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The documents (all columns) into which no item leaked."""
    kind = benchmark.schema["item_id"].dataType
    for k, part in enumerate(blocks(benchmark)):
        docs = leaks_in(docs if k == 0 else settle(docs, "clean"), part, kind, least, coverage, keep=True)
    return docs
