"""The grouping genetic algorithm against bounds, exhaustive search and plain best fit."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import packing


def valid(bins, size, room):
    return sorted(i for b in bins for i in b) == list(range(len(size))) and all(size[b].sum() <= room for b in bins)


def plain(size, room):
    return len(packing.best_fit(np.argsort(-size, kind="stable"), size, room, []))


def optimum(size, room):
    """Fewest bins, by trying every assignment."""
    best = len(size)

    def place(k, left):
        nonlocal best
        if len(left) >= best:
            return
        if k == len(size):
            best = len(left)
            return
        for j in sorted({x: i for i, x in enumerate(left) if x >= size[k]}.values()):
            place(k + 1, [x - size[k] if i == j else x for i, x in enumerate(left)])
        place(k + 1, [*left, room - size[k]])

    place(0, [])
    return best


def test_bound_is_never_above_the_optimum_and_small_cases_are_solved():
    gen = np.random.default_rng(4)
    for k in range(40):
        size = gen.integers(1, 21, 9) if k % 2 else gen.integers(5, 12, 9)
        best = optimum(sorted(size.tolist(), reverse=True), 20)
        bins = packing.evolve(size, 20, seed=k)
        assert packing.lower_bound(size, 20) <= best == len(bins) and valid(bins, size, 20)


@pytest.mark.parametrize("low, high, least", [(1024, 2049, 0.05), (820, 1640, 0.03), (1366, 2049, 0.0)])
def test_breeding_saves_bins_over_best_fit_decreasing(low, high, least):
    size = np.random.default_rng(3).integers(low, high, 1500)
    bins = packing.evolve(size, 4096, seed=1)
    assert valid(bins, size, 4096) and len(bins) <= (1 - least) * plain(size, 4096)


def test_triplets_of_a_known_optimum():
    gen = np.random.default_rng(5)
    a = gen.integers(1100, 1900, 200)
    b = np.array([gen.integers(1024, 4096 - x - 1023) for x in a])
    size = gen.permutation(np.concatenate([a, b, 4096 - a - b]))
    bins = packing.evolve(size, 4096, seed=2)
    assert valid(bins, size, 4096) and len(bins) <= 202 < plain(size, 4096)


def test_crossover_and_mutation_keep_every_piece_once():
    gen = np.random.default_rng(6)
    size = gen.integers(1, 4097, 300)
    people = [packing.founder(k, size, 4096, gen) for k in range(4)]
    for a, b in itertools.permutations(people, 2):
        assert valid(packing.cross(a, b, size, 4096, gen), size, 4096)
        assert valid(packing.mutate(a, size, 4096, gen), size, 4096)
    assert packing.evolve(np.zeros(0, np.int64), 10, seed=1) == [] and packing.evolve(np.array([10]), 10, seed=1) == [[0]]


def test_repeated_rows_are_dealt_to_many_shards_and_open_bins_of_shards_meet(spark):
    size = [700] * 300 + [1500] * 150 + [4096] * 5 + [10]
    rows = spark.createDataFrame([(None if k % 2 else 1, 0, n) for k, n in enumerate(size)], "doc_id long, piece int, length long").coalesce(1).withColumn("row", F.monotonically_increasing_id()).cache()
    got = packing.pack(rows, shard=40).collect()
    assert sorted(r.length for r in got) == sorted(size) and got[0].__fields__ == ["doc_id", "piece", "length", "sequence_id", "offset"]
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 4096
    assert len({k >> 56 for k in bins}) > 1  # shards of more than one level
    assert len(bins) <= plain(np.array(size), 4096) + 4
