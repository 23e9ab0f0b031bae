"""The pipeline's near-duplicates against brute force over five-word shingles."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import shingle_join

rng = random.Random(8)
WORDS = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "en", "ir", "ost")]


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(WORDS) + "x"
    return " ".join(words)


def cases():
    bases = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (3, 5, 9, 60, 150, 240, 400)]
    texts = [None, "", " \n", *bases, bases[0].upper(), f"\t{bases[3]} ", bases[4][: len(bases[4]) // 2]]
    texts += [edited(b, k) for b in bases[3:] for k in (1, 2, 3, 4, 6, 9)]
    texts += [edited(bases[5], 3) for _ in range(90)]  # a family larger than BIG
    passage = " ".join(rng.choice(WORDS) for _ in range(12))
    return texts + [passage + " " + " ".join(rng.choice(WORDS) for _ in range(4)) for _ in range(80)]


def least_of_groups(texts):
    sets = [brute_shingles(t) for t in texts]
    part = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if part[a] != part[b] and near(sets[a], sets[b]):
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = [new if p == old else p for p in part]
    return set(part)


@pytest.mark.parametrize("big", [64, 4])
def test_one_of_each_similar_group_stays(spark, monkeypatch, big):
    import corpus_pipeline

    monkeypatch.setattr(shingle_join, "BIG", big)
    monkeypatch.setattr(shingle_join, "PIVOTS", 2 if big == 4 else 8)
    monkeypatch.setattr(shingle_join, "PART", 3 if big == 4 else 4096)
    monkeypatch.setattr(shingle_join, "SLICE", 7 if big == 4 else 1 << 16)
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("fp", F.lit(1)).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least_of_groups(texts))
    assert corpus_pipeline.near_duplicates(spark, docs.where("doc_id < 0"), "").count() == 0


def test_null_and_repeated_ids_keep_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b, c, d = (" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(4))
    rows = [(None, a), (None, a), (None, f"{a} more"), (5, b), (5, c), (5, b), (None, c), (6, d), (4, d), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr)
    assert len(kept) == 5 and {(5, b), (5, c), (4, d)} <= set(kept)
    assert sum(i is None and bool(t) and t.startswith(a) for i, t in kept) == 1 and sum(not t for _, t in kept) == 1


def test_parts_of_similar_sets_meet_within_the_radius():
    """Of two similar sets, at any size, one part has fingerprints in the same space at most two bits apart."""
    gen = np.random.default_rng(5)
    for n in [*range(1, 60), 200, 777, 4000]:
        for lost in {0, n // 10, n // 5}:
            new = max(0, int((n - lost) / 0.8) - n)
            a = np.unique(gen.integers(0, 1 << 63, n, np.int64)).astype(np.uint64)
            b = np.unique(np.concatenate([a[lost:], gen.integers(0, 1 << 63, new, np.int64).astype(np.uint64)]))
            if np.array_equal(a, b) or not shingle_join.similar(a, b):
                continue
            fps, ends = shingle_join.part_fingerprints([a, b], 0.8)
            own, scheme, space = shingle_join.layout(np.array([len(a), len(b)]), 0.8)
            seen = dict(zip(space[: ends[1]].tolist(), fps[: ends[1]].tolist(), strict=True))
            assert any(s in seen and (seen[s] ^ f).bit_count() <= 2 for s, f in zip(space[ends[1] :].tolist(), fps[ends[1] :].tolist(), strict=True)), (n, lost)


@pytest.mark.parametrize("large", [20])
def test_large_spaces_are_routed_by_a_tree(spark, monkeypatch, large):
    """Spaces beyond ``LARGE`` go through the vantage-point tree in Spark, what stays large by one-bit neighbours."""
    import corpus_pipeline

    monkeypatch.setattr(shingle_join, "LARGE", large)
    texts = cases()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(least_of_groups(texts))


@pytest.mark.parametrize("limit", [1 << 25, 4000])
def test_a_bundle_holds_all_its_pairs(spark, monkeypatch, limit):
    """Each pair is in one bundle, a cluster beyond ``BUNDLE`` bytes in several."""
    monkeypatch.setattr(shingle_join, "BUNDLE", limit)
    pairs = list(itertools.combinations(range(40), 2)) + [(50, 51), (51, 52)]
    sketches = spark.createDataFrame([(k, 100) for k in range(60)], "fp long, n long")
    got = shingle_join.bundled(spark.createDataFrame(pairs, "a long, b long"), sketches).collect()
    assert sorted((r.a, r.b) for r in got) == pairs
    assert (len({r.bundle for r in got if r.b < 40}) > 1) == (limit == 4000) and len({r.bundle for r in got if r.a >= 50}) == 1


def test_bitmaps_tell_long_sets_apart(spark):
    """Unrelated long sets are no candidates, whatever space their parts meet in; folded bitmaps never differ in more bits than the sets in members."""
    base = [rng.choice(WORDS) + str(rng.random()) for _ in range(3000)]
    texts = [" ".join(base), " ".join([*base[:2600], "other"]), *(" ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(n)) for n in (2700, 2900, 3100, 3300))]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string")
    own = shingle_join.described(rows, 5, 0.8).cache()
    fps = {r.row: r.fp for r in own.collect()}
    pairs = spark.createDataFrame([(fps[a], fps[b]) for a, b in itertools.combinations(range(len(texts)), 2)], "a long, b long")
    assert [(r.a, r.b) for r in shingle_join.possible(pairs, own.select("fp", "n", "sketch"), 0.8).collect()] == [(fps[0], fps[1])]
    gen = np.random.default_rng(3)
    sets = [np.unique(gen.integers(0, 1 << 63, n, np.int64)).astype(np.uint64) for n in (0, 1, 100, 128, 129, 1025, 4000)]
    sets += [s[: len(s) * 9 // 10] for s in sets]
    maps = shingle_join.Bitmaps(shingle_join.pa.array([shingle_join.bitmap(s) for s in sets]))
    at, there = (x.ravel() for x in np.indices((len(sets), len(sets))))
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for d, i, j in zip(maps.differ(at, maps, there), at, there, strict=True))


def test_links_by_a_chain_are_no_candidates(spark):
    """Of a group only sets within the radius in its space are paired."""
    rows = spark.createDataFrame([(7, point, k, 20) for k, point in enumerate((0, 3, 15, 63, -1))], "shingle long, point long, fp long, n long")
    assert sorted((r.a, r.b) for r in shingle_join.candidates(rows, 0.8).collect()) == [(0, 1), (1, 2), (2, 3)]


def test_similar_sets_meet_within_both_fingerprints():
    """Of two similar sets, at any size, a part lies within the radius and the chain that it begins within its share of the differences."""
    gen = np.random.default_rng(6)
    plan = shingle_join.schemes(0.8)
    for n in [*range(4, 70), 130, 300, 777, 4000]:
        for lost in {0, n // 10, n // 5}:
            new = max(0, int((n - lost) / 0.8 + 1e-9) - n)
            a = np.unique(gen.integers(0, 1 << 63, n, np.int64)).astype(np.uint64)
            b = np.unique(np.concatenate([a[lost:], gen.integers(0, 1 << 63, new, np.int64).astype(np.uint64)]))
            if np.array_equal(a, b) or not shingle_join.similar(a, b):
                continue
            fps, chains, ends = shingle_join.chained_fingerprints([a, b], 0.8)
            space = shingle_join.layout(np.array([len(a), len(b)]), 0.8)[2]
            both = list(zip(space.tolist(), fps.tolist(), chains.tolist(), strict=True))
            seen = {s: (f, c) for s, f, c in both[: ends[1]]}
            assert any(s in seen and (seen[s][0] ^ f).bit_count() <= 2 and (seen[s][1] ^ c).bit_count() <= plan[s >> 48, 5] for s, f, c in both[ends[1] :]), (n, lost)


def test_unrelated_short_sets_form_no_groups(spark):
    """Parts of few members chain any number of unrelated sets; their second fingerprints part them."""
    texts = [" ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(rng.randint(14, 34))) for _ in range(6000)]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string").repartition(4)
    assert shingle_join.groups(shingle_join.described(rows, 5, 0.8).cache(), 0.8).count() < 60


def test_rows_hang_together_by_steps_within_both_bounds():
    gen = np.random.default_rng(9)
    base = gen.integers(0, 1 << 63, 12, np.int64).astype(np.uint64)
    points = base[gen.integers(0, 3, 400)] ^ np.left_shift(np.uint64(1), gen.integers(0, 6, 400).astype(np.uint64))
    chains = base[gen.integers(3, 12, 400)] ^ np.left_shift(np.uint64(1), gen.integers(0, 9, 400).astype(np.uint64))
    points, chains = np.unique(np.stack([points, chains]), axis=1)
    near = (np.bitwise_count(points[:, None] ^ points) <= 2) & (np.bitwise_count(chains[:, None] ^ chains) <= 3)
    want = np.arange(len(points))
    while (new := np.where(near, want, len(want)).min(axis=1)).tolist() != want.tolist():
        want = new
    assert shingle_join.hang_together(points, chains, np.zeros(len(points), np.int64), 3).tolist() == want.tolist() and 1 < len(set(want.tolist())) < len(want) / 4


def test_bundles_need_no_components(spark, monkeypatch):
    """Contraction takes many small jobs, whose plans fill the driver's memory."""
    monkeypatch.setattr(shingle_join, "contract", None)
    pairs = spark.createDataFrame([(a, b) for k in range(0, 60, 6) for a, b in itertools.combinations(range(k, k + 6), 2)], "a long, b long")
    got = shingle_join.bundled(pairs, spark.createDataFrame([(k, 1 << 20) for k in range(60)], "fp long, n long")).collect()
    assert len(got) == 150 and all(len({r.bundle for r in got if r.a // 6 == k and r.b // 6 == k}) <= 3 for k in range(10))


def test_texts_and_fingerprints_are_told_by_bitmaps_and_not_shuffled(spark):
    """A semi-join by row shuffled all texts, and the fingerprints of all parts, where the rows were too many for a broadcast."""
    import corpus_pipeline
    from runlens.llm.common import among

    rows = spark.range(100_000).select(((F.col("id") % 3) * (1 << 33) + F.floor(F.col("id") / 3)).alias("row"), F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    wanted = rows.where("doc_id % 7 = 2")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = among(rows, wanted)
        assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == list(range(2, 100_000, 7))
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(cases())], "doc_id long, text string")
        plan = corpus_pipeline.near_duplicates(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(row#" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_large_spaces_go_by_blocks_three_times_at_most(spark, monkeypatch):
    """Parts of unrelated sets: what lies near a threshold of a tree went both ways, and what stayed large became 65 rows a part."""
    monkeypatch.setattr(shingle_join, "LARGE", 500)
    monkeypatch.setattr(shingle_join, "neighbours", None)
    gen = np.random.default_rng(4)
    sets = [np.unique(gen.integers(0, 1 << 63, 150, np.int64)).astype(np.uint64) for _ in range(4000)]
    parts, ends = shingle_join.part_fingerprints(sets, 0.8)
    plan = shingle_join.schemes(0.8)
    pieces = np.where((plan[:, 0] <= 150) & (plan[:, 1] > 150), 32, 0)
    shard, at, who = shingle_join.dealt(np.full(4000, 150), parts, 0.8, pieces)
    assert len(shard) == 3 * len(parts) and np.unique(shard, return_counts=True)[1].max() <= 500
    assert (np.searchsorted(ends, at, side="right") - 1 == who).all()
    texts = [" ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(100)) for _ in range(2000)]
    texts += [f"{t} more" for t in texts[:40]]
    rows = spark.createDataFrame([(k, k, t) for k, t in enumerate(texts)], "row long, doc_id long, text string").repartition(4)
    own = shingle_join.described(rows, 5, 0.8).cache()
    fps = {r.row: r.fp for r in own.collect()}
    pairs = {(r.a, r.b) for r in shingle_join.candidates(shingle_join.groups(own, 0.8), 0.8).collect()}
    assert {tuple(sorted((fps[k], fps[2000 + k]))) for k in range(40)} <= pairs
    part, chain, row = (gen.integers(0, 1 << 62, 50, np.int64) for _ in range(3))
    space = int(shard[0]) >> 24 << 24
    again = shingle_join.unpacked(space | 5, 50, shingle_join.packed(space, part.view(np.uint64), chain.view(np.uint64), row))
    assert [x.view(np.int64).tolist() for x in again] == [part.tolist(), chain.tolist(), row.tolist()]
