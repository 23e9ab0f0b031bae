"""Quality classifier: nearest-neighbour voting over latent-semantic vectors.

Terms are neighbouring byte pairs of the whole text, pairs of the bytes' shapes (lower, upper, digit, or the mark itself;
they mean the same in every language), and steps of the share of words that equal the word before.
Counts are log-scaled, weighted by inverse document frequency and projected to a latent space (truncated singular
value decomposition of a bounded sample of labelled rows). The labelled vectors are broadcast; every document gets its
exact cosines to all of them in blocks, and its nearest neighbours vote with their similarity.

Defined results: an empty or null text has no terms; its score is the mean label of the training sample. Training
labels of null are ignored; without any training rows every score is 0.5. Repeated rows are scored alike and stay
repeated; of rows that share a labelled id the least text trains. Ties of similarity are broken by the order of the training sample. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import text_blocks, word_codes

#: Labelled rows sampled per class, terms kept, latent dimensions, neighbours, power of the similarity, documents a block.
PER_CLASS, TERMS, LATENT, NEIGHBOURS, POWER, ROWS = 2000, 4096, 32, 15, 8, 256
PAIRS = 1 << 16
#: Term numbers: byte pairs, then shape pairs, then steps of repetition.
REPEATED = (0.02, 0.1, 0.3, 0.6)
STEPS = PAIRS + (1 << 14)
VOCABULARY = STEPS + len(REPEATED)
SHAPE = np.array([ord("a") if b >= 128 or chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else b for b in range(256)], np.int32)
#: Score from which a document is predicted to be good.
LEAST = 0.3


def term_counts(texts: pa.Array):
    """Yield (first row, owners, terms) over blocks of rows: one entry per occurrence of a term."""
    codes, edges, _ = word_codes(texts)
    again = np.concatenate([[False], codes[1:] == codes[:-1]]) if len(codes) else np.zeros(0, bool)
    again[edges[:-1][edges[:-1] < len(again)]] = False
    words = np.diff(edges)
    share = np.diff(np.concatenate([[0], np.cumsum(again)])[edges]) / np.maximum(words, 1)
    raw = [(t or "").encode() for t in texts.to_pylist()]
    for first in range(0, len(raw), ROWS):
        part = raw[first : first + ROWS]
        size = np.array([len(t) for t in part])
        data = np.frombuffer(b"".join(part), np.uint8).astype(np.int32)
        owner = np.repeat(np.arange(len(part)), size)
        inside = owner[:-1] == owner[1:]
        pair, owner, shape = (data[:-1] * 256 + data[1:])[inside], owner[:-1][inside], SHAPE[data]
        shapes = (PAIRS + shape[:-1] * 128 + shape[1:])[inside]
        step = [np.where(share[first : first + ROWS] > s, words[first : first + ROWS], 0) for s in REPEATED]
        repeated = np.repeat(np.tile(np.arange(len(part)), len(step)), np.concatenate(step))
        steps = np.repeat(np.repeat(np.arange(STEPS, VOCABULARY), len(part)), np.concatenate(step))
        yield first, np.concatenate([owner, owner, repeated]), np.concatenate([pair, shapes, steps])


class Space:
    """The latent space and the labelled vectors in it."""

    def __init__(self, rows: list[tuple[list[int], list[int], int]], terms: int = TERMS, latent: int = LATENT):
        frequency = np.zeros(VOCABULARY)
        for index, _, _ in rows:
            frequency[index] += 1
        kept = np.argsort(-frequency, kind="stable")[:terms]
        kept = kept[frequency[kept] > 0]
        self.slot = np.full(VOCABULARY, -1, np.int32)
        self.slot[kept] = np.arange(len(kept))
        self.idf = (np.log((1 + len(rows)) / (1 + frequency[kept])) + 1).astype(np.float32)
        self.labels = np.array([y for _, _, y in rows], np.float32)
        self.mean = float(self.labels.mean()) if rows else 0.5
        counts = np.zeros((len(rows), len(kept)), np.float32)
        for k, (index, count, _) in enumerate(rows):
            at = self.slot[np.array(index, np.int64)]
            counts[k, at[at >= 0]] = np.array(count, np.float32)[at >= 0]
        weighted = self.weigh(counts)
        self.basis = subspace(weighted, min(latent, *weighted.shape)) if rows and len(kept) else np.zeros((len(kept), 0), np.float32)
        self.vectors = unit(weighted @ self.basis)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS, power: int = POWER) -> np.ndarray:
        if not len(self.labels) or not self.basis.shape[1]:
            return np.full(len(counts), self.mean)
        cosine = unit(self.weigh(counts) @ self.basis) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1).astype(float), 0) ** power
        total = weight.sum(axis=1)
        voted = (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12)
        return np.where((total > 0) & (counts.sum(axis=1) > 0), np.clip(voted, 0, 1), self.mean)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def subspace(x: np.ndarray, latent: int, rounds: int = 6) -> np.ndarray:
    """Right singular vectors, by subspace iteration from a fixed start, scaled to even out the leading ones."""
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(2 * latent, *x.shape))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, s, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :latent] / np.sqrt(np.maximum(s[:latent], 1e-6))


def held_out(doc_id) -> bool:
    """Rows that never train: crc32 of the id's text is divisible by 5."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Space:
    """Fit on at most ``per_class`` labelled rows of each class, those with the smallest hashes of doc_id."""
    usable = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = usable.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("quality = 0").orderBy(*order).limit(per_class).union(known.where("quality = 1").orderBy(*order).limit(per_class))

    def count(batches):
        for block in text_blocks(batches, "text"):
            index, number = [], []
            for _, owner, term in term_counts(block.column("text")):
                for k in range(int(min(ROWS, block.num_rows - len(index)))):
                    at, n = np.unique(term[owner == k], return_counts=True)
                    index.append(at.astype(np.int32)), number.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), block.column("quality"), pa.array(index, pa.list_(pa.int32())), pa.array(number, pa.list_(pa.int32()))], names=["doc_id", "quality", "at", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most 2 * per_class rows, however often an id repeats
    rows = chosen.mapInArrow(count, f"doc_id {kind}, quality int, at array<int>, n array<int>").toArrow().sort_by("doc_id").to_pydict()
    seen, out = set(), []
    for doc, y, at, n in zip(rows["doc_id"], rows["quality"], rows["at"], rows["n"], strict=True):
        if doc not in seen:
            seen.add(doc)
            out.append((at, n, y))
    return Space(out)


def scored_blocks(space: Space, batches):
    """Yield (block, scores)."""
    for block in text_blocks(batches, "text"):
        scores = np.zeros(block.num_rows)
        for first, owner, term in term_counts(block.column("text")):
            slot = space.slot[term]
            n, width = min(ROWS, block.num_rows - first), len(space.idf)
            counts = np.bincount(owner[slot >= 0] * width + slot[slot >= 0], minlength=n * width).reshape(n, width).astype(np.float32)
            scores[first : first + n] = space.score(counts)
        yield block, scores


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    space = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # bounded by PER_CLASS, TERMS and LATENT

    def run(batches):
        for block, scores in scored_blocks(space.value, batches):
            held = [held_out(d) if d is not None else False for d in block.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(held), pa.array(scores), pa.array((scores >= LEAST).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """The documents (all columns) predicted to be good; trained on ``training``, else on the documents themselves."""
    space = docs.sparkSession.sparkContext.broadcast(train(docs if training is None else training, labels))

    def run(batches):
        for block, scores in scored_blocks(space.value, batches):
            yield block.filter(pa.array(scores >= LEAST))

    return docs.mapInArrow(run, docs.schema)
