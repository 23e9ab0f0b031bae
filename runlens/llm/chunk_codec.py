"""Byte-level BPE by content-defined chunk reuse, equal id for id to the tokenizers library.

A rolling hash cuts texts where their content says so, so a passage that documents share is cut alike in all of them. Keys
of chunks are counted first. Documents that share no chunk have nothing to reuse and are encoded where they lie. Of the
others, the chunks of a block of documents, each distinct one once, go to the task that owns their key; it encodes each once
and returns the ids to the blocks that asked. There documents are put together again: around a join the last pieces of the
left chunk and the first ones of the right chunk are encoded anew, until a piece begins where one of the right chunk begins
too, far enough from the window's end. From there both agree, as a piece depends on nothing before its beginning. Where they
do not, the chunks that follow are added and encoded with them, twice as much each time.

Which keys are shared is told by a bitmap of at most WORDS * 8 bytes. With so many shared chunks that it fills up, more
documents take the way through the exchange; results are the same.

Decoding looks up the bytes of the ids; what is hashed is the decoded text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.bpe import LONGEST, WordBpe, printable_bytes
from runlens.llm.common import discard, importable, ranges, settle, text_blocks

#: The split that byte-level vocabularies of this kind use (a fixed value).
PIECES = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: The same for texts of common characters only, in which letters, digits and word characters mean the same to both libraries.
COMMON = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
UNCOMMON = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ɏ]")
#: Texts with other characters are split by the library itself.
RARE = re.compile(r"[^\t\n\r\x20-\x7e\xa0-ɏ]")
AVERAGE, SHORTEST, REACH = 1 << 10, 1 << 8, 32
#: Pieces at both ends of a chunk whose lengths are kept; of these the last MARGIN (and MARGIN_BYTES) of a text may depend on what follows.
EDGE, MARGIN, MARGIN_BYTES = 14, 6, 16
CACHED, FEW = 1 << 20, 256
BLOCK = 8 << 20
#: Most words of 64 bits of the bitmap of shared keys, and bits for each.
WORDS, BITS = 1 << 21, 16
GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec(WordBpe):
    """A byte-level vocabulary file of the tokenizers library, without truncation and padding; ``merge`` is that of words without an end."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, vocab, chars = spec["pre_tokenizer"], spec["model"]["vocab"], printable_bytes()
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("not a plain byte-level vocabulary")
        byte = {c: b for b, c in chars.items()}
        held = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        held |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.kind = np.dtype("<u2" if max(held) < 1 << 16 else "<u4")
        self.tokens = [held.get(i, b"") for i in range(max(held) + 1)]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(self.tokens), np.uint8)
        names = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = set(names)
        self.margin_bytes = max([MARGIN_BYTES, *(len(n.encode()) + 3 for n in names)])
        self.cache: dict[str, bytes] = {}
        self.prepare(vocab, [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]], chars)

    def prepare(self, vocab: dict[str, int], pairs: list, chars: dict[int, str]) -> None:
        """The tables by which ``merge`` works."""
        self.inner = self.final = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        both = np.unique(self.inner)
        self.compact = np.zeros(self.size + 1, np.int32)
        self.compact[both] = np.arange(len(both), dtype=np.int32) + 1
        grid = np.concatenate([[-1], both]).astype(np.int32)
        self.first_ranks = self.ranks(grid[:, None], grid[None, :])
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def pieces(self, text: str) -> list[str]:
        """The parts of a text that are encoded each for itself."""
        special = self.special and self.special.search(text)
        if not special and not UNCOMMON.search(text):
            return COMMON.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text) if special else [text]):
            if k % 2:
                out.append(part)
            elif part:
                out += PIECES.findall(part) if not RARE.search(part) else [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each piece."""
        try:
            return list(map(self.cache.__getitem__, pieces))
        except KeyError:
            new = self.learn(set(pieces))
            out = list(map(self.cache.__getitem__, pieces))
            for p in new:  # long pieces are rare and large
                if len(p) > 64:
                    del self.cache[p]
            return out

    def learn(self, pieces: set[str]) -> list[str]:
        """Encode the pieces that are not known yet, many of them side by side; returns these."""
        if len(self.cache) > CACHED:
            self.cache.clear()
        new = list(pieces.difference(self.cache))
        many = [p for p in new if p not in self.names and len(p) <= LONGEST] if len(new) >= FEW else []
        if many:
            flat, counts = self.merge(pa.array(many, pa.string()))
            packed, ends = flat.astype(self.kind).tobytes(), (np.cumsum(counts) * self.kind.itemsize).tolist()
            self.cache.update(zip(many, (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
            rest = [p for p in new if p not in self.cache]
        else:
            rest = new
        for p, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.cache[p] = np.array(e.ids, self.kind).tobytes()
        return new

    def encode_all(self, texts: list[str]) -> list[list[bytes]]:
        """The packed ids of each text's pieces."""
        pieces = [self.pieces(t) for t in texts]
        self.learn(set().union(*pieces))
        return [self.ids(p) for p in pieces]

    def text(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        sizes = self.sizes[ids]
        return self.raw[ranges(self.starts[ids], sizes)].tobytes()


class Chunk:
    """Ids of a text encoded for itself, and how many ids its first pieces and, from the end, its last ones have."""

    __slots__ = ("head", "ids", "key", "tail")

    def __init__(self, ids: np.ndarray, head: bytes, tail: bytes, key: int | None = None):
        self.ids, self.head, self.tail, self.key = ids, head, tail, key


def edged(found: list[bytes], width: int) -> tuple[bytes, bytes, bytes]:
    """Packed ids of a text's pieces; ids in each of its first EDGE pieces and, from the end, in each of its last ones, a byte each, as far as they fit in one."""
    ends = []
    for part in (found[:EDGE], found[: -EDGE - 1 : -1]):
        sizes = [len(x) // width for x in part]
        over = next((k for k, n in enumerate(sizes) if n > 255), len(sizes))
        ends.append(bytes(sizes[:over]))
    return b"".join(found), ends[0], ends[1]


def encoded(own: Codec, text: str) -> tuple[bytes, bytes, bytes]:
    return edged(own.ids(own.pieces(text)), own.kind.itemsize)


def cut_places(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending places, at ``starts`` (of documents) and wherever the rolling hash of the REACH bytes before is small; never within a character."""
    h = GEAR[raw]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift)) if len(h) > shift else h[shift:]
    found = np.flatnonzero(h < np.uint32((1 << 32) // AVERAGE)) + 1
    for _ in range(3):
        found = found[found < len(raw)]
        found = found + ((raw[found] & 0xC0) == 0x80)
    found = np.unique(found[found < len(raw)])
    own = np.searchsorted(starts, found, side="right") - 1
    found = found[found - starts[own] >= REACH]  # hashes that reach back into the document before don't count
    return np.union1d(found, starts)


def spaced(places: list[int], end: int) -> Iterator[tuple[int, int]]:
    """The chunks of one document from its possible places; short ones join the next."""
    first = places[0]
    for at in places[1:]:
        if at - first >= SHORTEST:
            yield first, at
            first = at
    yield first, end


def joined(own: Codec, left: Chunk, right: Chunk) -> tuple[int, bytes, int] | None:
    """How many ids of ``left`` go, what stands in their place, how many of ``right`` go; None without agreement within the edges."""
    tokens = own.tokens
    last = left.ids[max(0, len(left.ids) - sum(left.tail)) :].tolist()
    drop = pieces = size = 0
    for n in left.tail:
        size += sum(len(tokens[i]) for i in last[len(last) - drop - n : len(last) - drop])
        drop, pieces = drop + n, pieces + 1
        if pieces >= MARGIN and size >= own.margin_bytes:
            break
    else:
        return None
    known = [tokens[i] for i in right.ids[: sum(right.head)].tolist()]
    window = own.pieces((b"".join(tokens[i] for i in last[len(last) - drop :]) + b"".join(known)).decode())
    begun, at, skip = {size: 0}, size, 0
    for n in right.head:
        at, skip = at + sum(map(len, known[skip : skip + n])), skip + n
        begun[at] = skip
    edges = [0]
    for p in window:
        edges.append(edges[-1] + (len(p) if p.isascii() else len(p.encode())))
    safe = min(edges[max(0, len(edges) - 1 - MARGIN)], edges[-1] - own.margin_bytes)
    for k, edge in enumerate(edges):
        if edge > safe:
            return None
        if edge in begun:
            return drop, b"".join(own.ids(window[:k])), begun[edge]
    return None


def assembled(own: Codec, chunks: list[Chunk], cache: dict) -> np.ndarray:
    """The ids of the text that the chunks make up."""
    out, left, since, k = [], chunks[0], 0, 1
    while k < len(chunks):
        right = chunks[k]
        both = (left.key, right.key) if left.key is not None else None
        if both in cache:
            found = cache[both]
        else:
            found = joined(own, left, right)
            if both:
                cache[both] = found
        if found and since <= len(left.ids) - found[0]:
            out += [left.ids[since : len(left.ids) - found[0]], np.frombuffer(found[1], own.kind)]
            left, since, k = right, found[2], k + 1
            continue
        text = own.text(left.ids[since:])
        wanted = 2 * len(text)
        while k < len(chunks) and (len(text) < wanted or right is chunks[k]):
            text += own.text(chunks[k].ids)
            k += 1
        ids, head, tail = encoded(own, text.decode())
        left, since = Chunk(np.frombuffer(ids, own.kind), head, tail), 0
    out.append(left.ids[since:])
    return np.concatenate(out) if len(out) > 1 else out[0]


def split(part: pa.RecordBatch) -> tuple[list[bytes], list[list[tuple[bytes, bytes]]]]:
    """The texts of a block and the chunks of each as (key, bytes)."""
    texts = [b"" if t is None else t for t in part.column("text").cast(pa.large_binary()).to_pylist()]
    data, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    held = np.unique(starts[starts < ends])
    places = cut_places(np.frombuffer(data, np.uint8), held) if len(held) else held
    low, high = np.searchsorted(places, starts).tolist(), np.searchsorted(places, ends).tolist()
    places, ends = places.tolist(), ends.tolist()
    chunks = []
    for k, text in enumerate(texts):
        own = (data[a:b] for a, b in spaced(places[low[k] : high[k]], ends[k])) if text else ()
        chunks.append([(xxhash.xxh3_128_digest(c), c) for c in own])
    return texts, chunks


def brief(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shared_keys(docs: DataFrame) -> tuple[int, bytes]:
    """A bitmap of the keys of chunks that stand more than once, as its number of 64-bit words (a power of two) and their bytes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_blocks([batch], "text", BLOCK):
                held = np.array([brief(k) for own in split(part)[1] for k, _ in own], np.int64)
                found, n = np.unique(held, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["h", "n"])

    shared = settle(docs.select("text").mapInArrow(keys, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "shared-chunks")
    words = 1 << 10
    while words < min(WORDS, shared.count() * BITS // 64):
        words *= 2
    bit = F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(63)).cast("int")
    marks = shared.groupBy(F.col("h").bitwiseAND(F.lit(words - 1)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()  # at most WORDS rows
    bitmap = np.zeros(words, np.int64)
    bitmap[marks.column("word").to_numpy()] = marks.column("bits").to_numpy()
    discard(shared)
    return words, bitmap.tobytes()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (packed, little-endian, 32 bits each), decoded (the ids' text).

    Null text counts as empty: no ids. Repeated and null ids are rows of their own; further columns are ignored. Empty table:
    no rows. ``docs`` must be read from files (or settled): blocks are numbered by partition, and a task that is run again must
    meet the same rows.
    """
    importable(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = f"block long, part int, place int, doc_id {id_type}, key binary, body binary, head binary, tail binary"
    made = f"doc_id {id_type}, n_tokens long, ids binary, decoded string"
    words, bits = shared_keys(docs)
    bitmap = docs.sparkSession.sparkContext.broadcast(bits)  # at most WORDS * 8 bytes

    def sharing(chunks: list[list[tuple[bytes, bytes]]]) -> list[bool]:
        marks = np.frombuffer(bitmap.value, np.int64)

        def held(key: bytes) -> bool:
            h = brief(key)
            return bool(int(marks[h & (words - 1)]) >> (h >> 40 & 63) & 1)

        return [any(held(k) for k, _ in own) for own in chunks]

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that share no chunk."""
        own = codec(path)
        for batch in batches:
            for part in text_blocks([batch], "text", BLOCK):
                texts, chunks = split(part)
                at = [k for k, shares in enumerate(sharing(chunks)) if not shares]
                if at:
                    ids = [np.frombuffer(b"".join(found), own.kind) for found in own.encode_all([texts[k].decode() for k in at])]
                    yield result(own, part.column("doc_id").take(pa.array(at)), ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct chunks of the others of each block, and which ones each document has."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_blocks([batch], "text", BLOCK):
                _, chunks = split(part)
                at = [k for k, shares in enumerate(sharing(chunks)) if shares]
                number: dict[bytes, int] = {}
                bodies, refs = [], []
                for k in at:
                    for key, chunk in chunks[k]:
                        if key not in number:
                            number[key] = len(bodies)
                            bodies.append(chunk)
                    refs.append(np.array([number[key] for key, _ in chunks[k]], np.int32).tobytes())
                ids = part.column("doc_id")
                spread = [xxhash.xxh3_128_digest(f"{block}:{k}") for k in at]
                for n, kind, of, keys, own in ((len(bodies), 0, pa.nulls(len(bodies), ids.type), list(number), bodies), (len(at), 1, ids.take(pa.array(at, pa.int64())), spread, refs)):
                    if n:
                        none = pa.nulls(n, pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, kind, np.int32)), pa.array(np.arange(n, dtype=np.int32)), of, pa.array(keys, pa.binary()), pa.array(own, pa.binary()), none, none], names=NAMES)
                block += 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk once: rows come in order of their key."""
        own, last, chunk = codec(path), None, None
        for batch in batches:
            bodies, heads, tails = [], [], []
            kinds, keys, held = (batch.column(c).to_pylist() for c in ("part", "key", "body"))
            new = [not kind and key != before for kind, key, before in zip(kinds, keys, [last, *keys], strict=False)]
            made_of = iter(own.encode_all([body.decode() for body, fresh in zip(held, new, strict=True) if fresh]))
            for kind, key, body, fresh in zip(kinds, keys, held, new, strict=True):
                if fresh:
                    last, chunk = key, edged(next(made_of), own.kind.itemsize)
                for column, x in zip((bodies, heads, tails), (body, None, None) if kind else chunk, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in NAMES[:4]), pa.nulls(len(bodies), pa.binary()), *(pa.array(x, pa.binary()) for x in (bodies, heads, tails))], names=NAMES)

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after another, the chunks of each before its documents."""
        own, block, chunks, cache = codec(path), None, [], {}
        for batch in batches:
            out, at, size = [], [], 0
            for k, (number, kind, body, head, tail) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "part", "body", "head", "tail")), strict=True)):
                if number != block:
                    block, chunks, cache = number, [], {}
                if not kind:
                    chunks.append(Chunk(np.frombuffer(body, own.kind), head, tail, len(chunks)))
                    continue
                out.append(assembled(own, [chunks[i] for i in np.frombuffer(body, np.int32).tolist()], cache))
                at.append(k)
                size += 8 * len(out[-1])
                if size > BLOCK:
                    yield result(own, batch.column("doc_id").take(pa.array(at)), out)
                    out, at, size = [], [], 0
            if out:
                yield result(own, batch.column("doc_id").take(pa.array(at)), out)

    def result(own: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        columns = [doc_ids, pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.text(x).decode("utf-8", "replace") for x in ids], pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = docs.select("doc_id", "text")
    owned = docs.mapInArrow(cut, rows).repartition("key").sortWithinPartitions("key")
    blocks = owned.mapInArrow(encode, rows).repartition("block").sortWithinPartitions("block", "part", "place")
    return docs.mapInArrow(alone, made).unionByName(blocks.mapInArrow(assemble, made))


NAMES = ["block", "part", "place", "doc_id", "key", "body", "head", "tail"]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_documents(docs, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
