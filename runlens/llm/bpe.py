"""Block-wise byte-pair encoding of a public word-level vocabulary, equal id for id to the tokenizers library.

Each block of texts is reduced to its distinct words by Arrow's dictionary encoding, the distinct words are
merged side by side as a NumPy matrix, and the ids are gathered back. Texts with characters whose normal form or
letter case could differ between libraries, or with special tokens, go through the library itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from runlens.llm.common import ranges, word_codes

NEVER = np.int32(2**31 - 1)
#: Outside these characters, or with a special token's opening, a text is left to the library (as is U+0130, whose lower case is two characters).
RARE = r"[^\t\n\r\x20-\x7e\x{a0}-\x{12f}\x{131}-\x{24f}]|<\|"
#: Longest word, in bytes, that is merged in the matrix.
LONGEST = 48
WIDTHS = (*range(17), 20, 24, 32, LONGEST)


def printable_bytes() -> dict[int, str]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest for 256 and up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(kept))
    return out


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


class WordBpe:
    """A vocabulary file of the tokenizers library: lower case, white space dropped, end-of-word suffix, byte level."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab, chars = model["vocab"], printable_bytes()
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split_or_line = regex.compile(rf"{split}|\n")
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        both = np.unique(np.concatenate([self.inner, self.final]))
        self.compact = np.zeros(self.size + 1, np.int32)
        self.compact[both] = np.arange(len(both), dtype=np.int32) + 1
        grid = np.concatenate([[-1], both]).astype(np.int32)
        self.first_ranks = self.ranks(grid[:, None], grid[None, :])
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.library = Tokenizer.from_file(path)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge order of each pair, NEVER where it does not merge."""
        want = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank_of_key[at], NEVER)

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word, concatenated, and how many each has."""
        words = words.cast(pa.large_binary())
        edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw, sizes = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.diff(edges)
        counts, chunks = np.zeros(len(words), np.int32), []
        for low, high in zip(WIDTHS, WIDTHS[1:], strict=False):
            picked = np.flatnonzero((sizes > low) & (sizes <= high))
            if picked.size:
                flat, n = self.merge_block(raw[ranges(edges[picked], sizes[picked])], sizes[picked], high)
                counts[picked] = n
                chunks.append((picked, flat, n))
        for i in np.flatnonzero(sizes > LONGEST):
            ids = np.array(self.library.encode(words[i].as_py().decode(), add_special_tokens=False).ids, np.int32)
            counts[i] = len(ids)
            chunks.append((np.array([i]), ids, counts[i : i + 1].copy()))
        out, starts = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for picked, flat, n in chunks:
            out[ranges(starts[picked], n)] = flat
        return out, counts

    def merge_block(self, raw: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(sizes)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < sizes[:, None]] = self.inner[raw]
        ids[np.arange(n), sizes - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        done, left = np.full((n, width), -1, np.int32), np.arange(n)
        rank = np.full((n, width), NEVER, np.int32)
        near = self.compact[ids]
        rank[:, :-1] = self.first_ranks[near[:, :-1], near[:, 1:]]
        columns = np.arange(width)
        while left.size:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(left)), at]
            over = best == NEVER
            if over.any():
                done[left[over]] = ids[over]
                ids, rank, left, at, best = ids[~over], rank[~over], left[~over], at[~over], best[~over]
                if not left.size:
                    break
            rows = np.arange(len(left))
            ids[rows, at] = self.made[best]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
            rank[:, -1] = NEVER
            after = np.where(at + 1 < width, ids[rows, np.minimum(at + 1, width - 1)], -1)
            rank[rows, at] = self.ranks(ids[rows, at], after)
            has = at > 0
            rank[rows[has], at[has] - 1] = self.ranks(ids[rows[has], at[has] - 1], ids[rows[has], at[has]])
        keep = done >= 0
        return done[keep], keep.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, concatenated, and the offsets by text. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        rare = pc.match_substring_regex(texts, RARE).to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(rare), "", texts) if rare.any() else texts
        codes, offsets, words = word_codes(plain)
        words = pc.utf8_lower(words)
        simple = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        mixed = self.split_or_line.findall("\n".join([*words.filter(pa.array(~simple)).to_pylist(), ""]))
        mixed = pa.array(mixed, words.type)
        line = pc.equal(mixed, "\n").to_numpy(zero_copy_only=False)
        n_parts = np.ones(len(words), np.int64)
        n_parts[~simple] = np.diff(np.flatnonzero(np.concatenate([[True], line]))) - 1
        parts = pa.concat_arrays([words.filter(pa.array(simple)), mixed.filter(pa.array(~line))]).dictionary_encode()
        flat, counts = self.merge(parts.dictionary)
        starts = np.cumsum(counts) - counts
        # the parts of mixed words stand after all simple words
        first = np.where(simple, np.cumsum(simple) - 1, simple.sum() + np.cumsum(np.where(simple, 0, n_parts)) - n_parts)
        parts_at = parts.indices.to_numpy(zero_copy_only=False)[ranges(first, n_parts)]
        part_len = counts[parts_at]
        flat = flat[ranges(starts[parts_at], part_len)]
        edges = np.concatenate([[0], np.cumsum(part_len)])[np.concatenate([[0], np.cumsum(n_parts)])]
        word_len = np.diff(edges)
        ids = flat[ranges(edges[:-1][codes], word_len[codes])]
        ends = np.concatenate([[0], np.cumsum(word_len[codes])])[offsets]
        if not rare.any():
            return ids, ends
        pieces, lengths = [], np.diff(ends)
        for i in range(len(rare)):
            own = ids[ends[i] : ends[i + 1]]
            if rare[i]:
                own = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, np.int32)
                lengths[i] = len(own)
            pieces.append(own)
        return np.concatenate(pieces), np.concatenate([[0], np.cumsum(lengths)])
