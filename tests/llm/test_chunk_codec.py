"""op11 against the tokenizers library: whole tables, odd joins, texts without any agreement."""

import hashlib
import random

import numpy as np
import pytest

from runlens.llm import chunk_codec, queries

DATA = "/root/testdata/sf0.001"
ODD = ["'l", "l", "'s", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endo", "ftext|>", "é", "ß", "中文", "1", "12", "!", "...", "\u0085", "​", "a", " the", "🙂", "́", "İ", "'re", "don't", " '", "\xa0"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_vocabulary())


def whole(own, texts):
    out = []
    for k, t in enumerate(texts):
        ids, head, tail = chunk_codec.encoded(own, t)
        out.append(chunk_codec.Chunk(np.frombuffer(ids, own.kind), head, tail, k))
    return out


def test_joins_anywhere_are_repaired_exactly(library):
    own, rng = chunk_codec.codec(queries.byte_vocabulary()), random.Random(3)
    for n in range(400):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 300))) if n % 3 else rng.choice(ODD) * rng.randint(1, 900)
        at = sorted({0, *(rng.randrange(len(text)) for _ in range(rng.randint(1, 12)))})
        ids = chunk_codec.assembled(own, whole(own, [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]), {})
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.text(ids).decode() == text


def test_cuts_follow_content_and_keep_characters_whole():
    rng = random.Random(5)
    shared = " ".join("".join(rng.choice("abcdefgé中") for _ in range(rng.randint(1, 9))) for _ in range(4000))
    found = []
    for before in ("", "other words come first here, é"):
        raw = (before + shared).encode()
        places = chunk_codec.cut_places(np.frombuffer(raw, np.uint8), np.array([0])).tolist()
        chunks = [raw[a:b] for a, b in chunk_codec.spaced(places, len(raw))]
        assert b"".join(chunks) == raw and all(c.decode() for c in chunks)
        found.append(set(chunks))
    assert len(found[0] & found[1]) > 0.8 * len(found[0])


def expected(library, rows):
    out = []
    for k, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_documents_equal_the_library(spark, library, tmp_path, monkeypatch):
    rng = random.Random(6)
    long = " ".join(rng.choice(ODD) + rng.choice("xyz") for _ in range(30_000))
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "ß" * 50_000), (4, long), (5, long + " tail"), (6, "x " + long), (6, "x " + long), (None, "no id"), (7, "<|endoftext|>" * 400), (8, " " * 9000 + "a")]
    spark.createDataFrame([(k, t, 1, b"k", 2) for k, t in rows], "doc_id long, text string, block long, key binary, part int").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    path = queries.byte_vocabulary()
    assert sorted(map(repr, map(tuple, chunk_codec.digests(docs, path).collect()))) == expected(library, rows)
    assert chunk_codec.digests(docs.where("doc_id < -1"), path).count() == 0


def test_query_equals_the_library(spark, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(repr, map(tuple, queries.op11_chunk_codec(spark, DATA).collect()))) == expected(library, rows)
