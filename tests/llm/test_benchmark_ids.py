"""Benchmark rows with null or repeated ids are items of their own."""

from runlens.llm import decontaminate


def test_items_with_null_or_repeated_ids_are_all_searched(spark, monkeypatch):
    texts = [" ".join(f"{name}{k}" for k in range(20)) for name in ("one", "two", "three", "four", "five")]
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(texts)], "doc_id long, text string")
    want = [(0, None), (1, None), (2, 7), (3, 7)]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == want
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()] == [4]
    whole = decontaminate.blocks
    monkeypatch.setattr(decontaminate, "blocks", lambda b: whole(b, limit=150))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == want
