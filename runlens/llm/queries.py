"""The registered queries of this subpackage, each over its whole table, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import chunk_codec, decontaminate, fingerprints, html_text, language_id, line_dedup, near_dup, packing, prefix_trie, quality_knn, secrets_markov, turn_repair, url_reputation
from runlens.llm.common import table


def vocabulary() -> str:
    """The public word-level vocabulary that op10 packs by."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    """The public byte-level vocabulary that op11 encodes by."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge(pages, url_reputation.outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("gone", lambda i: i.cast("string")), ",")
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws("+", r["line"].cast("string"), r["lines"].cast("string"))), ",")
    return kept.select("doc_id", "n_lines", F.size("gone").alias("n_gone"), listed.alias("gone"), "text", runs.alias("runs"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_markov.secrets(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op11_chunk_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_codec.digests(table(spark, sf_dir, "documents"), byte_vocabulary())


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_html_text, op3_url_reputation, op4_quality, op5_near_dup, op6_line_dedup, op7_language_id, op8_secrets, op9_fingerprints, op10_packing, op11_chunk_codec, op12_prefix_trie, op13_turn_repair, pipeline)}
ORACLE = {"op3_url_reputation": url_reputation.oracle(), "op12_prefix_trie": prefix_trie.oracle(), "op13_turn_repair": turn_repair.oracle()}
