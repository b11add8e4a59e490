"""Registered queries of the training-data operators (production parameters,
whole tables) and, where SQL can express one, its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raretab.llm import (jaccard, langid, mix, pack, pii, quality, search, shard, spelling, substring, suffix, treap,
                         urlrules)
from raretab.llm._common import read_table
from raretab.llm.sql import ORACLES  # noqa: F401


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    held_out = F.crc32(key.cast("binary")) % 3 == 1
    model = langid.fit(docs, train=~held_out)
    return (langid.predict(docs, model)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every document whose id is divisible by 20, with all its terms,
    against all."""
    docs = read_table(spark, sf_dir, "documents")
    queries = docs.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search.search(docs, queries, query_terms=None).withColumn("score", F.round("score", 8))


def tokenizer_files() -> tuple[str, str]:
    """Paths of the public byte-level vocabulary and its rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(read_table(spark, sf_dir, "documents"), *tokenizer_files()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return mix.taken_words(mix.mix(docs)).select(
        "doc_id", "size", "source_size", "target", "taken", "first_position")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return shard.shard(docs).select(
        "doc_id", shard.record_size(F.col("text")).alias("size"),
        shard.text_checksum(F.col("text")).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(pii.span_string(F.col("base")), 256).alias("base_sha256"),
        pii.span_string(F.col("spans")).alias("spans"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_seen(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


# The host rules of the URL query.
HOST_RULES = (
    urlrules.HostRule("allow", "com", "/"),
    urlrules.HostRule("block", "example.com", "/en/"),
    urlrules.HostRule("allow", "www.example.com", "/en/"),
    urlrules.HostRule("block", "net", "/es/"),
    urlrules.HostRule("block", "net", "/fr/"),
)


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read_table(spark, sf_dir, "pages"), HOST_RULES)


REGISTRY = {
    "op1_bm25_search": op1_bm25_search,
    "op2_packing": op2_packing,
    "op3_source_mix": op3_source_mix,
    "op4_quality_rules": op4_quality_rules,
    "op5_shards": op5_shards,
    "op7_personal_data": op7_personal_data,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op6_language_id": op6_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filter": op13_url_filter,
}
