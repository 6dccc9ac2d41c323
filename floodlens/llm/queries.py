"""One thin query for each corpus operator: it applies the operator to the whole table and
derives digest columns from its result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.llm import (
    alignment,
    bpe_chunks,
    exact,
    language,
    packing,
    prefix_hash,
    secrets,
    simhash,
    spelling,
    substrings,
    suffixes,
    token_files,
    top_k,
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprints(documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.secrets(documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_byte_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_chunks.encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.word_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checksums(token_files.read_tokens(spark, path))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.exact_groups(documents(spark, sf_dir))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op11_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.top_k(vectors, F.expr("vec_id % 20 = 0"), k=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("byte_bpe_50k.json", "piece_bpe_32k.model")
    paths = [public_tokenizers.path(name) for name in names]
    return alignment.align(documents(spark, sf_dir), *paths, public_tokenizers.PATTERN).drop("groups")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_prefix_fingerprints": op1_prefix_fingerprints,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe_chunks": op5_byte_bpe_chunks,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_files": op7_token_files,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_top_k_search": op11_top_k_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_alignment": op13_token_alignment,
}
