"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, embedding_dedup, lexical_search, line_dedup, minhash, oracles, packing, quality, secret_scan, sharding, spelling, token_counts, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_counts.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_counts.count_tokens(spark, files)


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op3_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_token_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of two turns full of control strings, read back from the assembled ids."""
    tokenizer, tricky = public_tokenizers.path("byte_bpe_50k.json"), r"\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra), tokenizer), tokenizer)


def op8_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(found["doc"].alias("doc_id"), "class_id", "n_class", "kept")


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_tiered_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("depth")


def op12_rolling_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_line_windows": op3_line_windows,
    "op4_empirical_bayes": op4_empirical_bayes,
    "op5_best_fit": op5_best_fit,
    "op6_cross_polytope": op6_cross_polytope,
    "op7_token_assembly": op7_token_assembly,
    "op8_bag_minhash": op8_bag_minhash,
    "op9_jump_sharding": op9_jump_sharding,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_tiered_index": op11_tiered_index,
    "op12_rolling_deletions": op12_rolling_deletions,
    "op13_redirect_equivalence": op13_redirect_equivalence,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_ownership": oracles.SECRETS,
    "op3_line_windows": oracles.LINE_WINDOWS,
    "op6_cross_polytope": oracles.EMBEDDINGS,
    "op7_token_assembly": oracles.CONVERSATIONS,
    "op8_bag_minhash": oracles.NEAR_DUPLICATES,
    "op9_jump_sharding": oracles.SHARDS,
    "op11_tiered_index": oracles.SEARCH,
    "op12_rolling_deletions": oracles.SPELLING,
    "op13_redirect_equivalence": oracles.URLS,
}
