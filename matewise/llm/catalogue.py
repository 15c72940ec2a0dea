"""Registered queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, htmltext, langid, mixing, neardup, nndescent, oracles, packing, quotes, secrets, sharding, tokens, vectorlinks, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in reply order, without quotes."""
    rows, _ = quotes.threads(table(spark, sf_dir, "conversations"))
    return rows.withColumnRenamed("conv", "conv_id")


def op2_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a similarity of 0.75 or more."""
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("place", "sole")
    return rows.withColumnRenamed("id", "doc_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a 150 % mix at weights 3, 1, 2 takes of each document."""
    rows, _, pieces = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_words(rows, pieces).select("doc_id", "size", "source_size", "target", "taken", "n_slots")


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids."""
    rows = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumnRenamed("id", "doc_id")


def op5_host_suffix_array_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    rows = htmltext.extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", "n_chars")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 512."""
    rows = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "n_pre_tokens")


def op7_nn_descent_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found for every embedding whose id is divisible by 50."""
    return nndescent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards (2 regions of 3 racks of 4), and where a 25th would put them."""
    rows = sharding.shard_rows(table(spark, sf_dir, "documents"), sharding.HashTree.uniform(2, 3, 4))
    return rows.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack"
    )


def op9_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    filters = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), filters).select("doc_id", "held_out", "lang_pred", "score")


def op10_rotation_code_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among vectors of one label, and their components."""
    rows = vectorlinks.near_duplicates(table(spark, sf_dir, "embeddings"))
    return rows.withColumnRenamed("id", "vec_id")


def op11_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document; base kinds are the first three rules."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    counts = [secrets.count_of("spans", k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.RULES[:3])]
    return found.select(
        F.col("id").alias("doc_id"), *counts, F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans")
    )


def op12_prefix_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of 2 to 5 words of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four leading components of the distinct ones, at unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quotation_threads": op1_quotation_threads,
        "op2_setsketch_near_duplicates": op2_setsketch_near_duplicates,
        "op3_mix_sources": op3_mix_sources,
        "op4_sum_of_squares_packing": op4_sum_of_squares_packing,
        "op5_host_suffix_array_text": op5_host_suffix_array_text,
        "op6_token_counts": op6_token_counts,
        "op7_nn_descent_search": op7_nn_descent_search,
        "op8_hash_tree_shards": op8_hash_tree_shards,
        "op9_language_filters": op9_language_filters,
        "op10_rotation_code_links": op10_rotation_code_links,
        "op11_trigram_secrets": op11_trigram_secrets,
        "op12_prefix_collocations": op12_prefix_collocations,
        "op13_compensated_whitening": op13_compensated_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
