"""The registered queries of the subpackage: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmetrics.llm import (conversation_trie, decontaminate, embed_dedup, langid, line_dedup, oracle, piece_bpe, pseudonyms, quality, shards, simhash,
                             suffix_dedup, toxicity, whitening)

#: The key of the registered query; a deployment passes its own secret.
PSEUDONYM_KEY = b"registered query"


def piece_model() -> str:
    """The path of the tokenizer's vocabulary file; it is looked for when a query needs it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read(spark, sf_dir, "documents", "doc_id", "text"),
                                       read(spark, sf_dir, "benchmark", "item_id", "text"))
    contaminated = (F.col("n_hit") > 0) & (decontaminate.SHARE * F.col("n_hit") >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"), digest=True)
    return kept.withColumnRenamed("id", "doc_id")


def op3_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                        (F.col("id") == F.col("component")).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.remove_repeated(read(spark, sf_dir, "documents", "doc_id", "text"), count=True)
    return kept.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = pseudonyms.pseudonymise(docs, PSEUDONYM_KEY)
    return found.select("doc_id", F.size("pseudonyms").cast("long").alias("n_pseudonyms"), *pseudonyms.counts(), F.col("new_text").alias("text"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(read(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", langid.held_out("doc_id", 4, 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = langid.identify(docs.drop("lang"), langid.learn(docs))
    return found.select("doc_id", langid.held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), F.col("component").alias("component_id"))


def op10_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_texts(read(spark, sf_dir, "documents", "doc_id", "text"), piece_model(), digest=True).drop("text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings", "vec_id", "embedding")).withColumnRenamed("id", "vec_id")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.select(F.col("id").alias("doc_id"), *quality.FIGURES, "base_failed", "kept", "perplexity", "lower", "upper")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_embed_dedup": op3_embed_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_pseudonyms": op5_pseudonyms,
        "op6_shards": op6_shards,
        "op7_toxicity": op7_toxicity,
        "op8_language_id": op8_language_id,
        "op9_simhash": op9_simhash,
        "op10_piece_bpe": op10_piece_bpe,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_whitening": op12_whitening,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": oracle.DECONTAMINATE,
        "op2_suffix_dedup": oracle.SUFFIX_DEDUP,
        "op3_embed_dedup": oracle.EMBED_DEDUP,
        "op4_line_dedup": oracle.LINE_DEDUP,
        "op11_conversation_trie": oracle.CONVERSATION_TRIE,
    }
