"""One query per operator: each applies it to its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, line_dedup, lm_scoring, nearest, prefix_trie, quality, sentence_pieces, simhash, substring_dedup, token_counts, toxicity, whitening
from .common import fold_of

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_file(name: str) -> Path:
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 4)
    models = language_id.train(docs, fold != 2)
    found = language_id.identify(docs, models)
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), least=substring_dedup.PASSAGE, with_texts=False)
    # n_repeated counts repeats of the length that is removed; shorter ones, which stay, have a column of their own
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("n_removed").alias("n_repeated"), F.col("n_repeated").alias(f"n_repeated_{substring_dedup.PASSAGE}"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE).read_text(encoding="utf-8"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = fold_of(F.col("doc_id"), 5)
    return lm_scoring.score_texts(docs, fold != 1).withColumn("held_out", fold == 1)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE).read_bytes(), with_texts=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id", "n_links")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold != 0)
    return toxicity.toxicity(docs, model).select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, _ = prefix_trie.encoded(table(spark, sf_dir, "conversations"))
    return prefix_trie.with_digests(*prefix_trie.trie(*prefix_trie.rebuilt(turns)))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = fold_of(F.col("doc_id"), 4)
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), fold != 2)
    return quality.quality(docs, model).select("doc_id", (fold == 2).alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_simhash": op9_simhash,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality": op12_quality,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op2_decontamination": decontamination.ORACLE_SQL, "op3_line_dedup": line_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}
