"""Five stages that turn raw documents into training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. With no documents left, later stages return empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrix.llm import decontamination, language_id, line_dedup, near_copies, sentence_pieces
from rastrix.llm.common import SharedTable, drop_tables, fold_of, written
from rastrix.llm.queries import PIECE_BPE, table, tokenizer_file


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; the models learn from the labelled ones."""
    return language_id.keep_identified(docs, language_id.train(docs, fold_of(F.col("doc_id"), 4) != 2))


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs in others."""
    return line_dedup.drop_recurring_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: links of SimHash fingerprints (3 bits at most), and verified ones at a Jaccard similarity of 0.8 or more, both of five-word shingles."""
    return near_copies.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text's pieces with the end id, their number, and digests of the ids and of the decoded text."""
    return sentence_pieces.encode_pieces(docs, tokenizer_file(PIECE_BPE).read_bytes()).drop("decoded")


STAGES = [("language ID", identified), ("line dedup", without_recurring_lines), ("SimHash near-dedup", one_of_each_group), ("benchmark decontamination", decontaminated), ("SentencePiece encoding", encoded)]
#: The first stage's models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written as Parquet and reread; what a stage has written besides its result is deleted after it."""
    docs, since = table(spark, sf_dir, "documents"), len(SharedTable.standing)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_tables(since, but=docs)
    return docs
