"""A corpus from raw documents to packed sequences: STAGES, run() and ORACLE_SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import line_dedup, mixing, ngram_join, packing, quality
from lectern.llm.common import WORD, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough words outside boilerplate lines.

    Null and empty texts fail the base rules; repeated rows stay or go together; a null source is a host of its own.
    Very long texts are judged whole, other columns may have any name, and an empty table gives an empty one.
    """
    return quality.filter_documents(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left without a word go. n_chars follows the text.

    Null and empty texts have no word and go; rows that repeat a (doc_id, text) have one result. Given columns n_lines
    and n_removed are kept only if line dedup does not make them; the table of documents has none. Empty tables stay empty.
    """
    out = line_dedup.line_dedup(docs).filter(F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest doc_id.

    Documents without words stay, rows that repeat a (doc_id, text) go but one, and a doc_id that has several texts
    keeps each of them that stands for its class. A null text is empty; other columns may have any name.
    """
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture: of each leaf the prefix of its rows that its share of 60 % of all words pays for.

    Texts without words are never taken; null lang and source are leaves of their own; repeated rows are taken each.
    A given column domain is used as the top level. An empty table gives an empty one.
    """
    return mixing.mix(docs, percent=60, max_epochs=1).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, of whole texts; an empty text is its end token; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The packing stage needs a tokenizer, which SQL lacks; tests/llm holds the stages against brute force.
ORACLE_SQL = None
