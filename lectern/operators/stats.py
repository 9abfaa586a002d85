"""Corpus statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def group_stats(docs: DataFrame) -> DataFrame:
    """documents, words, average words by crawl_group."""
    return docs.withColumn("w", T.word_count("text")).groupBy("crawl_group").agg(F.count("*").alias("documents"), F.sum("w").alias("words"), F.round(F.avg("w"), 4).alias("avg_words"))


def token_stats(docs: DataFrame, counted: Callable[[str], Column] = lambda c: F.size(T.tokens(c))) -> DataFrame:
    """One row of token statistics; `counted` gives the number of tokens of a text column, such as T.bpe_count(path)."""
    d = docs.select(counted("text").cast("int").alias("n"), F.length("text").alias("c"))
    return d.agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 2).alias("avg_tokens"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.sum("c").alias("characters"))


def crawl_summary(pages: DataFrame) -> DataFrame:
    """fetch_status, crawl_group, document_type and pages of crawl metadata: saved, failed, non-HTML and blocked ones."""
    return pages.groupBy("fetch_status", "crawl_group", "document_type").agg(F.count("*").alias("pages"))


def funnel(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, crawl_group and rows of each stage (name: rows with crawl_group) of a pipeline."""
    parts = [df.groupBy("crawl_group").agg(F.count("*").alias("rows")).select(F.lit(name).alias("stage"), "crawl_group", "rows") for name, df in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
