"""Top-k search that leaves out documents by bounds: essential terms first, then blocks, and whole scores for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import by_key, small_side, staged

#: Best postings kept of each key, and what rounding to six digits may hide.
CHAMPIONS, SLACK = 64, 1e-6


@dataclass
class Impacts:
    """What a key adds to a document's score at weight 1, with its greatest values over all documents and over blocks."""

    postings: DataFrame  #: key, document_id, block, impact
    maxima: DataFrame  #: key, df, most
    blocks: DataFrame  #: key, block, most
    champions: DataFrame  #: key, document_id, impact of its CHAMPIONS best documents


def block_of(column: str, kind: str) -> Column:
    """Number of the block of a document: neighbours where ids are numbers, else one of 4,096 by hash."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.floor(F.col(column) / 1024)
    return F.pmod(F.xxhash64(column), F.lit(4096))


def champions(postings: DataFrame, impact: str = "impact") -> DataFrame:
    """The CHAMPIONS best postings of each key; a task keeps as many of a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("impact").desc(), "document_id"))
    return postings.select("key", "document_id", F.col(impact).alias("impact")).withColumn("_r", rank).filter(F.col("_r") <= CHAMPIONS).drop("_r")


def impacts(postings: DataFrame) -> Impacts:
    """Impacts of staged postings (key, document_id, impact >= 0), with the tables of their bounds."""
    post = postings.withColumn("block", block_of("document_id", dict(postings.dtypes)["document_id"]))
    blocks = staged(post.groupBy("key", "block").agg(F.max("impact").alias("most"), F.count("*").alias("df")), "impact-blocks")
    maxima = blocks.groupBy("key").agg(F.sum("df").alias("df"), F.max("most").alias("most"))
    return Impacts(post, staged(maxima, "impact-maxima"), blocks, staged(champions(post), "champions"))


@dataclass
class Search:
    """Steps of a search, staged, so that their sizes can be told."""

    terms: DataFrame  #: query_id, key, base, weight, df, most, essential, slack, floor, mode, n_terms
    candidates: DataFrame  #: query_id, document_id, block, part
    kept: DataFrame  #: query_id, document_id
    hits: DataFrame  #: query_id, rank, document_id, score

    def work(self) -> dict[str, int]:
        """Postings of all asked keys, those of essential ones, candidates, and documents whose score was made whole."""
        every, essential = self.terms.agg(F.sum("df"), F.sum(F.when(F.col("essential"), F.col("df")))).first()
        return {"postings": every or 0, "essential": essential or 0, "candidates": self.candidates.count(), "scored": self.kept.count()}


def _kth(scored: DataFrame, k: int, floor: str) -> DataFrame:
    """query_id, floor: the k-th best score of each query, where it has k."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    return scored.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy("query_id").agg(F.count("*").alias("_n"), F.min("score").alias(floor)).filter(F.col("_n") == k).drop("_n")


def top_k(tables: Impacts, asked: DataFrame, k: int = 10) -> Search:
    """The k best documents of each query by the sum of weight * impact, rounded to six digits, ties by document_id.

    asked: query_id, key, base, weight, mode (`and` asks for all n_terms bases, of which each may have several keys),
    n_terms. The sums over champions give a floor that k documents reach. Of the keys in ascending order of their
    greatest parts, those that together stay below the floor are not essential: no document has its place by them
    alone. So only postings of the other keys make candidates (of an `and` query those of the rarest base); a
    candidate goes if even the greatest parts of the other keys within its block leave it below the floor; and what
    remains is scored whole.
    """
    terms = staged(asked.join(tables.maxima, "key").withColumn("bound", F.col("weight") * F.col("most")), "asked-keys")
    seen = tables.champions.join(small_side(terms.filter("mode = 'or'").select("query_id", "key", "weight")), "key")
    floor = _kth(seen.groupBy("query_id", "document_id").agg(F.sum(F.col("weight") * F.col("impact")).alias("score")), k, "floor")
    # A query's own keys are one group: as many as its text has words.
    ascending = Window.partitionBy("query_id").orderBy("bound", "key")
    rarest = Window.partitionBy("query_id").orderBy("_base_df", "base")
    terms = terms.join(floor, "query_id", "left").fillna(0.0, ["floor"])
    terms = terms.withColumn("_sum", F.sum("bound").over(ascending)).withColumn("_base_df", F.sum("df").over(Window.partitionBy("query_id", "base")))
    terms = terms.withColumn("_rank", F.dense_rank().over(rarest))
    terms = terms.withColumn("essential", F.when(F.col("mode") == "and", F.col("_rank") == 1).otherwise(F.col("_sum") >= F.col("floor") - SLACK))
    slack = F.coalesce(F.max(F.when(~F.col("essential"), F.col("_sum"))).over(Window.partitionBy("query_id")), F.lit(0.0))
    terms = staged(terms.withColumn("slack", slack).drop("_sum", "_base_df", "_rank"), "asked-bounds")
    first = tables.postings.join(small_side(terms.filter("essential").select("query_id", "key", "weight")), "key").groupBy("query_id", "document_id", "block").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    first = staged(first, "candidates")
    of = terms.select("query_id", "mode", "slack", "floor").distinct()
    again = _kth(first, k, "_again")
    bounded = first.join(of, "query_id").join(again, "query_id", "left").withColumn("floor", F.greatest("floor", F.coalesce("_again", F.lit(0.0))))
    either = lambda more: (F.col("mode") == "and") | (F.col("score") + more >= F.col("floor") - SLACK)
    bounded = bounded.filter(either(F.col("slack")))
    others = terms.filter("not essential and mode = 'or'").select("query_id", "key", "weight")
    places = bounded.filter("mode = 'or'").select("query_id", "block").distinct()
    rest = places.join(others, "query_id").join(tables.blocks.select("key", "block", "most"), ["key", "block"]).groupBy("query_id", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("_rest"))
    kept = bounded.join(rest, ["query_id", "block"], "left").filter(either(F.coalesce("_rest", F.lit(0.0)))).select("query_id", "document_id")
    kept = staged(kept, "kept-candidates")
    # Postings stay where they are: candidates go to their documents, and the queries' keys are broadcast.
    whole = tables.postings.select("key", "document_id", "impact").join(by_key(kept, "document_id").hint("shuffle_hash"), "document_id")
    whole = whole.join(small_side(terms.select("query_id", "key", "base", "weight", "mode", "n_terms")), ["query_id", "key"])
    scored = whole.groupBy("query_id", "document_id", "mode", "n_terms").agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"), F.countDistinct("base").alias("_m"))
    scored = scored.filter((F.col("mode") == "or") | (F.col("_m") == F.col("n_terms"))).filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id"))
    hits = scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "score")
    return Search(terms, first, kept, hits)
