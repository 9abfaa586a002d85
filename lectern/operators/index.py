"""Inverted index with TF-IDF norms, batch cosine search and its explanation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import BROADCAST_ROWS, by_key, dealt, small_side, staged


@dataclass
class Index:
    postings: DataFrame  #: term, document_id, tf
    lexicon: DataFrame  #: term, df
    norms: DataFrame  #: document_id, token_count, norm_classic, norm_smooth
    documents: int

    def chosen(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lexicon and postings, as far as they may hold terms of `terms` (term); here all of them.

        The postings of a document lie in one task, so that sums by query and document need no shuffle.
        """
        return self.lexicon, self.postings


def postings(docs: DataFrame) -> DataFrame:
    """term, document_id, tf of docs (document_id, text); rows with valid = false stay out. Texts are shuffled, not their tokens."""
    if "valid" in docs.columns:
        docs = docs.filter(~F.col("valid").eqNullSafe(False))
    texts = by_key(docs.select("document_id", T.normal("text").alias("text")), "document_id")
    return texts.select("document_id", F.explode(T.tokens("text")).alias("term")).groupBy("document_id", "term").agg(F.count("*").cast("int").alias("tf"))


def lexicon(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def frequent(lex: DataFrame) -> str:
    """SQL on a staged lexicon (df) that holds for its most frequent terms: as many as a broadcast may have, at most."""
    counts = lex.groupBy("df").agg(F.count("*").alias("n"))  # a row for each df, fewer than the root of twice the postings
    upto = counts.select("df", F.sum("n").over(Window.orderBy(F.col("df").desc())).alias("n"))
    least = upto.filter(F.col("n") <= BROADCAST_ROWS).agg(F.min("df")).first()[0]
    return "false" if least is None else f"df >= {least}"


def norms(post: DataFrame, lex: DataFrame, documents: int) -> DataFrame:
    """Vector norms for both IDF methods."""
    n, columns = F.lit(documents), ["document_id", "tf", "df"]
    hot = frequent(lex)
    often = F.broadcast(lex.filter(hot))
    rest = post.join(often.select("term"), "term", "left_anti").join(lex.filter(f"not ({hot})"), "term")
    # Rare terms' counts go back to their documents before they become sums of doubles, which hardly compress.
    joined = post.join(often, "term").select(*columns).unionByName(by_key(rest.select(*columns), "document_id"))
    weight = lambda method: F.sqrt(F.sum(F.pow(T.log_tf(F.col("tf")) * T.idf(n, F.col("df"), method), F.lit(2))))
    return joined.groupBy("document_id").agg(F.sum("tf").alias("token_count"), weight("classic").alias("norm_classic"), weight("smooth").alias("norm_smooth"))


def build(docs: DataFrame) -> Index:
    return of_postings(dealt(postings(docs), "postings", "document_id"), docs.count())


def of_postings(post: DataFrame, documents: int) -> Index:
    """The index of postings (term, document_id, tf) that `dealt` has written by document_id."""
    lex = staged(lexicon(post), "lexicon")
    return Index(post, lex, dealt(by_key(norms(post, lex, documents), "document_id"), "norms", "document_id"), documents)


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    """The n documents of the lowest document_id."""
    return docs.orderBy("document_id").limit(n)


#: What a catalog keeps of a document, where it has it.
KEPT = ["document_type", "source_collection", "book", "chapter", "verse", "reference", "topic", "place"]


def catalog(docs: DataFrame, norms: DataFrame) -> DataFrame:
    """document_id, url, title (the url where it is missing), token_count, preview, norms and KEPT columns of indexed documents."""
    if "valid" in docs.columns:
        docs = docs.filter(~F.col("valid").eqNullSafe(False))
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    own = docs.select("document_id", "url", title.alias("title"), F.coalesce(T.preview("text"), F.lit("")).alias("preview"), *(c for c in KEPT if c in docs.columns))
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return own.join(norms, "document_id", "left").select(*own.columns, zero("token_count", 0), zero("norm_classic", 0.0), zero("norm_smooth", 0.0))


def with_catalog(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Hits with what the catalog has of their documents; the catalog is reduced to the hits' documents by the join."""
    return hits.join(catalog, "document_id")


def stats(index: Index) -> DataFrame:
    a = index.postings.agg(F.count("*").alias("posting_count"), F.coalesce(F.sum("tf"), F.lit(0)).alias("total_tokens"))
    b = index.lexicon.agg(F.count("*").alias("vocabulary_size"))
    return a.crossJoin(b).select(  # one row each
        F.lit(index.documents).cast("long").alias("document_count"), "vocabulary_size", "posting_count", "total_tokens", F.round(F.col("total_tokens") / F.lit(max(1, index.documents)), 2).alias("average_document_tokens")
    )


def parse_queries(queries: DataFrame) -> DataFrame:
    """query_id, mode, term, qtf, n_terms of queries (query_id, text): infix `and` / `or` set the mode, stopwords go."""
    queries = queries.select("query_id", T.normal("text").alias("text"))
    lower = F.lower(F.trim("text"))
    has = lambda w: lower.rlike(rf"\s+{w}\s+")
    mode = F.when(has("and") & ~has("or"), "and").otherwise("or")
    out = queries.select("query_id", mode.alias("mode"), F.filter(T.tokens(F.regexp_replace(lower, r"\s+(?:and|or)\s+", " ")), lambda t: ~t.isin(T.STOPWORDS)).alias("t"))
    out = out.withColumn("n_terms", F.size(F.array_distinct("t"))).select("query_id", "mode", "n_terms", F.explode("t").alias("term"))
    return out.groupBy("query_id", "mode", "n_terms", "term").agg(F.count("*").cast("int").alias("qtf"))


def best(index: Index, queries: DataFrame, method: str = "classic", k: int = 10) -> DataFrame:
    """query_id, rank, document_id, score: cosine of TF-IDF vectors, ties by document_id."""
    return _Asked(index, queries, method).ranked(k)


def search(index: Index, queries: DataFrame, method: str = "classic", k: int = 10, totals: bool = True) -> DataFrame:
    """query_id, rank, document_id, score, total_hits, matched_terms of the hits of `best`; without totals, hits are not counted."""
    asked = _Asked(index, queries, method)
    ranked = staged(asked.ranked(k), "hits")
    # Words are looked up for the hits alone.
    found = asked.postings.join(small_side(ranked.select("query_id", "document_id")), "document_id").join(asked.weights.select("query_id", "term"), ["query_id", "term"])
    matched = found.groupBy("query_id", "document_id").agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("matched_terms"))
    out = ranked.join(matched, ["query_id", "document_id"])
    if not totals:
        return out.select("query_id", "rank", "document_id", "score", "matched_terms")
    total = asked.scored().groupBy("query_id").agg(F.count("*").alias("total_hits"))
    return out.join(total, "query_id").select("query_id", "rank", "document_id", "score", "total_hits", "matched_terms")


class _Asked:
    """Queries' terms beside the postings that may hold them."""

    def __init__(self, index: Index, queries: DataFrame, method: str):
        self.norms, self.method, asked = index.norms, method, small_side(staged(parse_queries(queries), "asked"))
        lexicon, self.postings = index.chosen(asked)
        idf = T.idf(F.lit(index.documents), F.col("df"), method)
        terms = asked.join(lexicon, "term").withColumn("qw", T.log_tf(F.col("qtf")) * idf).withColumn("weight", F.col("qw") * idf)
        self.terms = staged(terms.select("query_id", "mode", "n_terms", "term", "df", "qw", "weight"), "asked-terms")
        self.weights = small_side(self.terms.select("query_id", "term", "weight"))

    def scored(self) -> DataFrame:
        """query_id, document_id, score of all hits. Each task sums up its own documents; only queries' terms are sent to it."""
        parts = []
        if not (terms := self.terms.filter("mode = 'or'")).isEmpty():
            parts.append(_summed(self.postings.join(small_side(terms.select("query_id", "term", "weight")), "term")))
        if not (terms := self.terms.filter("mode = 'and'")).isEmpty():
            # A hit of an `and` query has its rarest term, if all its terms are known.
            own = Window.partitionBy("query_id")
            known = terms.withColumn("_n", F.count("*").over(own)).filter("_n = n_terms").withColumn("_r", F.row_number().over(own.orderBy("df", "term")))
            known = staged(known, "and-terms")
            pairs = self.postings.join(small_side(known.filter("_r = 1").select("query_id", "term")), "term").select("query_id", "document_id")
            found = self.postings.join(by_key(pairs, "document_id").hint("shuffle_hash"), "document_id").join(small_side(known.select("query_id", "term", "weight", "n_terms")), ["query_id", "term"])
            both = found.groupBy("query_id", "document_id").agg(_dot(), F.count("*").alias("_m"), F.max("n_terms").alias("_n"))
            parts.append(both.filter("_m = _n").drop("_m", "_n"))
        dots = reduce(DataFrame.unionByName, parts) if parts else _summed(self.postings.join(self.weights, "term"))
        norm = F.col(f"norm_{self.method}")
        lengths = small_side(staged(self.terms.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm")), "query-norms"))
        out = dots.join(lengths, "query_id").join(self.norms.select("document_id", norm).hint("shuffle_hash"), "document_id").filter((norm > 0) & (F.col("qnorm") > 0))
        return out.select("query_id", "document_id", F.round(F.col("dot") / (F.col("qnorm") * norm), 6).alias("score")).filter("score > 0")

    def ranked(self, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id"))  # each task keeps the first k
        return self.scored().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "score")


def _dot():
    return F.sum(F.col("weight") * T.log_tf(F.col("tf"))).alias("dot")


def _summed(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "document_id").agg(_dot())


def explain(index: Index, queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Arithmetic of each lexicon term of the queries for each hit, for both IDF methods; absent terms have dtf 0."""
    n, asked = F.lit(index.documents), small_side(staged(parse_queries(queries), "asked"))
    lexicon, postings = index.chosen(asked)
    terms = asked.join(lexicon, "term")
    hits = staged(hits.select("query_id", "document_id"), "explained-hits")
    pairs = hits.join(terms, "query_id")
    own = postings.select("document_id", "term", "tf").join(small_side(hits.select("document_id").distinct()), "document_id", "left_semi")
    full = pairs.join(own, ["document_id", "term"], "left").withColumn("dtf", F.coalesce("tf", F.lit(0)))
    cols = [F.round(T.log_tf(F.col("qtf")), 6).alias("qtf_weight"), F.round(T.log_tf(F.col("dtf")), 6).alias("dtf_weight")]
    for m in ("classic", "smooth"):
        i = T.idf(n, F.col("df"), m)
        cols += [F.round(i, 6).alias(f"idf_{m}"), F.round(T.log_tf(F.col("qtf")) * i * T.log_tf(F.col("dtf")) * i, 6).alias(f"contribution_{m}")]
    return full.select("query_id", "document_id", "term", "qtf", "dtf", "df", *cols)
