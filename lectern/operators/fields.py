"""Search over several fields: boolean, phrase, fuzzy and filtered, ranked by BM25."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import by_key, dealt, small_side, split_join, staged
from . import bounded
from .index import frequent

K1, B, MAX_EXPANSIONS = 1.2, 0.75, 50
#: Letters of a term that its deletion neighbourhood looks at: a bound on the entries of a term of any length.
PREFIX = 8

#: How the columns of a search document are searched: as words, as a whole, as numbers.
WORDS = ["title", "text", "topic", "place", "wiki_title", "wiki_categories", "wiki_sections", "wiki_bold_terms"]
WHOLE = ["crawl_group", "document_type", "book", "wiki_page_id", "wiki_infobox_type"]
NUMBERS = ["chapter", "verse", "wiki_text_length", "wiki_category_count", "wiki_section_count", "wiki_template_count", "wiki_internal_link_count", "wiki_external_link_count", "wiki_reference_count"]


def prepared(docs: DataFrame) -> DataFrame:
    """Search documents ready for `filtered` and `field_tokens`: document_id, url, preview and the columns above.

    Lists, also as JSON text, become their items between spaces; texts are trimmed and blank ones null; numbers that
    cannot be read are null, and so are columns that docs lack.
    """
    kinds = {f.name: f.dataType.typeName() for f in docs.schema.fields}

    def words(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        text = F.array_join(name, " ", "None") if kinds[name] == "array" else T.list_text(F.col(name).cast("string"))
        return blank_to_null(text if name.startswith("wiki_") and name != "wiki_title" else F.col(name).cast("string"))

    def blank_to_null(text: Column) -> Column:
        cut = F.regexp_replace(text, f"^(?:{T.BLANK})|(?:{T.BLANK})$", "")
        return F.when(cut != "", cut)

    whole = [(blank_to_null(F.col(c).cast("string")) if c in kinds else F.lit(None).cast("string")).alias(c) for c in WHOLE]
    numbers = [(F.col(c).try_cast("int") if c in kinds else F.lit(None).cast("int")).alias(c) for c in NUMBERS]
    preview = T.preview_dots("text") if "text" in kinds else F.lit(None).cast("string")
    url = F.col("url") if "url" in kinds else F.lit(None).cast("string")
    return docs.select("document_id", url.alias("url"), F.when(preview != "", preview).alias("preview"), *(words(c).alias(c) for c in WORDS), *whole, *numbers)


def field_tokens(docs: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    """document_id, field, pos, term of the text fields of docs; `keep` columns stay for filters."""
    return _exploded(docs.withColumns({f: T.normal(f) for f in fields}), fields, keep)


def _exploded(docs: DataFrame, fields: list[str], keep: list[str] | None = None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), T.tokens(F.coalesce(F.col(f), F.lit(""))).alias("t")) for f in fields])
    out = docs.select("document_id", *(keep or []), F.explode(pairs).alias("f"))
    return out.select("document_id", *(keep or []), "f.field", F.posexplode("f.t").alias("pos", "term"))


def field_postings(docs: DataFrame, fields: list[str]) -> DataFrame:
    """field, term, document_id, f of the text fields, dealt by document_id: for searches, instead of tokens. Only texts are shuffled."""
    texts = by_key(docs.select("document_id", *(T.normal(f).alias(f) for f in fields)), "document_id")
    return dealt(_counted(_exploded(texts, fields)), "field-postings", "document_id")


def _counted(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("document_id", "field", "term").agg(F.count("*").alias("f"))


def _postings(tokens: DataFrame) -> DataFrame:
    """Field postings as they are; tokens are counted by document first."""
    return tokens if "f" in tokens.columns else dealt(_counted(by_key(tokens.select("document_id", "field", "term"), "document_id")), "field-postings", "document_id")


def _lengths(post: DataFrame) -> DataFrame:
    """document_id, lens (a map by field)."""
    own = post.groupBy("document_id", "field").agg(F.sum("f").alias("len"))
    return dealt(own.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "len"))).alias("lens")), "field-lengths", "document_id")


def _impacts(post: DataFrame, terms: DataFrame | None) -> DataFrame:
    """field, term, document_id, impact of the terms (term, each once; None: all): BM25 at boost 1, N and length by field."""
    lengths = _lengths(post)
    fields = lengths.select(F.explode("lens").alias("field", "len")).groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    asked = post if terms is None else post.join(small_side(terms), "term")
    df = staged(asked.groupBy("field", "term").agg(F.count("*").alias("df")).join(F.broadcast(fields), "field"), "field-terms")  # a row for each field
    found = split_join(post, df, ["field", "term"], frequent(df)) if terms is None else post.join(small_side(df), ["field", "term"])
    found = found.join(lengths.hint("shuffle_hash"), "document_id").withColumn("len", F.col("lens")[F.col("field")])
    return found.select("field", "term", "document_id", _bm25().alias("impact"))


def scores(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """query_id, document_id, base, part: BM25 of each term (query_id, base, term, boost) in each field, N and length by field.

    tokens: `field_postings` or `field_tokens`. The rows of a document stay in one task.
    """
    terms = staged(terms, "asked-terms")
    found = _impacts(_postings(tokens), staged(terms.select("term").distinct(), "asked-words"))
    return found.join(small_side(terms.select("query_id", "base", "term", "boost")), "term").withColumn("part", F.col("boost") * F.col("impact"))


def _bm25() -> Column:
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("f") / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def field_impacts(tokens: DataFrame, queries: DataFrame | None = None) -> bounded.Impacts:
    """BM25 of every term in every field at boost 1, by key `field:term`, with the bounds that `boolean_top` needs; made once.

    tokens: `field_postings` or `field_tokens`. queries: those that will be asked, if they are known: then only their
    terms are scored.
    """
    post = _postings(tokens)
    found = _impacts(post, None if queries is None else staged(query_terms(queries).select("term").distinct(), "field-words"))
    return bounded.impacts(staged(found.select(F.concat_ws(":", "field", "term").alias("key"), "document_id", "impact"), "field-impacts"))


def boolean_top(tables: bounded.Impacts, fields: list[str], queries: DataFrame, mode: str = "or", k: int = 10) -> bounded.Search:
    """Hits of `boolean` by bounds, for queries that have words; tables: field_impacts of the searched fields."""
    terms = query_terms(queries)
    need = terms.groupBy("query_id").agg(F.countDistinct("base").alias("n_terms")).withColumn("mode", F.lit(mode))
    keys = terms.withColumn("key", F.explode(F.array(*(F.concat(F.lit(f + ":"), F.col("term")) for f in fields))))
    return bounded.top_k(tables, keys.join(need, "query_id").select("query_id", "key", "base", F.col("boost").alias("weight"), "mode", "n_terms"), k)


def top(parts: DataFrame, k: int, need: DataFrame | None = None) -> DataFrame:
    """Sum of parts by query and document, ranked; `need` (query_id, n_terms) asks for all terms."""
    sums = [F.round(F.sum("part"), 6).alias("score")]
    if need is None:
        out = parts.groupBy("query_id", "document_id").agg(*sums)
    else:
        out = parts.groupBy("query_id", "document_id").agg(*sums, F.countDistinct("base").alias("m"))
        out = out.join(need, "query_id").filter(F.col("m") == F.col("n_terms"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "document_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "document_id", "score")


def _words() -> Column:
    return F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z0-9]+"), F.lit(0))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, base, term, boost: every word counts, stopwords too, and repeats by their number."""
    return queries.select("query_id", F.explode(_words()).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("boost")).withColumn("base", F.col("term"))


def boolean(tokens: DataFrame, queries: DataFrame, mode: str = "or", k: int = 10) -> DataFrame:
    """Ranked documents with any (or) or all (and) terms of each query; a query without terms matches all, with score 1."""
    post, terms = _postings(tokens), staged(query_terms(queries), "query-terms")
    found = top(scores(post, terms), k) if mode != "and" else _all_terms(post, terms, k)
    bare = queries.filter(~F.coalesce(F.col("text"), F.lit("")).rlike("[A-Za-z0-9]")).select("query_id").distinct()
    if bare.isEmpty():
        return found
    first = post.select("document_id").distinct().orderBy("document_id").limit(k)
    first = first.select(F.row_number().over(Window.orderBy("document_id")).alias("rank"), "document_id")  # k rows
    return found.unionByName(bare.crossJoin(F.broadcast(first)).select("query_id", "rank", "document_id", F.lit(1.0).alias("score")))


def _all_terms(post: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Documents with all terms of a query: only those with its rarest term are scored."""
    words = small_side(staged(terms.select("term").distinct(), "asked-words"))
    counts = post.join(words, "term").groupBy("term").agg(F.count("*").alias("c"))
    own = Window.partitionBy("query_id")
    known = terms.join(counts, "term", "left").withColumn("_known", F.count("c").over(own)).withColumn("n_terms", F.count("*").over(own)).filter("_known = n_terms")
    known = staged(known.withColumn("r", F.row_number().over(own.orderBy("c", "term"))).drop("_known"), "known-terms")
    holders = by_key(post.join(small_side(known.filter("r = 1").select("query_id", "term")), "term").select("query_id", "document_id").distinct(), "document_id")
    found = _impacts(post, staged(known.select("term").distinct(), "known-words"))
    own_terms = small_side(known.select("query_id", "base", "term", "boost"))
    parts = found.join(holders.hint("shuffle_hash"), "document_id").join(own_terms, ["query_id", "term"]).withColumn("part", F.col("boost") * F.col("impact"))
    return top(parts, k, small_side(known.select("query_id", "n_terms").distinct()))


def filtered(docs: DataFrame, exact: Mapping | None = None, ranges: Mapping | None = None) -> DataFrame:
    """docs whose columns equal the exact values and lie in the ranges (low, high), ends included; filters do not score.

    Empty exact values are ignored; an end that is None is open; a null column never matches. low above high is an error.
    """
    for column, value in (exact or {}).items():
        if value is not None and value != "":
            docs = docs.filter(F.col(column) == value)
    for column, (low, high) in (ranges or {}).items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{column}: {low} is above {high}")
        docs = docs.filter(F.col(column) >= low) if low is not None else docs
        docs = docs.filter(F.col(column) <= high) if high is not None else docs
    return docs


def phrase(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, document_id, field, hits: consecutive positions within one field.

    Only positions of a query's rarest word start a run. Runs without its second rarest word at the right distance go,
    and the positions that the other words need are looked up in what is left alone. A word that no document has ends
    its query. tokens should be staged: they are read for the counts and for each of these steps.
    """
    here = ["document_id", "field", "pos", "term"]
    wanted = queries.select("query_id", F.size(_words()).alias("n"), F.posexplode(_words()).alias("off", "term"))
    words = small_side(staged(wanted.select("term").distinct(), "phrase-words"))
    counts = tokens.join(words, "term").groupBy("term").agg(F.count("*").alias("c"))
    ordered = Window.partitionBy("query_id").orderBy("c", "off")  # the words of one query
    wanted = wanted.join(counts, "term", "left").withColumn("_lost", F.max(F.col("c").isNull()).over(Window.partitionBy("query_id"))).filter("not _lost")
    wanted = staged(wanted.withColumn("r", F.row_number().over(ordered)).drop("_lost"), "phrase-places")
    runs = tokens.join(small_side(wanted.filter("r = 1").select("query_id", "n", "off", "term")), "term").select("query_id", "n", "document_id", "field", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")
    runs = staged(runs, "phrase-runs")
    need = lambda cond: runs.join(wanted.filter(cond).select("query_id", "off", "term"), "query_id").withColumn("pos", F.col("start") + F.col("off"))
    seconds = small_side(staged(wanted.filter("r = 2").select("term").distinct(), "phrase-seconds"))
    second = staged(tokens.select(*here).join(seconds, "term", "left_semi").join(need("r = 2"), here).select("query_id", "n", "document_id", "field", "start"), "phrase-pairs")
    left = second.filter("n > 2").join(wanted.filter("r > 2").select("query_id", "off", "term"), "query_id").withColumn("pos", F.col("start") + F.col("off"))
    near = tokens.select(*here).join(small_side(staged(second.filter("n > 2").select("document_id", "field").distinct(), "phrase-documents")), ["document_id", "field"], "left_semi")
    full = near.join(left, here).groupBy("query_id", "n", "document_id", "field", "start").agg(F.count("*").alias("m")).filter("m = n - 2")
    found = runs.filter("n = 1").union(second.filter("n = 2")).select("query_id", "document_id", "field").union(full.select("query_id", "document_id", "field"))
    return found.groupBy("query_id", "document_id", "field").agg(F.count("*").alias("hits"))


def _within_one(a: Column, b: Column) -> Column:
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    places = F.when((F.length(a) > 1) & (F.length(a) == F.length(b)), F.sequence(F.lit(1), F.length(a) - 1))
    return (F.levenshtein(a, b, 1) >= 0) | F.coalesce(F.exists(places, lambda i: swap(i) == b), F.lit(False))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether optimal string alignment of a and b (an adjacent swap is one edit, its letters have no other) is within 1 or 2 edits."""
    if edits == 1:
        return _within_one(a, b)
    one = lambda x, i: F.substring(x, i, F.lit(1))
    before, after = (lambda x, i: F.substring(x, F.lit(1), i - 1)), (lambda x, i: F.substring(x, i + 2, F.length(x)))

    def swapped(i: Column, j: Column) -> Column:
        """Letters i and i + 1 of a are j + 1 and j of b, and one edit at most is beside them."""
        same = (j > 0) & (one(a, i) == one(b, j + 1)) & (one(a, i + 1) == one(b, j))
        p, q, s, t = before(a, i), before(b, j), after(a, i), after(b, j)
        return same & (((p == q) & _within_one(s, t)) | ((s == t) & _within_one(p, q)))

    places = F.when((F.length(a) > 1) & (F.length(b) > 1), F.sequence(F.lit(1), F.length(a) - 1))
    swap = F.exists(places, lambda i: F.exists(F.array(i - 1, i, i + 1), lambda j: swapped(i, j)))
    return (F.levenshtein(a, b, 2) >= 0) | F.coalesce(swap, F.lit(False))


def deletions(term: Column, edits: int) -> Column:
    """The first PREFIX letters of a term with up to `edits` of them left out, each text once.

    Two terms within that many edits (an adjacent swap is one) share one of these: what is not edited in both prefixes.
    """
    less = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(PREFIX))))).otherwise(F.array().cast("array<string>"))
    cut = F.substring(term, 1, PREFIX)
    out = step = F.array(cut)
    for _ in range(edits):
        step = F.array_distinct(F.flatten(F.transform(step, less)))
        out = F.concat(out, step)
    return F.array_distinct(out)


def neighbourhood(vocabulary: DataFrame, edits: int = 1) -> DataFrame:
    """near, term: the deletion index of a vocabulary (term), to be written once for many searches."""
    return vocabulary.select(F.explode(deletions(F.col("term"), edits)).alias("near"), "term")


def fuzzy_pairs(index: DataFrame, asked: DataFrame, edits: int = 1) -> DataFrame:
    """base, term: pairs that share a deletion and differ in length by `edits` at most; only these are compared."""
    near = asked.select("base").distinct().select("base", F.explode(deletions(F.col("base"), edits)).alias("near"))
    pairs = index.join(near, "near").filter(F.abs(F.length("base") - F.length("term")) <= edits)
    return pairs.select("base", "term").distinct()


def fuzzy_terms(tokens: DataFrame, queries: DataFrame, edits: int = 1, index: DataFrame | None = None) -> DataFrame:
    """query_id, base, term, boost: vocabulary terms near each query term; of them the MAX_EXPANSIONS nearest are the feature.

    index: a written `neighbourhood` of the vocabulary for so many edits or more, else it is made of tokens.
    """
    asked = query_terms(queries).select("query_id", "base").distinct()
    index = neighbourhood(tokens.select("term").distinct(), edits) if index is None else index
    near = fuzzy_pairs(index, asked, edits).filter(within(F.col("base"), F.col("term"), edits))
    dist = F.least(F.levenshtein("base", "term"), F.lit(edits))
    near = near.withColumn("boost", 1 - dist / F.least(F.length("base"), F.length("term"))).filter("boost > 0").join(asked, "base")
    rank = F.row_number().over(Window.partitionBy("query_id", "base").orderBy(F.col("boost").desc(), "term"))
    return near.withColumn("r", rank).filter(F.col("r") <= MAX_EXPANSIONS).select("query_id", "base", "term", "boost")


def fuzzy(tokens: DataFrame, queries: DataFrame, edits: int = 1, k: int = 10, index: DataFrame | None = None) -> DataFrame:
    return top(scores(tokens, fuzzy_terms(tokens, queries, edits, index)), k)


def overlap_means(overlaps: DataFrame, by: str = "mode") -> DataFrame:
    """Mean overlap ratio of the queries of each mode, with their number."""
    return overlaps.groupBy(by).agg(F.count("*").alias("queries"), F.round(F.avg("overlap_ratio"), 4).alias("mean_overlap_ratio"))


def overlap(a: DataFrame, b: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """query_id, overlap_count, overlap_ratio (by k) of two runs (query_id, rank, document_id), by their first k rows.

    Queries without results in both runs count, with 0, where queries (query_id) are given.
    Rows without document_id are compared by their title, in lower case and trimmed, where both runs have one.
    """
    def keys(run: DataFrame) -> DataFrame:
        title = F.concat(F.lit("t:"), F.lower(F.trim("title"))) if "title" in run.columns else F.lit(None)
        found = F.when(F.col("document_id").cast("string") != "", F.concat(F.lit("d:"), F.col("document_id").cast("string")))
        return run.filter(F.col("rank") <= k).select("query_id", F.coalesce(found, title).alias("key")).filter("key is not null").distinct()

    both = keys(a).join(keys(b), ["query_id", "key"]).groupBy("query_id").agg(F.count("*").alias("c"))
    every = (a.select("query_id").union(b.select("query_id")) if queries is None else queries.select("query_id")).distinct()
    return every.join(both, "query_id", "left").select("query_id", F.coalesce("c", F.lit(0)).alias("overlap_count"), F.round(F.coalesce("c", F.lit(0)) / k, 4).alias("overlap_ratio"))
