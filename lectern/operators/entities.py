"""Entities of documents, their link to wiki pages through one redirect, enrichment and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_key
from ..sources.shared import keyed_left_join, small_side, staged

#: What links carry of a page, as far as the pages have it.
LISTS = ["categories", "sections", "templates", "bold_terms"]
NUMBERS = ["text_length", "category_count", "section_count", "template_count", "internal_link_count", "external_link_count", "reference_count"]
ATTRIBUTES = [*LISTS, "infobox_type", *NUMBERS]

#: Columns of a search document before those of its wiki page.
DOCUMENT = {"document_id": "string", "title": "string", "text": "string", "url": "string", "crawl_group": "string", "document_type": "string", "book": "string", "chapter": "int", "verse": "int", "topic": "string", "place": "string"}


def first_by_key(pages: DataFrame, columns: list[str]) -> DataFrame:
    """One page for each join_key: articles before redirects, then the lowest page_id."""
    order = F.struct(F.col("redirect").isNotNull(), F.col("page_id"))
    return pages.groupBy("join_key").agg(F.min_by(F.struct(*columns), order).alias("p")).select("join_key", "p.*")


def build(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities of docs (document_id, crawl_group, url, title, place, topic, book) with their join_key.

    Atlas pages give a place, Nave's pages the topic before a colon, Bible pages a book, under the title that mapping
    (bible_book, wiki_title) has for it. Blank names give none.
    """

    def picked(group: str, column: str, kind: str, name: Column) -> DataFrame:
        own = docs.filter((F.col("crawl_group") == group) & (F.length(F.trim(column)) > 0))
        return own.select("document_id", "crawl_group", "url", "title", F.col(column).alias("source_entity")).withColumn("entity_name", name).withColumn("entity_type", F.lit(kind))

    places = picked("atlas", "place", "place", F.col("source_entity"))
    naves = picked("naves", "topic", "naves_entity", F.trim(F.regexp_extract("source_entity", "^([^:]+)", 1))).filter(F.length("entity_name") > 0)
    books = picked("bible", "book", "book", F.col("source_entity")).join(mapping, F.col("source_entity") == F.col("bible_book"), "left").drop("bible_book")
    books = books.withColumn("entity_name", F.coalesce("wiki_title", "source_entity")).drop("wiki_title")
    return places.unionByName(naves).unionByName(books, allowMissingColumns=True).withColumn("join_key", join_key("entity_name"))


def samples(entities: DataFrame, n: int = 20) -> DataFrame:
    """The first n unique entities of each type, by key."""
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy("join_key"))
    return unique_entities(entities).withColumn("rank", rank).filter(F.col("rank") <= n)


def link_samples(links: DataFrame, matched: bool, n: int = 30, with_sections: bool = False) -> DataFrame:
    """The first n matched or unmatched links, by type and key; with_sections: of those whose page has a section."""
    chosen = links.filter(F.col("matched") == matched)
    chosen = chosen.filter("section_count > 0") if with_sections else chosen
    return chosen.orderBy("entity_type", "join_key").limit(n)


def unique_entities(entities: DataFrame) -> DataFrame:
    return entities.filter(F.length("join_key") > 0).select("entity_type", "join_key").distinct()


def link(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Entities (entity_type, join_key) with the page that their key names, or the article that it redirects to.

    Pages are reduced to the keys in use by a semi-join before one page is chosen for each key, so that the long
    columns of other pages are never shuffled. A target that is itself a redirect or missing stays unresolved.
    """
    wanted = unique_entities(entities)
    attributes = [c for c in ATTRIBUTES if c in pages.columns]
    columns = ["page_id", "title", "redirect", *attributes]
    direct = first_by_key(pages.join(wanted.select("join_key").distinct(), "join_key", "left_semi"), columns)
    articles = pages.filter(F.col("redirect").isNull())
    targets = direct.select(join_key("redirect").alias("join_key")).filter("join_key is not null").distinct()
    article = first_by_key(articles.join(targets, "join_key", "left_semi"), columns).select(F.col("join_key").alias("target"), *(F.col(c).alias("a_" + c) for c in columns))
    out = keyed_left_join(wanted.join(direct, "join_key", "left").withColumn("target", join_key("redirect")), article, ["target"])  # few are redirects
    hop = F.col("redirect").isNotNull() & F.col("a_page_id").isNotNull()
    resolved = lambda c: F.when(hop, F.col("a_" + c)).otherwise(F.col(c))
    return out.select(
        "entity_type", "join_key", F.col("page_id").alias("matched_page_id"), F.col("title").alias("matched_title"), F.col("redirect").alias("redirect_title"),
        resolved("page_id").alias("final_page_id"), resolved("title").alias("final_title"), *(resolved(c).alias(c) for c in attributes),
        F.col("page_id").isNotNull().alias("matched"), hop.alias("redirect_resolved"),
    )


def rate(part: Column, whole: Column) -> Column:
    return F.round(100 * part / whole, 2)


def match_stats(links: DataFrame) -> DataFrame:
    out = links.groupBy("entity_type").agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if("redirect_resolved").alias("redirects_resolved"))
    return out.select("entity_type", "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), "redirects_resolved", rate(F.col("matched"), F.col("total")).alias("match_rate"))


def match_totals(links: DataFrame) -> DataFrame:
    return links.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"), F.count_if("redirect_resolved").alias("redirects_resolved"), F.countDistinct(F.when(F.col("matched"), F.col("final_page_id"))).alias("distinct_pages"))


def attribute_stats(links: DataFrame) -> DataFrame:
    """Averages of the matched links' numbers, and how many have an infobox."""
    box = F.col("infobox_type") if "infobox_type" in links.columns else F.lit(None)
    return links.filter("matched").agg(*(F.round(F.avg(c), 4).alias("avg_" + c) for c in NUMBERS if c in links.columns), F.count(box).alias("with_infobox"))


def search_documents(docs: DataFrame, mapping: DataFrame, links: DataFrame) -> DataFrame:
    """The documents with the wiki page of their entity: 11 columns of the document, 15 of the page, null where there is none.

    Bible pages go by the title that mapping (bible_book, wiki_title) has for their book, Nave's pages by the topic
    before a colon, atlas pages by their place; other groups have no entity, and their rows pass by the joins. Columns
    that docs or links lack are null.
    """
    def pick(df: DataFrame, name: str, kind: str | None = None) -> Column:
        column = F.col(name) if name in df.columns else F.lit(None)
        return column.cast(kind) if kind else column

    group = F.col("crawl_group")
    own = docs.select(*(pick(docs, c, None if c == "document_id" and c in docs.columns else k).alias(c) for c, k in DOCUMENT.items()))
    # Texts are not shuffled for these joins as long as the other side can be broadcast.
    titles = small_side(staged(mapping.select(F.col("bible_book").alias("book"), join_key("wiki_title").alias("_book_key")), "book-titles"))
    own = keyed_left_join(own, titles, ["book"])
    own = own.withColumn("_type", F.when(group == "bible", "book").when(group == "naves", "naves_entity").when(group == "atlas", "place"))
    own = own.withColumn("_key", F.when(group == "bible", F.col("_book_key")).when(group == "naves", join_key(F.regexp_extract("topic", "^([^:]+)", 1))).when(group == "atlas", join_key("place")))
    kinds = dict.fromkeys(LISTS, "array<string>") | {"infobox_type": "string"} | dict.fromkeys(NUMBERS, "int")
    page = [F.col("matched").alias("wiki_matched"), F.col("final_page_id").alias("wiki_page_id"), F.col("final_title").alias("wiki_title")]
    wiki = staged(links.select(F.col("entity_type").alias("_type"), F.col("join_key").alias("_key"), *page, *(pick(links, c, kinds[c]).alias("wiki_" + c) for c in ATTRIBUTES)), "linked-pages")
    return keyed_left_join(own, small_side(wiki), ["_type", "_key"]).drop("_type", "_key", "_book_key").select(*DOCUMENT, "wiki_matched", "wiki_page_id", "wiki_title", *("wiki_" + c for c in ATTRIBUTES))


def enrichment_rate(enriched: DataFrame) -> DataFrame:
    out = enriched.groupBy("crawl_group").agg(F.count("*").alias("documents"), F.count("wiki_title").alias("enriched"))
    return out.withColumn("wiki_rate", rate(F.col("enriched"), F.col("documents")))


def enrichment_totals(enriched: DataFrame) -> DataFrame:
    out = enriched.agg(F.count("*").alias("documents"), F.count("wiki_title").alias("enriched"))
    return out.withColumn("without", F.col("documents") - F.col("enriched")).withColumn("wiki_rate", rate(F.col("enriched"), F.col("documents")))
