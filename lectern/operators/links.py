"""Links of crawled pages, the next frontier, and what was left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..sources.shared import staged

#: Pages of one task when a frontier is numbered; it changes the work, not the order.
BLOCK = 100_000
HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def link_rows(pages: DataFrame, site: str) -> DataFrame:
    """page_id, pos, url, kind (eligible, derived, ignored), reason, category of pages (page_id, url, html), once by page and URL."""
    hrefs = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))
    seen = hrefs.withColumn("url", U.canonical(F.col("href"), F.col("base"), site)).filter("url is not null")
    seen = seen.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    url = F.col("url")
    seen = seen.withColumn("ok", U.classified(url, site).isNotNull()).withColumn("made", U.derived(url, site)).withColumn("left", U.audited(url, site))
    row = lambda u, k, r, c: F.struct(u.alias("url"), F.lit(k).alias("kind"), r.alias("reason"), c.alias("category"))
    none = F.lit(None).cast("string")
    rows = F.array_compact(F.array(F.when(F.col("ok"), row(url, "eligible", none, none)), F.when(~F.col("ok") & F.col("made").isNotNull(), row(F.col("made"), "derived", none, none)), F.when(F.col("left").isNotNull(), row(url, "ignored", F.col("left.reason"), F.col("left.category")))))
    return seen.select("page_id", "pos", F.explode(rows).alias("r")).select("page_id", "pos", "r.*")


def remember(urls: DataFrame, table: str, buckets: int = 64) -> None:
    """Append urls (url) to the bucketed table of seen ones, which is made at first; its buckets are never dealt anew."""
    urls.select("url").repartition(buckets, "url").write.bucketBy(buckets, "url").mode("append").format("parquet").saveAsTable(table)


def unseen(urls: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Rows of urls (url and others) that the table of `remember` lacks: only these rows are dealt to the table's buckets."""
    return urls.repartition(buckets, "url").join(urls.sparkSession.table(table).hint("merge"), "url", "left_anti")


def crawl_round(links: DataFrame, table: str, site: str, buckets: int = 64) -> DataFrame:
    """The frontier of a round: its URLs by turn, which are remembered, so that no later round has them again.

    links: of the pages that the round before has fetched. The table must hold the seed addresses.
    """
    found = links.filter("kind <> 'ignored'").groupBy("url").agg(F.min(F.struct("page_id", "pos")).alias("first"))
    new = staged(_in_turn(unseen(found, table, buckets), site), "frontier")
    remember(new, table, buckets)
    return new


def next_frontier(links: DataFrame, seen: DataFrame, site: str) -> DataFrame:
    """New URLs with their turn in the round robin over groups: url, crawl_group, group_order, turn; by turn and group_order.

    A group's URLs come in the order in which they were first seen. They are numbered within blocks of BLOCK pages and
    then moved on by what the blocks before hold, so that no task sorts a whole group.
    """
    return _in_turn(links.filter("kind <> 'ignored'").groupBy("url").agg(F.min(F.struct("page_id", "pos")).alias("first")).join(seen.select("url"), "url", "left_anti"), site)


def _in_turn(new: DataFrame, site: str) -> DataFrame:
    """next_frontier's columns for new URLs (url, first)."""
    new = new.withColumn("crawl_group", U.classified(F.col("url"), site)["crawl_group"])
    new = new.withColumn("block", F.floor(F.col("first.page_id") / BLOCK))
    held = new.groupBy("crawl_group", "block").agg(F.count("*").alias("n"))
    before = held.select("crawl_group", "block", (F.sum("n").over(Window.partitionBy("crawl_group").orderBy("block")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("crawl_group", "block").orderBy("first", "url"))
    out = new.withColumn("place", place).join(before, ["crawl_group", "block"])
    order = F.array_position(F.array(*(F.lit(g[0]) for g in U.GROUPS)), F.col("crawl_group"))
    return out.select("url", "crawl_group", order.cast("int").alias("group_order"), (F.col("before") + F.col("place")).cast("long").alias("turn"))


def own_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url, internal of each link of pages (page_id, url, html) of any host; internal: of the page's own host."""
    hrefs = pages.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("pos", "href"))
    out = hrefs.withColumn("url", U.canonical(F.col("href"), F.col("base"))).filter("url is not null")
    return out.select("page_id", "pos", "url", (U.host_of(F.col("url")) == U.host_of(U.canonical(F.col("base"), F.col("base")))).alias("internal"))


def most_linked(found: DataFrame) -> DataFrame:
    """url, links, pages of own_links; a page's links to one address are counted before pages are."""
    by_page = found.groupBy("url", "page_id").agg(F.count("*").alias("n"))
    return by_page.groupBy("url").agg(F.sum("n").alias("links"), F.count("*").alias("pages"))


def page_totals(links: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, links_total, eligible, derived, ignored of every page; links_total counts each link with an address."""
    count = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    found = links.groupBy("page_id").agg((F.countDistinct(F.when(F.col("kind") != "ignored", F.col("url")))).alias("eligible"), count("derived"), count("ignored"))
    total = F.coalesce(F.size(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))), F.lit(0))
    out = pages.select("page_id", total.alias("links_total")).join(found, "page_id", "left")
    return out.select("page_id", "links_total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("eligible", "derived", "ignored")))


def ignored_totals(links: DataFrame) -> DataFrame:
    """dimension (total, category, reason), value, urls: left-out URLs in all, by category and by reason."""
    found = ignored_summary(links)
    e = F.explode(F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value")), *(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("category", "reason"))))
    return found.select("urls", e.alias("e")).groupBy("e.dimension", "e.value").agg(F.sum("urls").alias("urls"))


def ignored_summary(links: DataFrame) -> DataFrame:
    """category, reason, urls: each left-out URL counts once, as first seen."""
    first = links.filter("kind = 'ignored'").groupBy("url").agg(F.min_by(F.struct("category", "reason"), F.struct("page_id", "pos")).alias("x"))
    return first.groupBy("x.category", "x.reason").agg(F.count("*").alias("urls"))
