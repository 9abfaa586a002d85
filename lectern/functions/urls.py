"""Column functions on URLs: canonical form, groups and audit of links outside the crawl. The site's host is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The slugs of books, as they stand in paths.
BOOKS = [
    "genesis",
    "exodus",
    "leviticus",
    "numbers",
    "deuteronomy",
    "joshua",
    "judges",
    "ruth",
    "1_samuel",
    "2_samuel",
    "1_kings",
    "2_kings",
    "1_chronicles",
    "2_chronicles",
    "ezra",
    "nehemiah",
    "esther",
    "job",
    "psalms",
    "proverbs",
    "ecclesiastes",
    "songs",
    "isaiah",
    "jeremiah",
    "lamentations",
    "ezekiel",
    "daniel",
    "hosea",
    "joel",
    "amos",
    "obadiah",
    "jonah",
    "micah",
    "nahum",
    "habakkuk",
    "zephaniah",
    "haggai",
    "zechariah",
    "malachi",
    "matthew",
    "mark",
    "luke",
    "john",
    "acts",
    "romans",
    "1_corinthians",
    "2_corinthians",
    "galatians",
    "ephesians",
    "philippians",
    "colossians",
    "1_thessalonians",
    "2_thessalonians",
    "1_timothy",
    "2_timothy",
    "titus",
    "philemon",
    "hebrews",
    "james",
    "1_peter",
    "2_peter",
    "1_john",
    "2_john",
    "3_john",
    "jude",
    "revelation",
]
BOOK = "|".join(sorted(BOOKS, key=len, reverse=True))
VERSE = rf"^/({BOOK})/(\d+)-(\d+)\.htm$"

# Groups in their order, with the document type, then patterns of index pages and of content pages.
GROUPS = [
    ("bible", "bible", [rf"^/(?:{BOOK})/$", rf"^/(?:{BOOK})/index\.htm$"], [rf"^/(?:{BOOK})/\d+\.htm$"]),
    ("commentary", "commentary", [r"^/commentaries/$", r"^/commentaries/index\.html?$"], [rf"^/commentaries/(?:{BOOK})/\d+(?:-\d+)?\.htm$"]),
    ("naves", "topical", [r"^/topical/naves\.htm$"], [r"^/topical/naves/[^/]+/[^/]+\.htm$"]),
    ("torrey", "topical", [r"^/topical/ttt\.htm$"], [r"^/topical/ttt/[^/]+/[^/]+\.htm$"]),
    ("topical", "topical", [r"^/topical/$", r"^/topical/index\.html?$", r"^/topical/[a-z]\.htm$"], [r"^/topical/[^/]+/[^/]+\.htm$"]),
    ("atlas", "atlas", [r"^/atlas/$", r"^/atlas/index\.html?$", r"^/atlas/[a-z]\.htm$"], [r"^/atlas/[^/]+\.htm$"]),
]
# What is left out, in order: category, reason, pattern of the path.
IGNORED = [
    ("bible_verse", "derived_resource", VERSE),
    ("commentary_collection", "unsupported_collection", rf"^/commentaries/[^/]+/(?:{BOOK})/\d+(?:-\d+)?\.htm$"),
    ("commentary_collection_index", "unsupported_collection", rf"^/commentaries/[^/]+/(?:{BOOK})/$"),
    ("commentary_other", "unsupported_internal_url", r"^/commentaries(?:/|$)"),
    ("atlas_collection", "unsupported_collection", r"^/atlas/[^/.]+/$"),
    ("atlas_full_duplicate", "duplicate_representation", r"^/atlas/full/[^/]+\.htm$"),
    ("atlas_biblemapper", "unsupported_collection", r"^/atlas/biblemapper(?:/|$)"),
    ("atlas_other", "unsupported_internal_url", r"^/atlas(?:/|$)"),
    ("topical_other", "unsupported_internal_url", r"^/topical(?:/|$)"),
    ("greek", "unsupported_internal_section", r"^/greek(?:/|$)"),
    ("hebrew", "unsupported_internal_section", r"^/hebrew(?:/|$)"),
    ("interlinear", "unsupported_internal_section", r"^/interlinear(?:/|$)"),
    ("parallel", "unsupported_internal_section", r"^/parallel(?:/|$)"),
    ("sermons", "unsupported_internal_section", r"^/sermons(?:/|$)"),
    ("questions", "unsupported_internal_section", r"^/(?:questions|q)(?:/|$)"),
    ("library", "unsupported_internal_section", r"^/library(?:/|$)"),
    ("concordance", "unsupported_internal_section", r"^/concordance(?:/|$)"),
    ("dictionary", "unsupported_internal_section", r"^/(?:dictionary|dictionaries)(?:/|$)"),
    ("search", "unsupported_internal_section", r"^/search"),
    ("translation_bsb", "unsupported_translation", r"^/bsb(?:/|$)"),
    ("translation_niv", "unsupported_translation", r"^/niv(?:/|$)"),
    ("translation_kjv", "unsupported_translation", r"^/kjv(?:/|$)"),
    ("translation_esv", "unsupported_translation", r"^/esv(?:/|$)"),
    ("translation_nlt", "unsupported_translation", r"^/nlt(?:/|$)"),
    ("translation_nasb", "unsupported_translation", r"^/nasb(?:/|$)"),
    ("translation_other", "unsupported_translation", r"^/(?:bab|bib|blb|cg|msb|texts)(?:/|$)"),
    ("bible_context", "unsupported_internal_section", r"^/context(?:/|$)"),
    ("bible_book_other", "unsupported_internal_url", rf"^/(?:{BOOK})(?:/|$)"),
]


def absolute(href: Column, base: Column) -> Column:
    """href seen from the page `base`; dot segments are resolved by `without_dots`."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*)?)/[^/]*$", "$1")
    folder = F.when(folder.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:/?$"), root).otherwise(folder)
    href = F.trim(href)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when((href == "") | href.startswith("#") | href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def without_dots(path: Column) -> Column:
    """Path with `.` and `..` segments resolved."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    none = F.expr("cast(array() as array<string>)")
    kept = F.aggregate(parts, none, lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    tail = F.when(path.rlike(r"/\.{1,2}$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(path)


def canonical(href: Column, base: Column, site: str | None = None) -> Column:
    """https URL with lower-case host, the site's www. alias folded, single slashes, no query, fragment or port; null for other schemes."""
    full = absolute(href, base)
    host = F.lower(F.regexp_extract(full, r"^(?i:https?)://(?:[^/?#]*@)?([^/?#:]+)", 1))
    host = F.when(host == f"www.{site}", F.lit(site)).otherwise(host) if site else host
    path = F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(without_dots(F.when(path == "", "/").otherwise(path)), "/{2,}", "/")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^https://([^/]+)", 1)


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https://[^/]+(.*)$", 1))


def classified(url: Column, site: str) -> Column:
    """struct<crawl_group, document_type, is_discovery> of the first group that fits a canonical URL of the site, else null."""
    path, out = path_of(url), F.lit(None)
    kind = lambda g, t, d: F.struct(F.lit(g).alias("crawl_group"), F.lit(t).alias("document_type"), F.lit(d).alias("is_discovery"))
    for group, doc_type, index, content in reversed(GROUPS):
        out = F.when(path.rlike("|".join(index)), kind(group, doc_type + "_index", True)).when(path.rlike("|".join(content)), kind(group, doc_type, False)).otherwise(out)
    return F.when(host_of(url) == site, out)


def prefix_group(url: Column, document_type: Column) -> Column:
    """The group that the start of a path names; else bible for chapters and Bible documents, else the document type."""
    path = path_of(url)
    starts = {"/topical/naves/": "naves", "/topical/ttt/": "torrey", "/topical/": "topical", "/commentaries/": "commentary", "/atlas/": "atlas"}  # fixed values, in order
    out = F.when((document_type == "bible") | path.rlike(r"^/[^/]+/\d+\.htm$"), "bible").otherwise(document_type)
    for start, group in reversed(starts.items()):
        out = F.when(path.startswith(start), group).otherwise(out)
    return out


def derived(url: Column, site: str) -> Column:
    """The commentary page of a verse page, else null."""
    m = lambda i: F.regexp_extract(path_of(url), VERSE, i)
    return F.when((host_of(url) == site) & path_of(url).rlike(VERSE), F.concat(F.lit(f"https://{site}/commentaries/"), m(1), F.lit("/"), m(2), F.lit("-"), m(3), F.lit(".htm")))


def audited(url: Column, site: str) -> Column:
    """struct<reason, category> of a canonical URL outside the crawl, else null."""
    path = path_of(url)
    pair = lambda r, c: F.struct(F.lit(r).alias("reason") if isinstance(r, str) else r.alias("reason"), (F.lit(c) if isinstance(c, str) else c).alias("category"))
    first = F.regexp_extract(path, "([^/]+)", 1)
    out = pair("unsupported_internal_url", F.concat(F.lit("other:"), F.when(first == "", "root").otherwise(first)))
    for category, reason, pattern in reversed(IGNORED):
        out = F.when(path.rlike(pattern), pair(reason, category)).otherwise(out)
    out = F.when(classified(url, site).isNull(), out)
    return F.when(url.isNull(), None).when(host_of(url) != site, pair("external_domain", host_of(url))).otherwise(out)
