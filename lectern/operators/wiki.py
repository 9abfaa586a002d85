"""Wiki dump pages: reading, parsing and profile."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "page_id long, title string, join_key string, namespace int, redirect string, categories array<string>, sections array<string>, templates array<string>, infobox_type string, "
    "bold_terms array<string>, category_count int, section_count int, template_count int, internal_link_count int, external_link_count int, reference_count int, text_length int, preview string"
)
#: Prefixes of links that are no articles (fixed values).
NOT_ARTICLES = ("category:", "file:", "image:", "template:", "help:", "wikipedia:")
BOLD = 20


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """page: one record for each page of an XML dump, plain or bz2."""
    pages = spark.read.option("lineSep", "</page>").text(path)
    return pages.filter(F.instr("value", "<page>") > 0).select(F.concat(F.expr("substring(value, instr(value, '<page>'))"), F.lit("</page>")).alias("page"))


def _distinct(values, cap: int | None = None) -> list[str]:
    seen: dict[str, str] = {}
    for v in values:
        key = " ".join(v.replace("_", " ").split()).lower()
        if key:
            seen.setdefault(key, v.strip())
    return list(seen.values())[:cap]


def parse_page(page: str) -> dict | None:
    """Fields of a page in the main namespace; None if it lacks title, namespace or id."""
    from html import unescape

    find = lambda p: re.search(p, page, re.I | re.S)
    title, space, number = find(r"<title>(.*?)</title>"), find(r"<ns>(\d+)</ns>"), find(r"<page>.*?<id>(\d+)</id>")
    if not (title and space and number) or int(space[1]) != 0:
        return None
    body = find(r"<text\b[^>]*>(.*?)</text>")
    text = unescape(body[1]) if body else ""
    every = lambda p, flags=0: [unescape(x) for x in re.findall(p, text, flags)]
    links = [x for x in every(r"\[\[\s*([^|\]#]+)(?:#[^|\]]*)?(?:\|[^\]]*)?\]\]") if not x.strip().lower().startswith(NOT_ARTICLES)]
    name, redirect, box = unescape(title[1]).strip(), find(r'<redirect\s+title="([^"]+)"\s*/>'), re.search(r"(?i)\{\{\s*(Infobox[^|{}\n]*)", text)
    lists = {
        "categories": _distinct(every(r"(?i)\[\[\s*Category\s*:\s*([^|\]]+)")),
        "sections": _distinct(every(r"(?m)^={2,6}\s*(.*?)\s*={2,6}\s*$")),
        "templates": _distinct(every(r"\{\{\s*([^|{}\n]+)")),
        "bold_terms": _distinct(every(r"'''([^']+?)'''"), BOLD),
    }
    refs = re.findall(r"(?is)<ref\b[^>]*>.*?</ref\s*>|<ref\b[^>]*/\s*>", text)
    return lists | {
        "page_id": int(number[1]), "title": name, "join_key": " ".join(name.replace("_", " ").split()).lower(), "namespace": 0, "redirect": unescape(redirect[1]).strip() if redirect else None,
        "infobox_type": box[1].strip() if box else None, "category_count": len(lists["categories"]), "section_count": len(lists["sections"]), "template_count": len(lists["templates"]),
        "internal_link_count": len(_distinct(links)), "external_link_count": len(dict.fromkeys(every(r"(?i)\[(https?://[^\s\]]+)"))), "reference_count": len(refs), "text_length": len(text), "preview": text,
    }


def parse(pages: DataFrame) -> DataFrame:
    """Parsed pages of the main namespace of pages (page); the preview is cleaned by built-in functions."""
    from ..functions.text import clean_wikitext

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = [x for x in map(parse_page, frame["page"]) if x]
            yield pd.DataFrame([{n: r[n] for n in names} for r in rows], columns=names, dtype=object)

    return pages.mapInPandas(run, SCHEMA).withColumn("preview", F.substring(clean_wikitext("preview"), 1, 500))


def profile(pages: DataFrame, columns: list[str]) -> DataFrame:
    """pages, articles, redirects, and averages over articles, in one aggregate."""
    article = F.col("redirect").isNull()
    return pages.agg(F.count("*").alias("pages"), F.count_if(article).alias("articles"), F.count_if(~article).alias("redirects"), *(F.round(F.avg(F.when(article, F.col(c))), 4).alias("avg_" + c) for c in columns))


def top_articles(pages: DataFrame, by: str, k: int = 10) -> DataFrame:
    return pages.filter("redirect is null").orderBy(F.col(by).desc(), "page_id").limit(k).select("page_id", "title", by)


def first_articles(pages: DataFrame, k: int = 20, with_sections: bool = False) -> DataFrame:
    """The k articles of the lowest page_id, or those of them that have sections."""
    out = pages.filter("redirect is null")
    return (out.filter("section_count > 0") if with_sections else out).orderBy("page_id").limit(k)
