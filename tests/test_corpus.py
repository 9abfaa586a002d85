import math

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import urls as U
from lectern.operators import bounded, entities, extract, fields, index, links, stats, stored, wiki
from lectern.sources import io

SITE = "site.example"


def one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} string" for n in names))
    return df.select(expr.alias("x")).first()[0]


def test_tokens_drop_a_trailing_apostrophe(spark):
    assert one(spark, T.tokens("t"), t="Moses' rod, don’t 12") == ["moses", "rod", "don’t", "12"]


def test_weights(spark):
    assert one(spark, T.idf(F.lit(100), F.lit(10)), t="") == pytest.approx(math.log(10))
    assert one(spark, T.idf(F.lit(100), F.lit(10), "smooth"), t="") == pytest.approx(math.log(101 / 11) + 1)
    assert one(spark, T.idf(F.lit(2), F.lit(3)), t="") is None


@pytest.mark.parametrize(
    "href, want",
    [
        ("/a//b.htm?x=1#y", "https://site.example/a/b.htm"),
        ("../c.htm", "https://site.example/c.htm"),
        ("d.htm", "https://site.example/x/d.htm"),
        ("HTTP://WWW.Site.example:80", "https://site.example/"),
        ("mailto:a@b", None),
    ],
)
def test_canonical(spark, href, want):
    assert one(spark, U.canonical(F.col("h"), F.lit("https://site.example/x/y.htm"), SITE), h=href) == want


def test_classes_and_audit(spark):
    url = F.col("u")
    kind = lambda u: one(spark, U.classified(url, SITE), u=u)
    assert kind(f"https://{SITE}/1_john/3.htm")["crawl_group"] == "bible"
    assert kind(f"https://{SITE}/topical/naves/a/b.htm")["crawl_group"] == "naves"
    assert kind(f"https://{SITE}/atlas/a.htm")["document_type"] == "atlas_index"
    assert kind("https://other.example/atlas/a.htm") is None
    assert one(spark, U.derived(url, SITE), u=f"https://{SITE}/john/3-16.htm") == f"https://{SITE}/commentaries/john/3-16.htm"
    assert one(spark, U.audited(url, SITE), u=f"https://{SITE}/greek/1.htm")["category"] == "greek"
    assert one(spark, U.audited(url, SITE), u="https://other.example/")["reason"] == "external_domain"


def test_links_and_frontier(spark):
    html = '<a href="/john/3-16.htm">v</a><a href="/john/3.htm">c</a><a href="https://e.example/">e</a><a href="/john/3.htm#x">again</a>'
    rows = links.link_rows(spark.createDataFrame([(1, f"https://{SITE}/john/", html)], "page_id long, url string, html string"), SITE)
    assert {(r.kind, r.url.rsplit("/", 1)[1]) for r in rows.collect()} == {("derived", "3-16.htm"), ("ignored", "3-16.htm"), ("eligible", "3.htm"), ("ignored", "")}
    seen = spark.createDataFrame([(f"https://{SITE}/john/3.htm",)], "url string")
    assert [r.crawl_group for r in links.next_frontier(rows, seen, SITE).collect()] == ["commentary"]
    assert links.ignored_summary(rows).count() == 2


def docs(spark):
    rows = [(1, "alpha beta beta common"), (2, "beta gamma common"), (3, "alpha alpha delta common"), (4, None), (5, "")]
    return spark.createDataFrame(rows, "document_id long, text string")


def test_search(spark):
    i = index.build(docs(spark))
    q = spark.createDataFrame([(0, "the alpha"), (1, "alpha and beta"), (2, "missing and alpha"), (3, "common")], "query_id long, text string")
    hits = {(r.query_id, r.document_id): r for r in index.search(i, q).collect()}
    assert {k for k in hits if k[0] == 0} == {(0, 1), (0, 3)} and hits[0, 3].rank == 1
    assert {k for k in hits if k[0] == 1} == {(1, 1)}
    assert not {k for k in hits if k[0] == 2}
    assert index.explain(i, q, index.search(i, q)).count() == 2 + 2 + 3
    assert index.build(docs(spark).limit(0)).postings.count() == 0


def test_fields(spark):
    d = spark.createDataFrame([(1, "holy spirit", "walks here"), (2, "spirit", "a holy place"), (3, "jerusalem", "x")], "document_id long, title string, text string")
    tok = fields.field_tokens(d, ["title", "text"])
    q = lambda t: spark.createDataFrame([(0, t)], "query_id long, text string")
    assert [r.document_id for r in fields.phrase(tok, q("holy spirit")).collect()] == [1]
    assert {r.document_id for r in fields.boolean(tok, q("holy spirit"), "and").collect()} == {1, 2}
    assert [r.document_id for r in fields.fuzzy(tok, q("jeruslem")).collect()] == [3]
    assert [r.document_id for r in fields.fuzzy(tok, q("sipirt"), 2).collect()] and not fields.fuzzy(tok, q("zzzz")).count()


LONG = "In the text of this place there are many words, enough to pass the least length. " * 3
PAGES = [
    ("/john/3.htm", '<title>J</title><span class="reftext"><b>1</b></span>One<p>x<span class="reftext"><b>2</b></span>' + LONG + "<p>Footnotes:<p>never"),
    ("/commentaries/john/3-16.htm", "<title>c</title><p>EXPOSITORY (ENGLISH BIBLE)</p><p>" + LONG + "</p><p>Links</p><p>never</p>"),
    ("/topical/a/alms.htm", "<title>Topical Bible: Alms</title><p>Topical Encyclopedia</p><p>" + LONG + "</p><p>Subtopics</p><p>never</p>"),
    ("/topical/b/stub.htm", "<title>Stub</title><p>Topical Encyclopedia</p><p>Subtopics</p>"),
    ("/atlas/jericho.htm", "<script>never</script><p>Occurrences</p><p>" + LONG + "</p><p>Encyclopedia</p><p>" + LONG + " b</p><p>Strong's Greek</p><p>never</p>"),
    ("/atlas/empty.htm", None),
    ("/atlas/", "<p>index</p>"),
    ("/elsewhere", "<p>x</p>"),
]


def test_extraction(spark):
    pages = spark.createDataFrame([(f"https://{SITE}{p}", h) for p, h in PAGES], "url string, html string")
    rows = {r.url.removeprefix(f"https://{SITE}"): r for r in extract.extract_documents(pages, SITE).collect()}
    assert rows["/john/3.htm"].valid and [v.verse for v in rows["/john/3.htm"].verses] == [1, 2]
    assert rows["/commentaries/john/3-16.htm"].reference == "John 3:16" and rows["/commentaries/john/3-16.htm"].valid
    assert rows["/topical/a/alms.htm"].topic == "Alms" and rows["/topical/a/alms.htm"].valid
    assert rows["/topical/b/stub.htm"].skip_reason == "navigation_only_topical_page"
    assert set(rows["/atlas/jericho.htm"].sections) == {"occurrences", "encyclopedia"}
    assert rows["/atlas/empty.htm"].validation_errors == ["text_too_short", "missing_atlas_content"]
    assert rows["/atlas/"].skip_reason == "discovery_page" and rows["/elsewhere"].skip_reason == "unsupported_group"
    assert not any("never" in (r.text or "") for r in rows.values())


def test_wiki(spark):
    xml = "<page><title>A_b &amp; c</title><ns>0</ns><id>7</id><revision><id>9</id><text x='y'>'''A''' [[Category:X]] [[Link|label]] {{Infobox place|a}} &lt;ref&gt;r&lt;/ref&gt; == H ==</text></revision></page>"
    other = "<page><title>T</title><ns>1</ns><id>8</id></page>"
    row = wiki.parse(spark.createDataFrame([(xml,), (other,)], "page string")).collect()
    assert len(row) == 1 and row[0].page_id == 7 and row[0].join_key == "a b & c"
    assert row[0].categories == ["X"] and row[0].infobox_type == "Infobox place" and row[0].reference_count == 1
    assert row[0].preview.startswith("A Category:X label")


def test_field_queries_keep_every_word(spark):
    d = spark.createDataFrame([(1, "the end", "x"), (2, "an end", "y")], "document_id long, title string, text string")
    tok = fields.field_tokens(d, ["title", "text"])
    ask = lambda t, mode="or": [r.document_id for r in fields.boolean(tok, spark.createDataFrame([(0, t)], "query_id long, text string"), mode).orderBy("rank").collect()]
    assert ask("the end", "and") == [1] and ask("the") == [1] and ask(" !") == [1, 2]


def test_filters(spark):
    d = spark.createDataFrame([(1, "a", 5), (2, "a", None), (3, "b", 7)], "document_id long, book string, chapter int")
    ids = lambda **k: [r.document_id for r in fields.filtered(d, **k).orderBy("document_id").collect()]
    assert ids(exact={"book": "a"}) == [1, 2] and ids(exact={"book": ""}) == [1, 2, 3]
    assert ids(ranges={"chapter": (5, 5)}) == [1] and ids(ranges={"chapter": (6, None)}) == [3] and ids(ranges={"chapter": (None, None)}) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids(ranges={"chapter": (3, 2)})


def test_readers_and_writers(spark, tmp_path):
    rows = [(1, 'a "b"\tc'), (2, "é")]
    df = spark.createDataFrame(rows, "id int, t string")
    io.write_tsv(df, f"{tmp_path}/t")
    io.write_json(df, f"{tmp_path}/j")
    assert sorted(map(tuple, io.read_tsv(spark, f"{tmp_path}/t", "id int, t string").collect())) == rows
    back = io.read_documents(spark, f"{tmp_path}/j", "id int, t string, none long")
    assert sorted(map(tuple, back.collect())) == [(*r, None) for r in rows]
    (tmp_path / "b" / "x").mkdir(parents=True)
    (tmp_path / "b" / "y").mkdir()
    (tmp_path / "b" / "x" / "p 1.html").write_text("<x>")
    (tmp_path / "b" / "y" / "p 1.html").write_text("<y>")
    spark.createDataFrame([("saved", "x/p 1.html"), ("saved", "y/p 1.html"), ("failed", "x/p 1.html")], "fetch_status string, raw_html_path string").write.json(f"{tmp_path}/m")
    pages = io.read_pages(spark, f"{tmp_path}/m", f"{tmp_path}/b", "fetch_status string, raw_html_path string").collect()
    assert sorted((r.raw_html_path, r.html) for r in pages) == [("x/p 1.html", "<x>"), ("y/p 1.html", "<y>")]


def test_summaries(spark):
    crawled = spark.createDataFrame([("saved", "bible", "chapter"), ("saved", "bible", "chapter"), ("failed", None, None)], "fetch_status string, crawl_group string, document_type string")
    assert {tuple(r) for r in stats.crawl_summary(crawled).collect()} == {("saved", "bible", "chapter", 2), ("failed", None, None, 1)}
    means = fields.overlap_means(spark.createDataFrame([("or", 0.5), ("or", 1.0), ("and", 0.1)], "mode string, overlap_ratio double"))
    assert {tuple(r) for r in means.collect()} == {("or", 2, 0.75), ("and", 1, 0.1)}


def test_names_and_hidden_parts():
    assert extract._book("songs") == "Song of Solomon" and extract._book("1_john") == "1 John" and extract._name("red-sea_%41b") == "Red Sea Ab"
    assert extract.html_lines("a<!-- <script> -->b<script>x<!-- y</script>c", ()) == ["a", "b", "c"]


def test_links_to_other_spaces_are_no_articles():
    page = "<page><title>T</title><ns>0</ns><id>1</id><text>[[A  b]] [[Wikipedia:X]] [[Portal:Y]] [[Help:Z]]</text></page>"
    assert wiki.parse_page(page)["internal_link_count"] == 2


def test_search_documents_and_their_fields(spark):
    docs = spark.createDataFrame([(1, "bible", "Songs", None, 3), (2, "naves", None, "Alms: of", None), (3, "atlas", None, None, None), (4, "torrey", None, "Alms", None)], "document_id long, crawl_group string, book string, topic string, chapter int")
    mapping = spark.createDataFrame([("Songs", "Song_of Songs")], "bible_book string, wiki_title string")
    kept = "entity_type string, join_key string, matched boolean, final_page_id long, final_title string, categories array<string>, text_length int"
    links_ = spark.createDataFrame([("book", "song of songs", True, 7, "Song", ["a", "b c"], 9), ("naves_entity", "alms", False, None, None, None, None)], kept)
    out = entities.search_documents(docs, mapping, links_)
    rows = {r.document_id: r for r in out.collect()}
    assert len(out.columns) == 26 and len(rows) == 4
    assert rows[1].wiki_page_id == 7 and rows[1].wiki_categories == ["a", "b c"] and rows[1].wiki_reference_count is None
    assert rows[2].wiki_matched is False and rows[2].wiki_title is None and rows[3].wiki_matched is None and rows[4].wiki_matched is None
    ready = {r.document_id: r for r in fields.prepared(out.drop("verse")).collect()}
    assert ready[1].wiki_categories == "a b c" and ready[1].chapter == 3 and ready[1].verse is None and ready[2].book is None
    odd = spark.createDataFrame([(1, " ", '["a", "b"]', "x"), (2, " t ", "plain", "12"), (3, None, '"one"', None)], "document_id long, title string, wiki_sections string, chapter string")
    ready = {r.document_id: r for r in fields.prepared(odd).collect()}
    assert [ready[i].title for i in (1, 2, 3)] == [None, "t", None] and [ready[i].chapter for i in (1, 2, 3)] == [None, 12, None]
    assert [ready[i].wiki_sections for i in (1, 2, 3)] == ["a b", "plain", "one"]


def test_index_files_and_catalog(spark, tmp_path):
    d = docs(spark).withColumn("url", F.concat(F.lit("u"), "document_id")).withColumn("title", F.lit("")).withColumn("book", F.lit("b"))
    d = index.first_documents(d, 4)
    i = index.build(d)
    c = index.catalog(d, i.norms)
    stored.write_index(i, c, str(tmp_path))
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    rows = {r.document_id: r for r in read("catalog").collect()}
    assert len(rows) == 4 and rows[1].title == "u1" and rows[1].book == "b" and rows[4].token_count == 0 and rows[4].norm_smooth == 0.0 and rows[1].preview == "alpha beta beta common"
    assert read("vocabulary").count() == 5 and read("postings").count() == 9 and read("stats").first().posting_count == 9
    nested = io.nested_postings(i.postings, F.col("document_id") % 2).filter("term = 'common'").collect()
    assert sorted((r.block, [tuple(p) for p in r.postings]) for r in nested) == [(0, [(2, 1)]), (1, [(1, 1), (3, 1)])]


def test_a_frontier_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "BLOCK", 2)
    rows = [(p, q, f"https://{SITE}/{g}/{p}{q}.htm", "eligible") for p in range(7) for q, g in enumerate(["atlas", "john"])]
    found = spark.createDataFrame(rows, "page_id long, pos int, url string, kind string")
    out = links.next_frontier(found, spark.createDataFrame([], "url string"), SITE).collect()
    assert sorted((r.crawl_group, r.turn) for r in out) == [(g, t) for g in ("atlas", "bible") for t in range(1, 8)]
    assert {r.url.rsplit("/", 1)[1]: r.turn for r in out if r.crawl_group == "atlas"} == {f"{p}0.htm": p + 1 for p in range(7)} and {r.group_order for r in out} == {1, 6}


def test_overlap_by_title_and_of_silent_queries(spark):
    run = lambda rows: spark.createDataFrame(rows, "query_id long, rank int, document_id long, title string")
    a, b = run([(0, 1, 5, "x"), (0, 2, None, " A "), (0, 3, 6, "y")]), run([(0, 1, None, "a"), (0, 2, 5, "z"), (0, 3, 6, "y")])
    out = fields.overlap(a, b, 2, spark.createDataFrame([(0,), (1,)], "query_id long")).collect()
    assert {(r.query_id, r.overlap_count, r.overlap_ratio) for r in out} == {(0, 2, 1.0), (1, 0, 0.0)}


def test_forms_groups_and_totals(spark):
    assert one(spark, T.tokens(T.nfkc("t")), t="ﬁne １") == ["fine", "1"]
    group = lambda u, t: one(spark, U.prefix_group(F.col("u"), F.col("t")), u=f"https://{SITE}{u}", t=t)
    assert [group("/topical/ttt/a.htm", None), group("/topical/a", None), group("/john/3.htm", "x"), group("/else", "bible"), group("/else", "x")] == ["torrey", "topical", "bible", "bible", "x"]
    pages = spark.createDataFrame([(f"https://{SITE}{p}", h) for p, h in PAGES], "url string, html string")
    t = extract.totals(extract.extract_documents(pages, SITE)).first()
    assert (t.source_pages, t.eligible, t.valid, t.invalid, t.skipped, t.skipped_discovery, t.skipped_other, t.success_rate) == (8, 5, 4, 1, 3, 1, 2, 80.0)
    assert extract.totals(extract.extract_documents(pages.limit(0), SITE)).first().success_rate == 0.0


def test_snippets_and_marks(spark):
    text = "x " * 200 + "the Ark, of it " + "y " * 200
    got = one(spark, T.snippet("t", F.array(F.lit("ark"), F.lit("none"))), t=text)
    assert got.startswith("…") and got.endswith("…") and "Ark, of it" in got and len(got) <= 262
    assert one(spark, T.snippet("t", F.array(F.lit("zz"))), t="short  text") == "short text"
    assert one(spark, T.highlight("t", ["ark"]), t="Ark arks ARK.") == "**Ark** arks **ARK**."
    assert one(spark, T.preview_dots("t", 5), t="abcd efgh") == "abcd..." and one(spark, T.preview_dots("t", 9), t="abcd efgh") == "abcd efgh"
