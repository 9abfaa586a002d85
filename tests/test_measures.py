"""Candidate searches against all pairs, text forms, splits, and rounds of a crawl."""

import bz2
import os
import random
import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import entities, extract, fields, links, stats, wiki
from lectern.operators import index as ix
from lectern.sources.shared import staged

SITE = "site.example"


def leven(a, b):
    return swaps(a, b, False)


def swaps(a, b, swap=True):
    """Optimal string alignment by a plain table; without swaps the distance of Levenshtein."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swap and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_fuzzy_candidates_lose_no_near_term(spark, edits):
    rng = random.Random(edits)
    terms = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(500)} | {"a" * 30, "a" * 29 + "b", "jerusalem", "jeruslaem"})
    asked = rng.sample(terms, 25) + ["jeruslem", "a" * 28 + "ba"]
    vocabulary = staged(fields.neighbourhood(spark.createDataFrame([(t,) for t in terms], "term string"), edits), "near")
    ask = spark.createDataFrame([(a,) for a in asked], "base string")
    pairs = {tuple(r) for r in fields.fuzzy_pairs(vocabulary, ask, edits).collect()}
    near = {(a, t) for a in asked for t in terms if swaps(a, t) <= edits}
    assert near <= pairs
    of_fitting_length = sum(abs(len(a) - len(t)) <= edits for a in asked for t in terms)
    assert len(pairs) < of_fitting_length / (4 if edits == 1 else 1.5)  # the alphabet of four letters is a hard case
    tokens = spark.createDataFrame([(1, "text", i, t) for i, t in enumerate(terms)], "document_id int, field string, pos int, term string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    built, read = (sorted(map(tuple, fields.fuzzy_terms(tokens, queries, edits, i).collect())) for i in (None, vocabulary))
    assert built == read
    less = {(a, t) for a, t in near if min(len(a), len(t)) > min(edits, leven(a, t))}  # others have no weight
    counts = {a: sum(x == a for x, _ in less) for a in asked}
    got = {(r[1], r[2]) for r in built}
    assert got <= less and {p for p in less if counts[p[0]] <= fields.MAX_EXPANSIONS} <= got


def test_phrases_against_a_scan(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdef", [9, 5, 3, 2, 1, 1], k=rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, t[:5]) for i, t in enumerate(texts)], "document_id long, text string, title string")
    asked = ["a", "a a", "a b", "b a a", "f a b a", "a a a a", "zz a", "a zz", "", "e e", texts[3], texts[5][:9]]
    got = sorted(map(tuple, fields.phrase(staged(fields.field_tokens(docs, ["title", "text"]), "tokens"), spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")).collect()))
    want = []
    for q, a in enumerate(asked):
        words = a.split()
        for i, t in enumerate(texts):
            for field, value in (("text", t.split()), ("title", t[:5].split())):
                n = sum(value[s : s + len(words)] == words for s in range(len(value) - len(words) + 1)) if words else 0
                want += [(q, i, field, n)] * (n > 0)
    assert got == sorted(want)


@pytest.mark.parametrize("mode", ["or", "and"])
def test_field_search_by_bounds(spark, mode):
    rng = random.Random(9)
    words, weights = [f"w{i}" for i in range(80)], [1 / (i + 1) for i in range(80)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40))), " ".join(rng.choices(words, k=2))) for i in range(300)], "document_id long, text string, title string")
    tokens = staged(fields.field_tokens(docs, ["title", "text"]), "tokens")
    queries = spark.createDataFrame([(q, " ".join(rng.choices(words, k=n))) for q, n in enumerate([1, 2, 2, 3, 5, 8])] + [(9, "w0 w79 w0")], "query_id long, text string")
    search = fields.boolean_top(fields.field_impacts(tokens), ["title", "text"], queries, mode)
    assert sorted(map(tuple, search.hits.collect())) == sorted(map(tuple, fields.boolean(tokens, queries, mode).collect()))
    assert search.work()["essential"] < search.work()["postings"]


def test_settled_characters_need_no_normal_form(spark):
    import re

    settled = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", T.SETTLED) + "]")
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF and settled.match(chr(i))]
    form = lambda s: unicodedata.normalize("NFKC", s)
    assert len(chars) > 30_000 and all(form(c) == c and not unicodedata.combining(c) for c in chars)
    # None of them joins what stands before it, so that texts of them alone are their own form.
    assert all(form(a + b) == a + b for b in chars for a in ("a", "e", "か", "א", "α"))


def test_other_forms_are_found(spark):
    docs = spark.createDataFrame([(1, "ﬁne １２ ｗｏｒｄ"), (2, "fine 12 word"), (3, "été plain"), (4, "e\u0301te\u0301"), (5, None)], "document_id long, text string")
    rows = {(r.document_id, r.term) for r in ix.postings(docs).collect()}
    assert rows == {(d, t) for d in (1, 2) for t in ("fine", "12", "word")} | {(3, "été"), (3, "plain"), (4, "été")}
    found = ix.search(ix.build(docs), spark.createDataFrame([(0, "ＷＯＲＤ"), (1, "ete\u0301")], "query_id long, text string"))
    assert {(r.query_id, r.document_id) for r in found.collect()} == {(0, 1), (0, 2)}
    tokens = fields.field_tokens(docs, ["text"])
    assert {r.document_id for r in tokens.filter("term = 'fine'").collect()} == {1, 2}
    # Only texts with other forms reach Python.
    sent = docs.filter(F.col("text").rlike(f"[^{T.SETTLED}]"))
    assert {r.document_id for r in sent.collect()} == {1, 4}


def test_snippets_end_words_at_underscores(spark):
    cut = lambda text, *terms, width=20: spark.createDataFrame([(text, list(terms))], "t string, w array<string>").select(T.snippet("t", F.col("w"), width)).first()[0]
    text = "x_ark and more words, then the ARK stands  here at last"
    assert cut(text, "ark") == "…n the ARK stands her…" == "…" + " ".join(text.split())[31 - 6 : 31 + 14] + "…"
    assert cut(text, "none") == "x_ark and more words…" and cut("", "a") == "" and cut(" a\u00a0 b ", "b") == "a b"
    assert cut("a (b.c) d", "b.c") == "a (b.c) d"


def test_split_writer_parses_once(spark, tmp_path, monkeypatch):
    page = f"https://{SITE}/atlas/jericho.htm"
    rows = [(page, "<p>Occurrences</p><p>" + "words of some length " * 20 + "</p>"), (f"https://{SITE}/atlas/empty.htm", None), (f"https://{SITE}/atlas/", "x"), (f"https://{SITE}/elsewhere", "x")]
    seen = spark.sparkContext.accumulator(0)
    one = extract._one

    def counted(*a):
        seen.add(1)
        return one(*a)

    monkeypatch.setattr(extract, "_one", counted)
    made = extract.extract_documents(spark.createDataFrame(rows, "url string, html string"), SITE)
    documents, invalid, totals = extract.write_split(made, str(tmp_path))
    by = {tuple(r) for r in extract.summary(documents).collect()}
    assert seen.value == 2 and {r.url for r in documents.filter("valid").collect()} == {page} and invalid.count() == 1
    monkeypatch.undo()
    assert totals.collect() == extract.totals(made).collect() and by == {tuple(r) for r in extract.summary(made).collect()}
    assert spark.read.json(f"{tmp_path}/summary").first().source_pages == 4 and sorted(os.listdir(tmp_path / "documents"))[-3:] == ["outcome=invalid", "outcome=skipped", "outcome=valid"]
    assert ("error", "missing_atlas_content", 1, 0) in by


def test_a_dump_of_many_blocks(spark, tmp_path):
    rng = random.Random(1)
    pages = [f"<page>\n<title>T{i}</title><ns>0</ns><id>{i}</id><revision><id>{i + 1}</id><text>{''.join(rng.choices('abcdefghij klmnop</>', k=rng.choice([200, 3000, 40_000])))}</text></revision>\n</page>" for i in range(260)]
    raw = ("<mediawiki><siteinfo>x</siteinfo>\n" + "\n".join(pages) + "\n</mediawiki>\n").encode()
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(raw, 1))  # blocks of 100,000 bytes
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")if spark.conf.get(k, None)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(200_000))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        dump = wiki.read_dump(spark, str(tmp_path))
        assert len(raw) > 2_000_000 and dump.rdd.getNumPartitions() > 4
        assert sorted(r.page for r in dump.collect()) == sorted(pages)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_rounds_of_a_crawl(spark):
    table = f"seen_{os.getpid()}"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    links.remember(spark.createDataFrame([(f"https://{SITE}/",)], "url string"), table, 4)
    url = lambda n: f"https://{SITE}/atlas/{n}.htm"
    rounds = [[1, 2, 2, 3], [2, 3, 4], [1, 4, 5, 6, 5]]
    got = []
    for r in rounds:
        rows = spark.createDataFrame([(10 + i, 0, url(n), "eligible") for i, n in enumerate(r)] + [(99, 0, "https://else/", "ignored")], "page_id long, pos int, url string, kind string")
        got.append([x.url for x in links.crawl_round(rows, table, SITE, 4).orderBy("turn").collect()])
    assert got == [[url(1), url(2), url(3)], [url(4)], [url(5), url(6)]]
    assert spark.table(table).count() == 7
    plan = links.unseen(spark.createDataFrame([("u",)], "url string"), table, 4)
    plan.count()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in text
    spark.sql(f"DROP TABLE {table}")


def test_tokenizers_and_samples(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    docs = spark.createDataFrame([("hello world",), ("",), (None,)], "text string")
    assert stats.token_stats(docs).first().tokens == 2
    if os.path.exists(path):
        from tokenizers import Tokenizer

        got = stats.token_stats(docs, T.bpe_count(path)).first()
        assert got.tokens == len(Tokenizer.from_file(path).encode("hello world", add_special_tokens=False).ids) and got.documents == 3 and got.min_tokens == 0
    kept = spark.createDataFrame([("place", "b", True, 1), ("place", "a", True, 0), ("book", "c", True, 2), ("book", "d", False, None)], "entity_type string, join_key string, matched boolean, section_count int")
    sample = lambda **k: [r.join_key for r in entities.link_samples(kept, **k).collect()]
    assert sample(matched=True) == ["c", "a", "b"] and sample(matched=True, with_sections=True) == ["c", "b"] and sample(matched=False) == ["d"]
