"""Searches that keep a document's postings in one task, and odd documents and pages against SQL."""

import random
import re

import pytest

from lectern.operators import extract, fields, index, stored
from lectern.plans import registry

WORDS = [f"w{i}" for i in range(60)]
BY_PAIR = r"Exchange hashpartitioning\(query_id[^)]*document_id"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=200):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 30))), rng.choice(WORDS)) for i in range(n)]
    return spark.createDataFrame([*rows, (3, "w1 w1 w59", "w2")], "document_id long, text string, title string")  # one id twice


def asked(spark):
    return spark.createDataFrame([(0, "w1 w2 w40"), (1, "w3 and w50"), (2, "w1 and w2"), (3, "w59 nowhere")], "query_id long, text string")


def test_overlap_sums_up_fields_without_a_shuffle_of_pairs(spark):
    docs = corpus(spark)
    for mode in ("or", "and"):
        tokens = fields.field_tokens(docs, ["title", "text"])
        assert not re.search(BY_PAIR, plan(fields.boolean(tokens, asked(spark), mode)))


def test_search_sums_up_without_a_shuffle_of_pairs(spark):
    found = index.search(index.build(corpus(spark)), asked(spark))
    assert not re.search(r"hashpartitioning\(query_id[^)]*n_terms", plan(found)) and found.filter("query_id = 2").select("matched_terms").distinct().collect() == [("w1 w2",)]
    assert found.filter("query_id = 2").first().total_hits == found.filter("query_id = 2").count() or found.filter("query_id = 2").count() == 10


def test_ids_of_several_rows_are_one_document(spark):
    i = index.build(corpus(spark))
    tf = {(r.document_id, r.term): r.tf for r in i.postings.collect()}
    assert len(tf) == i.postings.count() and tf[(3, "w1")] >= 2 and i.norms.count() == 200


def test_explained_hits_read_postings_of_their_documents(spark):
    i = index.build(corpus(spark))
    p = plan(index.explain(i, asked(spark), index.search(i, asked(spark))))
    assert "LeftSemi" in p and re.search(r"BroadcastHashJoin \[document_id", p)


def test_snippets_do_not_shuffle_texts(spark, tmp_path):
    tables(spark, tmp_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sizes of tiny tables do not decide
    try:
        out = registry.hit_snippets(spark, str(tmp_path))
        assert "BroadcastHashJoin [document_id" in plan(out) and "SortMergeJoin [document_id" not in plan(out) and out.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_known_queries_score_their_terms_alone(spark):
    tokens = fields.field_tokens(corpus(spark), ["title", "text"])
    queries = spark.createDataFrame([(0, "w1 w50")], "query_id long, text string")
    few = fields.field_impacts(tokens, queries)
    assert {r.key.split(":")[1] for r in few.postings.select("key").distinct().collect()} == {"w1", "w50"}
    for mode in ("or", "and"):
        got, want = (sorted(map(tuple, fields.boolean_top(t, ["title", "text"], queries, mode).hits.collect())) for t in (few, fields.field_impacts(tokens)))
        assert got == want and got


def tables(spark, path):
    """Odd documents beside others, and benchmark items of their words."""
    texts = ["", " -- \n!", None, "one", "One two three\nfour five six seven eight", "Ab cd", "ab", "a b c d"] * 12
    rows = [(i, t, ["en", "de"][i % 2], f"s{i % 6}" * (1 + i % 3), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, "two four"), (1, "ab")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_documents_without_words_have_no_place(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    tables(spark, tmp_path)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = registry.enriched_documents(spark, str(tmp_path)).toArrow(), con.sql(registry.SQL["enriched_documents"]).to_arrow_table()
    names = sorted(want.column_names)
    rows = lambda t: sorted(tuple(map(str, r)) for r in zip(*(t.column(n).to_pylist() for n in names), strict=True))
    assert rows(got) == rows(want)
    assert any(r["place"] is None and r["text"] == "" for r in got.to_pylist())


def test_documents_are_tokenized_once_for_enrichment(spark, tmp_path):
    tables(spark, tmp_path)
    assert "regexp_extract_all" not in plan(registry._enriched(spark, str(tmp_path)))


def test_cut_references_stay_in_lines(spark):
    pages = spark.createDataFrame([(1, "<p>a &amp; b &copy;&#65; &amp</p><p>x&ampy; &nosuch; &am</p>")], "page_id long, html string")
    assert [r.line for r in extract.page_lines(pages).orderBy("pos").collect()] == ["a & b ©A &amp", "x&ampy; &nosuch; &am"]


def test_a_written_index_holds_counts_alone(spark, tmp_path):
    i = index.build(corpus(spark))
    stored.write_index(i, i.norms.select("document_id"), str(tmp_path), 3)
    read = stored.read_index(spark, str(tmp_path))
    assert read.postings.columns == ["term", "document_id", "tf", "part"]
    for method in ("classic", "smooth"):
        hits = stored.top_k(read, asked(spark), method).hits
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, index.best(i, asked(spark), method).collect()))
        # Postings of the asked terms are not shuffled by term and document to be scored whole.
        assert not re.search(r"hashpartitioning\(key[^)]*document_id", plan(hits))
