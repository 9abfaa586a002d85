"""A written index: pruned reads, searches by bounds, and joins that stay even."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import index, stored
from lectern.sources.shared import keyed_left_join, split_join, staged

WORDS = [f"w{i}" for i in range(400)]


def corpus(spark, n=400, ids=int):
    rng = random.Random(2)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(ids(i), " ".join(["every", *rng.choices(WORDS, weights, k=rng.randint(1, 60))])) for i in range(n)]
    kind = "long" if ids is int else "string"
    return spark.createDataFrame([*rows, (ids(n), None), (ids(n + 1), rows[3][1]), (ids(n + 2), rows[3][1])], f"document_id {kind}, text string")


def written(spark, docs, path, parts=7):
    i = index.build(docs)
    stored.write_index(i, docs.select("document_id"), path, parts)
    return i, stored.read_index(spark, path)


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    return written(spark, corpus(spark), str(tmp_path_factory.mktemp("index")))


def asked(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 9))) for _ in range(12)] + ["w0 and w1", "w300 and w0 and every", "w1 and missing", "every", "the of", "", None, "w2 w2 w2 w350 every"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def hits(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "document_id", "score").collect())


@pytest.mark.parametrize("method", ["classic", "smooth"])
def test_a_read_index_finds_the_same(spark, both, method):
    built, read = both
    want = index.search(built, asked(spark), method)
    assert sorted(map(tuple, index.search(read, asked(spark), method).collect())) == sorted(map(tuple, want.collect()))
    assert hits(stored.top_k(read, asked(spark), method).hits) == hits(want)
    assert sorted(map(tuple, index.explain(read, asked(spark), want).collect())) == sorted(map(tuple, index.explain(built, asked(spark), want).collect()))


def test_text_ids_and_more_words_than_literals(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored, "LITERALS", 3)
    built, read = written(spark, corpus(spark, 60, lambda i: f"d{i:03d}"), str(tmp_path))
    want = hits(index.search(built, asked(spark)))
    assert hits(index.search(read, asked(spark))) == want and hits(stored.top_k(read, asked(spark)).hits) == want
    assert read.places(asked(spark).select(F.explode(F.split("text", " ")).alias("term")))[0] is None


def test_only_parts_and_pages_of_the_words_are_read(spark, both):
    read = both[1]
    terms = spark.createDataFrame([("w17",), ("w399",), ("nowhere",)], "term string")
    words, parts = read.places(terms)
    assert set(words) == {"w17", "w399", "nowhere"} and 1 <= len(parts) <= 4 < 7
    lexicon, postings = read.chosen(terms)
    assert {r.term for r in lexicon.collect()} == {"w17", "w399"} == {r.term for r in postings.select("term").distinct().collect()}
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part" in plan
    assert "PushedFilters: [Or(" in plan and "EqualTo(term,w17)" in plan
    assert read.chosen(terms.filter("false"))[1].count() == 0


def test_bounds_leave_out_documents(spark, both):
    queries = spark.createDataFrame([(0, "w390 every w0"), (1, "w200 w0 w1 w2")], "query_id long, text string")
    search = stored.top_k(both[1], queries, "smooth", k=2)
    assert hits(search.hits) == [r for r in hits(index.search(both[0], queries, "smooth")) if r[1] <= 2]
    work = search.work()
    assert work["essential"] < work["postings"] / 2 and work["scored"] <= work["candidates"] < 403  # of 403 documents for each of two queries


def test_an_index_of_nothing(spark, tmp_path):
    built, read = written(spark, corpus(spark).limit(0), str(tmp_path))
    assert read.documents == 0 and index.search(read, asked(spark)).count() == 0 and stored.top_k(read, asked(spark)).hits.count() == 0


def test_a_split_join_keeps_tasks_even(spark):
    rows = staged(spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("term"), "id"), "rows")
    side = staged(rows.groupBy("term").agg(F.count("*").alias("df")), "side")
    out = split_join(rows, side, ["term"], "df > 1000")
    assert out.count() == 20_000 and out.filter("term = 'hot'").select("df").distinct().collect() == [(6667,)]
    # What is shuffled by term has no large key left.
    rest = rows.join(side.filter("df > 1000"), "term", "left_anti").repartition(16, "term").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert rest[1] == 13_333 and rest[0] < 2_500


def test_rows_without_key_bypass_a_join(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else "a", "t" if i % 3 else None) for i in range(12)], "id int, k string, t string")
    side = spark.createDataFrame([("a", "t", 1)], "k string, t string, v int")
    got = {r.id: r.v for r in keyed_left_join(rows, side, ["k", "t"]).collect()}
    assert got == {i: 1 if i % 2 == 0 and i % 3 else None for i in range(12)}
