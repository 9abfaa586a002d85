"""Quality rules: cross-document line frequency with a base of word, symbol and repetition counts (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, lower_ascii, small_side, staged, texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line that more documents of one host have is boilerplate there.
MAX_DOCS_PER_HOST = 20
#: A document is depleted when fewer words, or a smaller share of its words, are left outside boilerplate lines.
MIN_LEFT_WORDS, MIN_LEFT_PERCENT = 50, 30


def normalised(line):
    """A line for comparison: ASCII lower case, digit runs as 0, white space as one space, trimmed."""
    spaced = F.regexp_replace(lower_ascii(line), r"[\x20\x09-\x0D]+", " ")
    return F.btrim(F.regexp_replace(spaced, "[0-9]+", "0"), F.lit(" "))


def _word_count(column):
    return F.regexp_count(column, F.lit(WORD))


def base_counts(df: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed beside the columns of df.

    A 3-word window is told by its 64-bit hash; repeated windows are found within the row by one sort, so that
    nothing is shuffled and a very long text costs n log n.
    """
    words = df.withColumn("_words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n_words", F.size("_words").cast("long"))
    words = words.withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    words = words.withColumn(
        "_windows",
        F.when(F.col("n_words") >= 3, F.transform(F.slice("_words", F.lit(1), F.col("n_words").cast("int") - 2), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))),
    )
    words = words.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda e, j: F.coalesce(F.get("_sorted", j)["h"] == e["h"], F.lit(False))
    words = words.withColumn("_starts", F.array_sort(F.transform(F.filter("_sorted", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])))
    covered = F.aggregate(F.transform("_starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - s, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    counted = words.select(
        *df.columns,
        "n_words",
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def quality(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """Verdict of each row of docs (doc_id, text, host): base counts, words left outside boilerplate lines, and kept.

    A line is told by the first 16 hex digits of the md5 of its normalised form. The distinct documents that have it
    are counted by host; documents of equal text count once. Lines above max_docs are removed;
    a document with fewer than MIN_LEFT_WORDS words or MIN_LEFT_PERCENT of its words left is rejected.

    Nulls: a null text is empty, a null host is a host of its own, a null doc_id stays a row. Repeated rows are
    judged alike and all returned. An empty table gives an empty one. Other columns of docs are not used.
    """
    docs = texts(docs.select("doc_id", "text", F.col(host).alias("_host"))).withColumn("_text", F.md5("text"))
    lines = docs.select("doc_id", "_host", "_text", F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"))
    hashed = lines.withColumn("_h", F.transform("_lines", lambda x: F.struct(F.substring(F.md5(normalised(x)), 1, 16).alias("h"), _word_count(x).alias("n"))))
    hashed = staged(hashed.select("doc_id", "_host", "_text", "_h"), "line-hashes")
    seen = hashed.select("_host", F.xxhash64("_text").alias("v"), F.explode(F.array_distinct(F.transform("_h", lambda x: x["h"]))).alias("h")).distinct()
    frequent = staged(seen.groupBy("_host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > max_docs), "frequent-lines")

    known = small_side(frequent.select(F.coalesce("_host", F.lit("")).alias("k"), F.col("_host").isNull().alias("z"), "h", F.lit(True).alias("hit")))
    rows = hashed.select("doc_id", "_text", F.coalesce("_host", F.lit("")).alias("k"), F.col("_host").isNull().alias("z"), F.posexplode("_h").alias("pos", "e")).withColumn("h", F.col("e.h"))
    gone = rows.join(known, ["k", "z", "h"], "left").groupBy("doc_id", "_text").agg(F.sum(F.when(F.col("hit"), F.col("e.n")).otherwise(0)).alias("_gone"), F.sum((F.col("pos") == 0).cast("int")).alias("_copies"))
    gone = gone.filter(F.col("_gone") > 0).select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), (F.col("_gone") / F.col("_copies")).cast("long").alias("n_boilerplate_words"))

    # Staged, as a later filter on a verdict would else be computed by walking the text anew at every use of a part.
    base = staged(base_counts(docs).drop("text"), "base-counts")
    joined = base.join(gone, base["doc_id"].eqNullSafe(gone["_d"]) & (base["_text"] == gone["_t"]), "left")
    left = F.col("n_words") - F.coalesce("n_boilerplate_words", F.lit(0))
    depleted = (left < MIN_LEFT_WORDS) | (100 * left < MIN_LEFT_PERCENT * F.col("n_words"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), left.alias("n_words_left"), "_text")


def filter_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that `quality` keeps, with their own columns."""
    verdict = quality(docs, host).filter("kept").select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t")).distinct()
    on = docs["doc_id"].eqNullSafe(verdict["_d"]) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == verdict["_t"])
    return docs.join(verdict, on, "left_semi")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
l0 AS (SELECT r, host, unnest(string_split(text, chr(10))) AS l FROM d),
l AS (SELECT r, host, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
  substr(md5(trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'))), 1, 16) AS h
  FROM l0 WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM l GROUP BY r),
freq AS (SELECT host, h FROM (SELECT DISTINCT l.host, md5(d.text) AS v, l.h FROM l JOIN d USING (r)) GROUP BY host, h HAVING count(*) > 20),
gone AS (SELECT r, sum(n) AS g FROM l WHERE EXISTS (SELECT 1 FROM freq f WHERE f.h = l.h AND f.host IS NOT DISTINCT FROM l.host) GROUP BY r),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (len(ws) - coalesce(g, 0))::BIGINT AS n_words_left FROM w LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 50 AND 100 * n_words_left >= 30 * n_words AS kept FROM b
"""
