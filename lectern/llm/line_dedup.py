"""Line dedup by a segment-partition edit join (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, small_side, staged, texts

#: Edits up to which two lines are the same, and the length (code points) from which lines take part in the edit join
#: by default: a few edits make shorter lines that differ the same.
EDITS, MIN_CHARS = 2, 32
#: Rows up to which keys of repeated or similar lines are broadcast; beyond that the join shuffles.
KEYS = 500_000


def segments(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, move) of each substring at which a line may hold a segment of a line as long or shorter.

    For segment i of a line shorter by d, the start may move by at most i edits from the left, and by at most
    edits - i from the right end; only starts that fit both are probed (multi-match-aware selection).
    """
    return [(d, i, m) for d in range(edits + 1) for i in range(edits + 1) for m in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1)]


def substring_hashes(lines: DataFrame, edits: int) -> DataFrame:
    """key, h and own (whether it is a segment of the line itself) of each line (key, line, len) at each of segments().

    Segment i of n characters reaches from n * i / (edits + 1) to n * (i + 1) / (edits + 1), rounded down; h is of
    the length n, i and the text there. The places are exploded first, so that one small expression hashes them all.
    """
    place = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(m).alias("m")) for d, i, m in segments(edits)))
    out = lines.select("key", "line", "len", F.explode(place).alias("p")).select("key", "line", "len", (F.col("len") - F.col("p.d")).alias("n"), "p.i", "p.m", F.expr("p.d = 0 and p.m = 0").alias("own"))
    edge = lambda i: f"cast((n * {i}) div {edits + 1} as int)"
    out = out.withColumn("at", F.expr(f"{edge('i')} + 1 + m")).withColumn("size", F.expr(f"{edge('(i + 1)')} - {edge('i')}"))
    return out.filter("at >= 1 and at + size - 1 <= len").select("key", F.xxhash64("n", "i", F.expr("substring(line, at, size)")).alias("h"), "own")


def edit_distance(edits: int) -> Column:
    """Distance of the character arrays _x and _y of sizes _m <= _n, or more than `edits`: bit-parallel in a band.

    Bits of a small word stand for the 2 * edits + 1 rows around the diagonal and move down one row with each
    character of b. The distance is first followed along the band's lower diagonal, then along the last row. Beyond
    3 * edits it stays as it is: from there the band can't come back to `edits`. Neither array may be empty, and _n - _m is `edits` at most.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def let(value: Column, body) -> Column:
        """body(value), with value computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def step(s, i):
        def matched(char):
            out = F.lit(0)
            for k in range(width):
                out = out + F.when(F.get("_x", i - edits + k) == char, F.lit(1 << k)).otherwise(F.lit(0))
            return out

        def moved_on(zero):
            plus = s["down"].bitwiseOR(F.lit(full).bitwiseXOR(zero.bitwiseOR(s["up"])))
            minus = zero.bitwiseAND(s["up"])
            down = F.shiftright(zero, 1)
            bit = (F.col("_m") - i + edits - 1).cast("int")  # of the last row of the shorter line
            along = F.call_function("shiftright", plus, bit).bitwiseAND(1) - F.call_function("shiftright", minus, bit).bitwiseAND(1)
            far = s["dist"] + F.when(i < F.col("_m") - edits, 1 - F.shiftright(zero, width - 1)).otherwise(along)
            up = minus.bitwiseOR(F.lit(full).bitwiseXOR(down.bitwiseOR(plus))).bitwiseAND(full)
            return F.struct(up.cast("int").alias("up"), down.bitwiseAND(plus).cast("int").alias("down"), far.cast("int").alias("dist"))

        zero = lambda hits: ((hits.bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(hits).bitwiseOR(s["down"]).bitwiseAND(full)
        return F.when(s["dist"] > 3 * edits, s).otherwise(let(let(let(F.get("_y", i), matched), zero), moved_on))

    start = F.struct(F.lit((full >> edits) << edits).cast("int").alias("up"), F.lit(0).cast("int").alias("down"), F.least("_m", F.lit(edits)).cast("int").alias("dist"))
    return F.aggregate(F.sequence(F.lit(0), F.col("_n") - 1), start, step, lambda s: s["dist"])


#: Letters whose counts bound the distance from below: an edit changes them by two in all at most.
LETTERS = "enrtiasolduchmpg"


def letter_counts(column: str) -> Column:
    """Counts of sixteen letters modulo 16, four bits each, in one long."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = (F.length(column) - F.length(F.replace(F.col(column), F.lit(c), F.lit("")))).cast("long")
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(15), 4 * i))
    return out


def letters_apart(a: str, b: str) -> Column:
    """Sum of the differences of two letter counts, each the shorter way around modulo 16."""
    out = F.lit(0)
    for i in range(len(LETTERS)):
        one, two = (F.shiftrightunsigned(F.col(c), 4 * i).bitwiseAND(15) for c in (a, b))
        out = out + F.least(F.abs(one - two), 16 - F.abs(one - two))
    return out


def _similar(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """The pairs (early, late) of keys whose lines are within `edits` edits."""
    both = staged(pairs, "line-pairs").join(lines.select(F.col("key").alias("early"), F.col("line").alias("a")), "early").join(lines.select(F.col("key").alias("late"), F.col("line").alias("b")), "late")
    both = both.select("early", "late", *(F.expr(f"if(length(a) <= length(b), {x}, {y})").alias(z) for x, y, z in (("a", "b", "_a"), ("b", "a", "_b"))))
    for k in (256, 64, 16, 4):  # equal ends don't change the distance
        for _ in range(3):
            both = both.withColumn("_c", F.expr(f"if(left(_a, {k}) = left(_b, {k}) and length(_a) > {k}, {k}, 0)")).select("early", "late", *(F.expr(f"substring({c}, _c + 1)").alias(c) for c in ("_a", "_b")))
            both = both.withColumn("_c", F.expr(f"if(right(_a, {k}) = right(_b, {k}) and length(_a) > {k}, {k}, 0)")).select("early", "late", *(F.expr(f"left({c}, length({c}) - _c)").alias(c) for c in ("_a", "_b")))
    both = both.select("early", "late", F.length("_a").alias("_m"), F.length("_b").alias("_n"), F.split("_a", "").alias("_x"), F.split("_b", "").alias("_y"))
    both = staged(both, "line-candidates")  # else the split moves into the walk over it
    return staged(both.withColumn("dist", edit_distance(edits)).filter(F.col("dist") <= edits).select("early", "late"), "similar-lines")


def _late(distinct: DataFrame, edits: int) -> DataFrame:
    """key of the lines (key, line, len, first) within `edits` edits of a line with an earlier first occurrence.

    Two such lines share a segment at a fitting place. Of the lines at a segment, the earliest is verified against
    the others; what is known to be late then is not looked at again as a late line, so that a group of similar lines
    is not paired out. Pairs are left out where the counts of letters differ too much.
    """
    hashes = substring_hashes(distinct, edits)
    here = Window.partitionBy("h")
    met = hashes.withColumn("_m", (F.min("key").over(here) != F.max("key").over(here)) & F.max("own").over(here)).filter("_m").select("key", "h", "own").distinct()
    met = staged(met.groupBy("key", "h").agg(F.max("own").alias("own")), "shared-segments")
    wanted = staged(met.select("key").distinct(), "segment-keys")
    lines = staged(distinct.join(small_side(wanted, KEYS), "key", "left_semi").withColumn("letters", letter_counts("line")), "segment-lines")
    known = small_side(lines.select("key", "len", "letters", "first"), BROADCAST_ROWS)
    rows = staged(met.join(known, "key"), "segment-rows")

    earliest = rows.groupBy("h").agg(F.min_by(F.struct("key", "own", "letters", "len"), "first").alias("e")).select("h", F.col("e.key").alias("early"), F.col("e.own").alias("own2"), F.col("e.letters").alias("letters2"), F.col("e.len").alias("len2"))
    fits = (letters_apart("letters", "letters2") <= 2 * edits) & F.expr("(own and len <= len2 or own2 and len2 <= len)")
    begun = rows.join(earliest, (rows["h"] == earliest["h"]) & (F.col("key") != F.col("early")) & fits)
    similar = _similar(begun.select("early", F.col("key").alias("late")).distinct(), lines, edits)
    late = staged(similar.select("late").distinct(), "late-lines")

    rest = rows.join(small_side(late, KEYS), F.col("key") == F.col("late"), "left_anti")
    before = rows.select("h", F.col("key").alias("early"), F.col("own").alias("own2"), F.col("len").alias("len2"), F.col("letters").alias("letters2"), F.col("first").alias("first2"))
    pairs = rest.join(before, (rest["h"] == before["h"]) & F.expr("first2 < first") & fits).select("early", F.col("key").alias("late")).distinct()
    pairs = pairs.join(begun.select("early", F.col("key").alias("late")), ["early", "late"], "left_anti")
    more = _similar(pairs, lines, edits)
    return staged(late.union(more.select("late")).distinct().withColumnRenamed("late", "key"), "late-lines")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, version (hash of the text), pos, line, key and len of each line that takes part."""
    out = docs.select("doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.filter(F.btrim("line", F.lit(SPACE)) != "").withColumn("len", F.length("line"))
    return out.withColumn("key", F.xxhash64("line"))


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, version and the positions of the lines of docs (doc_id, text) that repeat an earlier line.

    Lines are told by a 64-bit hash. Each distinct line that is not blank has a first occurrence, by
    (doc_id, version, pos). A line goes if it is not that first one, at any length, or if a distinct line within
    `edits` edits has an earlier first occurrence and both have min_chars or more.
    """
    lines = _lines(docs)
    here = F.struct("doc_id", "version", "pos")
    narrow = staged(lines.select("doc_id", "version", "pos", "key"), "line-keys")
    firsts = staged(narrow.groupBy("key").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first"), "firsts")
    repeated = small_side(firsts, KEYS)
    distinct = lines.filter(F.col("len") >= min_chars).join(repeated, "key", "left").filter(F.col("first").isNull() | (F.col("first") == here))
    late = _late(staged(distinct.select("key", "line", "len", here.alias("first")), "lines"), edits)

    verdict = firsts.join(late.withColumn("late", F.lit(True)), "key", "full").select("key", "first", F.coalesce("late", F.lit(False)).alias("late"))
    verdict = small_side(staged(verdict, "line-verdicts"), KEYS)
    gone = narrow.join(verdict, "key").filter(F.col("late") | (here != F.col("first")))
    return gone.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("gone"))


def line_dedup(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of docs without their repeated lines: their columns, and n_lines, n_removed (in place of given ones).

    The kept lines of a text stay as they are and in order. A null text is empty; repeated rows are one text and get
    the same result; a null doc_id comes before others; blank lines are always kept; a text whose lines
    all go becomes empty, and its row stays. Very long texts are taken whole, extra columns may have any name, and an
    empty table gives an empty one.
    """
    docs = texts(docs).drop("n_lines", "n_removed")
    gone = repeated_lines(docs.select("doc_id", "text"), edits, min_chars)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("v"))
    joined = rows.join(gone, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")), "left")
    lines = F.split("row.text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return joined.select(*columns, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))


def sql(table: str = "documents") -> str:
    return f"""
d AS (SELECT doc_id, md5(coalesce(text, '')) AS version, coalesce(text, '') AS t FROM {table}),
l AS (SELECT doc_id, version, i AS pos, ls[i] AS raw, ls[i] AS line FROM (SELECT *, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM d)),
every AS (SELECT line, min((doc_id, version, pos)) AS first FROM l WHERE trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line),
f AS (SELECT line, first FROM every WHERE length(line) >= {MIN_CHARS}),
part AS (SELECT line, first, n, k, 1 + n * k // {EDITS + 1} AS s, n * (k + 1) // {EDITS + 1} - n * k // {EDITS + 1} AS z FROM (SELECT *, length(line) AS n, unnest(range({EDITS + 1})) AS k FROM f)),
own AS (SELECT line, first, n, k, substr(line, s, z) AS g FROM part),
size AS (SELECT DISTINCT n, k, s, z FROM part),
near AS (SELECT f.line, f.first, q.n, q.k, substr(f.line, q.s + m, q.z) AS g FROM f JOIN size q ON q.n BETWEEN length(f.line) - {EDITS} AND length(f.line) + {EDITS} CROSS JOIN (SELECT unnest(range(-{EDITS}, {EDITS} + 1)) AS m) WHERE q.s + m >= 1),
pair AS (SELECT DISTINCT a.line AS x, b.line AS y FROM own a JOIN near b USING (n, k, g) WHERE a.line <> b.line AND a.first < b.first),
late AS (SELECT DISTINCT y AS line FROM pair WHERE levenshtein(x, y) <= {EDITS}),
gone AS (SELECT l.doc_id, l.version, l.pos FROM l JOIN every USING (line) WHERE first <> (l.doc_id, l.version, l.pos) OR l.line IN (SELECT line FROM late)),
deduped AS (SELECT l.doc_id, l.version, coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.version = l.version AND g.pos = l.pos GROUP BY ALL)"""


SQL = "WITH " + sql() + " SELECT doc_id, text, n_lines, n_removed FROM deduped"
