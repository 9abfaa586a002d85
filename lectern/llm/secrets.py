"""Secret scans: patterns for candidates, then corpus-wide ownership frequency (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_side, staged, texts

# The patterns of the base kinds, in their order, with the least length of what counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Added kind: a bare token without keyword that mixes digits, upper and lower case.
BARE = r"[A-Za-z0-9+/_-]{20,}"
#: A value in more repositories or under more owners is a widely copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20


KINDS = ["assign", "access", "hex", "bare"]


def _hits(order: int, pattern: str, value, keep):
    """array<struct<ord,i,gap,len,value,keep>> of one kind: its matches in their order, each with the length of the text before it."""
    whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all("text", F.lit(pattern), F.lit(value))
    gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
    pairs = F.filter(F.arrays_zip(whole.alias("m"), gaps.alias("b"), values.alias("v")), lambda x: x["m"].isNotNull())
    entry = lambda x, i: F.struct(F.lit(order).alias("ord"), i.alias("i"), x["b"].alias("gap"), F.length(x["m"]).alias("len"), x["v"].alias("value"), keep(x["m"], x["v"]).alias("keep"))
    return F.when(F.col("text").rlike(pattern), F.transform(pairs, entry)).otherwise(F.expr("cast(array() as array<struct<ord:int,i:int,gap:int,len:int,value:string,keep:boolean>>)"))


def _placed(found: DataFrame) -> DataFrame:
    """_row, _repo, _owner, start, ord, kind, end, value of the hits of found that count; bare ones only beside the base spans.

    Matches are rows here: their places are running sums over their text, and overlaps are told by the furthest end
    before and the next start after, so that the work follows the number of matches, however many a text has.
    """
    rows = found.filter(F.size("hits") > 0).select("_row", "_repo", "_owner", F.explode("hits").alias("h")).select("_row", "_repo", "_owner", "h.*").repartition("_row")
    end = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "ord").orderBy("i")).cast("int")
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).filter("keep")
    # A frame that runs to the end is summed anew for each row, so the next start comes from the reverse order.
    base, text, seen = F.col("ord") < 3, Window.partitionBy("_row"), (Window.unboundedPreceding, -1)
    before = F.max(F.when(base, F.col("end"))).over(text.orderBy("start", "ord").rowsBetween(*seen))
    after = F.min(F.when(base, F.col("start"))).over(text.orderBy(F.desc("start"), F.desc("ord")).rowsBetween(*seen))
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (after.isNull() | (after >= F.col("end")))
    rows = rows.withColumn("_ok", base | free).filter("_ok")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("ord") + 1)
    return rows.select("_row", "_repo", "_owner", "start", "ord", kind.alias("kind"), "end", "value")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Spans of likely secrets in each row of docs, each with a verdict.

    Base kinds: assign, access, hex. Added kind `bare`: a token of 20 characters or more that mixes digits, upper
    and lower case and overlaps no base span, reported only if it is not widely copied. The sha256 of each value is
    counted by distinct repositories and distinct owners over the whole corpus. Values above MAX_OWNERS or
    MAX_REPOSITORIES are `example`, the rest `live`. Base spans stay whatever their verdict.

    Returns doc_id, base and spans (arrays of struct start, ord, kind, end, value, example), both in text order.
    Null texts are empty; null repositories or owners count as one each; repeated rows are all returned (as one
    repository); positions are code points.
    """
    cols = texts(docs.select("doc_id", "text", F.col(repository).cast("string").alias("_repo"), F.col(owner).cast("string").alias("_owner")))
    hits = F.concat(
        _hits(0, ASSIGN, 2, lambda m, v: F.length(v) >= 12),
        F.coalesce(F.when(F.contains("text", F.lit("AKIA")), _hits(1, ACCESS, 0, lambda m, v: F.lit(True))), F.expr("cast(array() as array<struct<ord:int,i:int,gap:int,len:int,value:string,keep:boolean>>)")),
        _hits(2, HEX, 0, lambda m, v: F.lit(True)),
        _hits(3, BARE, 0, lambda m, v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")),
    )
    found = staged(cols.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("_repo", F.lit("")).alias("_repo"), F.coalesce("_owner", F.lit("")).alias("_owner"), hits.alias("hits")), "secret-candidates")
    values = staged(_placed(found).withColumn("_key", F.sha2("value", 256)), "secret-spans")
    owners = values.select("_key", "_owner").distinct().groupBy("_key").agg(F.count("*").alias("owners"), F.lit(0).cast("long").alias("repos"))
    repos = values.select("_key", "_repo").distinct().groupBy("_key").agg(F.lit(0).cast("long").alias("owners"), F.count("*").alias("repos"))
    copied = owners.union(repos).groupBy("_key").agg(F.max("owners").alias("owners"), F.max("repos").alias("repos")).filter((F.col("owners") > MAX_OWNERS) | (F.col("repos") > MAX_REPOSITORIES))
    copied = small_side(staged(copied.select("_key", F.lit(True).alias("example")), "copied-values"))
    judged = values.join(copied, "_key", "left").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "ord", "kind", "end", "value", F.coalesce("example", F.lit(False)).alias("example")))).alias("all"))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,kind:string,end:int,value:string,example:boolean>>)")
    out = found.select("_row", "doc_id").join(judged, "_row", "left").withColumn("all", F.coalesce("all", none))
    return out.select("doc_id", F.filter("all", lambda s: s["ord"] < 3).alias("base"), F.filter("all", lambda s: (s["ord"] < 3) | ~s["example"]).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from what `scan` returns."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"),
        F.size(F.filter("spans", lambda s: ~s["example"])).cast("long").alias("n_live"),
    )


def _sql_kind(kind: str, order: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
{kind}0 AS (SELECT r, string_split_regex(text, '{p}') AS b, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM d WHERE regexp_matches(text, '{p}')),
{kind}1 AS (SELECT r, unnest(range(1, len(m) + 1)) AS i, b, m, v FROM {kind}0),
{kind} AS (SELECT r, {order} AS ord, '{kind}' AS kind, v[i] AS value, list_sum([length(x) for x in b[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS s, length(m[i]) AS n FROM {kind}1 WHERE {keep})"""


SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),"
    + ",".join([_sql_kind("assign", 0, ASSIGN, 2, "length(v[i]) >= 12"), _sql_kind("access", 1, ACCESS, 0, "true"), _sql_kind("hex", 2, HEX, 0, "true"), _sql_kind("bare", 3, BARE, 0, "regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]')")])
    + f""",
bases AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
every AS (SELECT * FROM bases UNION ALL SELECT * FROM bare b WHERE NOT EXISTS (SELECT 1 FROM bases z WHERE z.r = b.r AND z.s < b.s + b.n AND b.s < z.s + z.n)),
copied AS (SELECT value FROM every JOIN d USING (r) GROUP BY value HAVING count(DISTINCT owner) > {MAX_OWNERS} OR count(DISTINCT doc_id) > {MAX_REPOSITORIES}),
judged AS (SELECT *, value IN (SELECT value FROM copied) AS example FROM every),
agg AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) FILTER (ord < 3) AS base,
  string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, ord) FILTER (ord < 3 OR NOT example) AS spans,
  count(*) FILTER (ord < 3 AND example) AS n_example, count(*) FILTER (NOT example) AS n_live FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live FROM d LEFT JOIN agg USING (r)
"""
)
