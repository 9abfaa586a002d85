"""N-gram Jaccard join of documents by grouped prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Words, discard, mix, shingles, slices, small_side, staged
from .graph import components

SHINGLE, PERCENT = 4, 85
#: Share of all shingles, chosen by hash, from which the first step tells documents that can link to nothing.
SHARE = 0.25
#: Documents looked at for shingles that very many have, of those one must have a shingle, and shingles kept at most.
#: These count as shared without being dealt out. The choice changes the work, never the result.
LOOKED_AT, SEEN_IN, FREQUENT = 5_000, 4, 500_000
#: Rows up to which the ids of candidates are broadcast to pick their texts; beyond that the texts are shuffled.
CANDIDATES = 400_000


def _unique(column, size: int):
    """Sorted distinct shingle hashes of each text: hashes, document of each, and number by document."""
    h, doc = shingles(Words(column), size)
    h = h.view(np.int64)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, doc, np.bincount(doc, minlength=len(column))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[ends[1:]] - total[ends[:-1]]


def _key(h: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128-bit hash of each set of hashes."""
    n = np.diff(ends).astype(np.uint64)
    with np.errstate(over="ignore"):
        both = np.stack([mix(_sums(mix(h.view(np.uint64) ^ np.uint64(c)), ends) + n) for c in (1, 2)], 1).astype("<u8").tobytes()
    return [both[i * 16 : i * 16 + 16] for i in range(len(n))]


def _lists(values: np.ndarray, doc: np.ndarray, n: int):
    """An Arrow list of each document's values, which stand in the order of documents."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _sampled(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h.view(np.uint64) ^ np.uint64(3)) < np.uint64(int(SHARE * 2**64))


def _described(size: int, frequent=None):
    """Task function: per row the number of shingles, a 128-bit hash of their set, and of SHARE of them those not frequent."""

    def run(batches):
        import pyarrow as pa

        known = np.zeros(0, np.int64) if frequent is None else frequent.value
        for batch in slices(batches, "text"):
            h, doc, n = _unique(batch.column("text"), size)
            chosen = _sampled(h)
            if len(known):
                chosen &= known[np.minimum(np.searchsorted(known, h), len(known) - 1)] != h
            key = pa.array(_key(h, np.concatenate(([0], np.cumsum(n)))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n.astype(np.int32)), key, _lists(h[chosen], doc[chosen], len(n))], names=["doc_id", "version", "n", "set", "sample"])

    return run


def _whole(size: int):
    """Task function: all shingles, for the rows whose text has the set of the node."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            h, doc, n = _unique(batch.column("text"), size)
            same = pa.array([a == b for a, b in zip(_key(h, np.concatenate(([0], np.cumsum(n)))), batch.column("set").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), _lists(h, doc, len(n))], names=["node", "n", "shingles"]).filter(same)

    return run


def _frequent(docs: DataFrame, size: int, schema: str):
    """Sampled shingles that many documents have, seen in a few documents: at most FREQUENT, in order."""
    looked_at = docs.sample(min(1.0, LOOKED_AT / max(docs.count(), 1)), seed=1)
    seen = looked_at.mapInArrow(_described(size), schema).select(F.explode("sample").alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    found = seen.filter(F.col("c") >= SEEN_IN).orderBy(F.desc("c"), "token").limit(FREQUENT).select("token").toArrow()
    return docs.sparkSession.sparkContext.broadcast(np.sort(np.asarray(found.column("token"), np.int64)))


def least_common(a: str, b: str, percent: int) -> str:
    """SQL: shingles that sets of a and b shingles share at least if they link."""
    return f"int(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _fits(percent: int) -> str:
    """SQL: whether what is known of an entry (n, shared, pos) and of another (n2, shared2, pos2) allows a link.

    Sets share no more than the shared shingles of each, and, from their first common one on, than what is left there.
    """
    least = least_common("n", "n2", percent)
    return f"least(shared, shared2) >= {least} and least(n - pos, n2 - pos2) >= {least}"


def _candidates(docs: DataFrame, first: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """node, first_id, first_version, set and n of each distinct set, and node, n and whole shingles of those that can link.

    Of the shingles of a set that links to another, at most n - ceil(percent * n / 100) are in no other set. More of
    them than that among SHARE of its shingles rule it out.
    """
    live = first.filter("n > 0 and doc_id is not null")
    here = F.struct("doc_id", "version")
    nodes = staged(live.groupBy("set", "n").agg(F.min("row").alias("node"), F.min(here).alias("f"), F.count("*").alias("copies"), F.max(F.size("sample")).alias("m")).select("set", "n", "node", F.col("f.doc_id").alias("first_id"), F.col("f.version").alias("first_version"), "copies", "m"), "sets")
    by_token = Window.partitionBy("token")
    dealt = live.select(F.xxhash64("set").alias("s"), F.explode("sample").alias("token"))
    met = dealt.select("s", (F.min("s").over(by_token) != F.max("s").over(by_token)).alias("met")).filter("met").groupBy("s").agg(F.count("*").alias("c"))
    alone = f"(n - int(({percent} * n + 99) div 100))"
    marked = nodes.withColumn("s", F.xxhash64("set")).join(met, "s", "left").filter(f"coalesce(c, 0) >= copies * (m - {alone})")
    wanted = staged(marked.select("node", "n", F.col("first_id").alias("doc_id"), "set"), "wanted-sets")
    chosen = docs.join(small_side(wanted, CANDIDATES), "doc_id").select("node", "n", "set", "text")
    return nodes, staged(chosen.mapInArrow(_whole(size), "node long, n int, shingles array<long>"), "whole-sets")


def _ranked(whole: DataFrame, percent: int) -> DataFrame:
    """node, n, shingles that other sets have too (rare ones first), their number, and the group of equal prefixes.

    Shingles of one set only come first in the order and meet nothing; of the rest, the prefix has `length`.
    """
    entries = whole.select("node", "n", F.explode("shingles").alias("token"))
    counts = entries.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    lists = entries.join(counts, "token").groupBy("node", "n").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("l"))
    ranked = lists.select("node", "n", F.size("l").alias("shared"), F.col("l.token").alias("shingles")).withColumn("length", F.expr(f"shared - int(({percent} * n + 99) div 100) + 1")).filter("length > 0")
    prefix = F.slice("shingles", F.lit(1), F.col("length"))
    ranked = staged(ranked.withColumns({"p": F.xxhash64(prefix), "q": F.xxhash64(F.lit(2), prefix)}), "ranked-sets")
    groups = ranked.groupBy("n", "shared", "p", "q").agg(F.min("node").alias("group"))
    return staged(ranked.join(groups, ["n", "shared", "p", "q"]).select("node", "n", "shared", "length", "shingles", "group"), "grouped-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of nodes that link, by their whole sets."""
    a, b = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("shingles").alias(f"s{k}")) for k in ("x", "y"))
    both = staged(pairs, "pairs").join(a, "x").join(b, "y").withColumn("c", F.size(F.array_intersect("sx", "sy")))
    return staged(both.filter(f"100 * c >= {percent} * (nx + ny - c)").select("x", "y"), "links")


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """node and component of the nodes of sets that link to another."""
    groups = sets.filter("node = group").select("group", "n", "shared", F.posexplode(F.slice("shingles", F.lit(1), F.col("length"))).alias("i", "token"))
    index = groups.select("token", "group", "n", "shared", (F.col("n") - F.col("shared") + F.col("i")).alias("pos"))
    several = index.groupBy("token").agg(F.count("*").alias("c"), F.min_by(F.struct("group", "n", "shared", "pos"), F.struct(F.col("n") - F.col("shared"), "group")).alias("e"))
    members = sets.select("group", "node")
    lists = staged(index.join(several.select("token", F.col("e.group").alias("pivot"), F.col("e.n").alias("n2"), F.col("e.shared").alias("shared2"), F.col("e.pos").alias("pos2"), "c"), "token"), "prefix-lists")

    star = lists.filter(f"group <> pivot and {_fits(percent)}").select("group", "pivot").distinct().join(members, "group").select(F.col("node").alias("x"), F.col("pivot").alias("y"))
    inside = sets.filter("group <> node").select(F.col("node").alias("x"), F.col("group").alias("y"))
    links = _verified(star.union(inside).distinct(), sets, percent)
    labels = staged(components(links), "labels")

    def opened(entries: DataFrame) -> DataFrame:
        """Entries of lists that hold several components, with theirs and that of the pivot (main)."""
        named = entries.drop("component", "main").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = named.join(labels.toDF("pivot", "main"), "pivot", "left").withColumn("main", F.coalesce("main", "pivot"))
        open_lists = named.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("token")
        return staged(named.join(open_lists, "token", "left_semi"), "open-lists")

    several_nodes = lists.join(members, "group").select("token", "node", "pivot", "n", "shared", "pos")
    entries = opened(several_nodes)
    # A second pivot of each open list, outside the component of the first, meets all nodes outside its own.
    second = entries.filter("component <> main").groupBy("token").agg(F.min_by(F.struct("node", "n", "shared", "pos", "component"), F.struct(F.col("n") - F.col("shared"), "node")).alias("e"))
    second = second.select("token", F.col("e.node").alias("y"), F.col("e.n").alias("n2"), F.col("e.shared").alias("shared2"), F.col("e.pos").alias("pos2"), F.col("e.component").alias("component2"))
    star = entries.join(second, "token").filter(f"component <> component2 and {_fits(percent)}").select(F.col("node").alias("x"), "y").distinct()
    links = links.union(_verified(star, sets, percent))
    labels = staged(components(links), "labels")

    # What then is left between components: nodes outside the main one against all of their list, by classes of size.
    entries = opened(entries)
    kind = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    others = entries.select("token", kind.alias("class"), F.col("node").alias("y"), F.col("n").alias("n2"), F.col("shared").alias("shared2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"), (F.col("component") == F.col("main")).alias("in_main"))
    outside = entries.filter("component <> main").select("token", F.explode(F.array(kind - 1, kind, kind + 1)).alias("class"), "node", "n", "shared", "pos", "component")
    rest = outside.join(others, (outside["token"] == others["token"]) & (outside["class"] == others["class"]) & F.expr(f"component <> component2 and (in_main or node < y) and {_fits(percent)}"))
    links = links.union(_verified(rest.select(F.col("node").alias("x"), "y").distinct(), sets, percent))
    return staged(components(links), "labels")


def classes(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, version (xxhash64 of the text), n_shingles, component_id and component_version of each row of docs.

    component_id and component_version are the least (doc_id, version) of the rows in reach; see ngram_join.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    schema = f"doc_id {kind}, version long, n int, set binary, sample array<long>"
    first = staged(docs.mapInArrow(_described(size, _frequent(docs, size, schema)), schema).withColumn("row", F.monotonically_increasing_id()), "shingle-samples")
    rows = staged(first.drop("sample", "row"), "set-keys")
    nodes, whole = _candidates(docs, first, size, percent)
    discard(first)
    sets = _ranked(whole, percent)
    discard(whole)
    labels = _linked(sets, percent)
    discard(sets)

    named = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min(F.struct("first_id", "first_version")).alias("c"))
    by_set = named.join(least, "component").select("set", "n", F.col("c.first_id").alias("component_id"), F.col("c.first_version").alias("component_version"))
    out = rows.join(by_set, ["set", "n"], "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    own = {c: F.when(linked, F.col(c)).otherwise(F.col(o)).alias(c) for c, o in (("component_id", "doc_id"), ("component_version", "version"))}
    return out.select("doc_id", "version", F.col("n").cast("long").alias("n_shingles"), *own.values())


def ngram_join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs (doc_id, text).

    Sets hold 64-bit hashes of shingles, and rows with equal sets are one node. A node is dropped where too many of
    its shingles are in no other set. The shingles of the others are counted among themselves, and each node takes a
    prefix of its set with rare shingles first. Nodes with equal prefixes and sizes are one group, which enters the
    index once. Of the groups under a shingle, those that positions and counts of shared shingles allow are paired
    with one pivot, expanded to their nodes and verified; then, in lists that still hold several components, with a
    second pivot; and at last nodes of different components with each other. No link between components is missed,
    and none within one is needed.

    Null texts, texts without words and rows with a null doc_id link to nothing (component_id is the row's own
    doc_id). Very long texts are taken whole. Repeated rows are all returned; a doc_id with several texts stands in
    several nodes. Other columns are not read; an empty table gives an empty one.
    """
    return classes(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of docs of each class of linked documents: that of the least (doc_id, hash of the text).

    Rows that link to nothing all stay, but of rows that repeat one (doc_id, text) a single one does, and null and
    empty texts are one text. A null doc_id links to nothing and comes with each of its texts once.
    """
    found = classes(docs, size, percent)
    same = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("version") == F.col("component_version"))
    stays = staged(found.filter(same).groupBy("doc_id", "version").agg(F.count("*").alias("n")), "kept-documents")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("d"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("v"))
    joined = rows.join(stays, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("v") == F.col("version")))
    return joined.filter("n = 1").unionByName(joined.filter("n > 1").dropDuplicates(["d", "v"])).select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(ws) - {SHINGLE - 2})] END)) AS g FROM w),
nodes AS (SELECT g, len(g) AS n, min(doc_id) AS node FROM s WHERE len(g) > 0 GROUP BY g),
t AS (SELECT node, n, unnest(g) AS token FROM nodes),
f AS (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM t),
p AS (SELECT node, n, token FROM f QUALIFY row_number() OVER (PARTITION BY node ORDER BY df, token) <= n - ({PERCENT} * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.node AS x, b.node AS y, a.n AS nx, b.n AS ny FROM p a JOIN p b ON a.token = b.token AND a.node < b.node AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
k AS (SELECT x, y, nx, ny, count(*) AS m FROM c JOIN t a ON a.node = x JOIN t b ON b.node = y AND b.token = a.token GROUP BY ALL),
e AS (SELECT x, y FROM k WHERE 100 * m >= {PERCENT} * (nx + ny - m)),
ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y),
least AS (SELECT x AS node, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.g) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN nodes n ON n.g = s.g LEFT JOIN least l ON l.node = n.node
"""
