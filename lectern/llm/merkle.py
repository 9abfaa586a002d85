"""Merkle manifest of a dataset: a tree of hashes by language, a proof for each row, and its check."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, lower_ascii, numbered, small_side, staged

#: Children of a node, and leaves of a block: a power of ARITY, so that no run of siblings crosses a block.
ARITY, BLOCK = 8, 8**3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(column: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(columns: Mapping[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def _siblings(nodes: DataFrame) -> DataFrame:
    """Nodes (g, pos, n, h) with `left` and `right`: the digests of their run before and after them.

    Lag and lead columns of fixed offsets, masked by the slot in the run and by the run's length, within blocks of
    consecutive nodes: a group of any size is dealt over its blocks.
    """
    w = Window.partitionBy("g", "block").orderBy("pos")
    slot = F.col("pos") % ARITY
    length = F.least(F.lit(ARITY), F.col("n") - F.col("pos") + slot)
    lag = [F.when(slot >= i, F.lag("h", i).over(w)).otherwise("") for i in range(ARITY - 1, 0, -1)]
    lead = [F.when(slot + i < length, F.lead("h", i).over(w)).otherwise("") for i in range(1, ARITY)]
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    return blocks.withColumns({"left": F.concat(*lag), "right": F.concat(*lead)}).drop("block")


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Staged levels from the leaves (g, pos, n, h and others) up; a group ends with the level on which it has one node."""
    levels = [staged(_siblings(nodes), f"{name}-0")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = levels[-1].filter((F.col("n") > 1) & (F.col("pos") % ARITY == 0))
        parents = first.select("g", F.floor(F.col("pos") / ARITY).alias("pos"), F.ceil(F.col("n") / ARITY).alias("n"), F.sha2(F.concat("h", "right"), 256).alias("h"))
        levels.append(staged(_siblings(parents), f"{name}-{len(levels)}"))
        most = -(-most // ARITY)
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """g, h: the one node that remains of each group."""
    out = levels[0].filter("n = 1").select("g", "h")
    for level in levels[1:]:
        out = out.union(level.filter("n = 1").select("g", "h"))
    return out


def _with_paths(levels: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """Leaves with `path`, the (left, right) of each level above their own, and the columns of `above` (g, path, others).

    `above` meets the top node of each group alone, and each node its parent, so that no join key is hot.
    """
    carried = [c for c in above.columns if c != "g"]
    parents = None
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        out = level.filter("n = 1").join(above, "g")
        if parents is not None:
            children = level.filter("n > 1").withColumn("_up", F.floor(F.col("pos") / ARITY))
            out = out.unionByName(children.join(parents, ["g", "_up"]).drop("_up"))
        if k:
            own = F.when(F.col("n") > 1, F.concat(F.array(F.struct("left", "right")), "path")).otherwise(F.col("path"))
            parents = staged(out.withColumn("path", own).select("g", F.col("pos").alias("_up"), *carried), f"{name}-paths-{k}")
    return out


def _tree(leaves: DataFrame, order: list[str], name: str) -> list[DataFrame]:
    """Levels of leaves (g, h, order columns and others), which stand by order within each g."""
    leaves = numbered(leaves, ["g"], order, f"{name}-order")
    sizes = staged(leaves.groupBy("g").agg((F.max("pos") + 1).alias("n")), f"{name}-sizes")
    return _levels(leaves.join(small_side(sizes), "g"), name)


def manifest(docs: DataFrame, received: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    A leaf is the hash of doc_id, source, lang, n_chars and text; the leaves of a language stand by doc_id, and runs of
    eight are hashed to their parent until one node, the subroot, remains; the subroots by language make the root in the
    same way. proof_sha256 hashes the siblings met on the way up. folded_root is computed again from the leaf of the row
    as `received` (columns by name; the others as they are) and from those siblings; verified: it equals the root.

    Nulls count as `-` in a leaf and come first in each order; a null language is a group of its own. Rows that repeat a
    doc_id stand by their leaf; equal rows are leaves of their own, each with its own place. Empty and long texts are
    hashed whole. Other columns may have any name. An empty table gives an empty one.
    """
    own = {c: F.col(c) for c in FIELDS}
    altered = own | dict(received or {})
    group = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))  # in the order of lang
    leaves = staged(docs.select("doc_id", group.alias("g"), leaf(own).alias("h"), leaf(altered).alias("got") if received else F.lit(None).cast("string").alias("got")), "leaves")
    levels = _tree(leaves, ["doc_id", "h"], "merkle")
    subroots = staged(_tops(levels).withColumn("lang", F.col("g")).withColumn("g", F.lit("")), "subroots")
    upper = _tree(subroots, ["lang"], "merkle-root")
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = _tops(upper).select("g", F.col("h").alias("root"), none.alias("path"))
    tops = _with_paths(upper, root, "merkle-root")
    steps = F.concat(F.array(F.struct("left", "right")), "path")
    above = staged(tops.select(F.col("lang").alias("g"), F.col("h").alias("subroot"), "root", F.when(F.col("n") > 1, steps).otherwise(F.col("path")).alias("path")), "merkle-above")
    out = _with_paths(levels, above, "merkle")
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    folded = F.aggregate(steps, F.coalesce("got", "h"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    # A lone leaf has no level of its own: it is the subroot.
    lone = F.aggregate("path", F.coalesce("got", "h"), lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))
    out = out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(F.concat("left", "right", siblings), 256).alias("proof_sha256"), F.when(F.col("n") > 1, folded).otherwise(lone).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def case_folded(every: int = 3) -> dict[str, Column]:
    """A tampering: where `every` divides the CRC-32 of the decimal doc_id, the letters A-Z of the text are lower-cased."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"text": F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))}


CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END))"
"""CRC-32 of an ASCII text in SQL: a byte is joined, then eight bits are shifted out."""


def _level_sql(k: int) -> str:
    """Level k of both trees, as t<k> (g, pos, n, h, l, r) from the nodes b<k>."""
    mine = "PARTITION BY g, pos // 8 ORDER BY pos"
    return f"""t{k} AS (SELECT *, coalesce(string_agg(h, '') OVER ({mine} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({mine} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM b{k}),
b{k + 1} AS (SELECT g, pos // 8 AS pos, any_value((n + 7) // 8) AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM b{k} GROUP BY g, pos // 8)"""


def _sql(levels: int = 9) -> str:
    """SQL for up to 8**levels rows of a language, and as many languages."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    made = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    down = " ".join(f"JOIN t{k} ON t{k}.g = t0.g AND t{k}.pos = t0.pos // {8**k}" for k in range(1, levels))
    sides = " || ".join(f"t{k}.l || t{k}.r" for k in range(levels))
    tree = lambda src: f"WITH b0 AS ({src}), " + ", ".join(map(_level_sql, range(levels)))
    # The fold is spelled level by level, in a column each, so that the text stays short.
    steps = lambda start: ", ".join(f"CASE WHEN n{k} = 1 THEN {start if k == 0 else f'f{k - 1}'} ELSE sha256(l{k} || {start if k == 0 else f'f{k - 1}'} || r{k}) END AS f{k}" for k in range(levels))
    cols = ", ".join(f"t{k}.n AS n{k}, t{k}.l AS l{k}, t{k}.r AS r{k}" for k in range(levels))
    leaves = f"SELECT doc_id, coalesce('=' || lang, '') AS g, {made('text')} AS h, CASE WHEN {CRC32.format('doc_id::VARCHAR')} % 3 = 0 THEN {made(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} ELSE {made('text')} END AS got FROM documents"
    lower = f"""low AS (SELECT *, {steps('got')} FROM ({tree(f"SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM ({leaves})")}
SELECT t0.doc_id, t0.g, t0.h, t0.got, b{levels}.h AS subroot, {sides} AS sides, {cols} FROM t0 {down} JOIN b{levels} ON b{levels}.g = t0.g))"""
    upper = f"""up AS ({tree("SELECT ''::VARCHAR AS g, g AS lang, subroot AS h, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT g, subroot FROM low)")}
SELECT t0.lang, b{levels}.h AS root, {sides} AS up_sides, {cols} FROM t0 {down}, b{levels})"""
    return f"""WITH {lower}, {upper}, done AS (SELECT doc_id, h AS leaf, subroot, root, sha256(sides || up_sides) AS proof_sha256, low.f{levels - 1} AS mid, {", ".join(f"up.n{k}, up.l{k}, up.r{k}" for k in range(levels))} FROM low JOIN up ON low.g = up.lang),
folded AS (SELECT *, {steps('mid')} FROM done)
SELECT doc_id, leaf, subroot, root, proof_sha256, f{levels - 1} AS folded_root, f{levels - 1} = root AS verified FROM folded"""


SQL = _sql()
