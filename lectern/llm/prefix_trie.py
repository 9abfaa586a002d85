"""Prefix trie of conversations: nodes, their members, and sums over subtrees by bands of depth."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, numbered, small_side, split_join, staged
from .merkle import CRC32

#: Depths of a band, depths of a block (in which prefixes are summed; a multiple of BAND), and ids in a piece of a list.
BAND, BLOCK, PIECE = 8, 4096, 4096
#: A parent with more children than this, and than a thousandth of all nodes, is broadcast: at most 1,000 can be.
MANY = 1000


def rebuilt(conversations: DataFrame, stride: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """conv_id, length of each rebuilt conversation, and its turns (conv_id, d from 1, e1, e2, words).

    c begins with the first h turns of c - c % stride, h = CRC-32 of the decimal c modulo `heads`, and goes on with its
    own turns after its first h. e1 and e2 are hashes of place, role and text.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    own = staged(conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), F.regexp_count(text, F.lit(WORD)).alias("words")), "turn-hashes")  # else texts are hashed again for the ranges
    turns = numbered(own, ["conv_id"], ["turn", "role", "digest"], "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = staged(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("m"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % stride, "h": h}).join(sizes, "base", "left")
    k = F.least("h", F.coalesce("m", F.lit(0)))
    convs = staged(convs.select("conv_id", "base", "n", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt-conversations")
    first = turns.filter((F.col("conv_id") % stride == 0) & (F.col("pos") < heads - 1)).select(F.col("conv_id").alias("base"), (F.col("pos") + 1).alias("d"), "role", "digest", "words")
    begun = convs.filter("k > 0").select("conv_id", "base", "k").join(first, "base").filter("d <= k").select("conv_id", "d", "role", "digest", "words")
    # Own turns are moved by k - h where the base is short; such a row is given to each block of turns, so that a long
    # conversation is no hot key.
    moved = convs.filter("k < h").select("conv_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK))).alias("part"), (F.col("k") - F.col("h")).alias("by"))
    rest = turns.filter(F.col("pos") >= h).withColumn("part", F.floor(F.col("pos") / BLOCK))
    rest = rest.join(small_side(staged(moved, "moved")), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + 1 + F.coalesce("by", F.lit(0))).alias("d"), "role", "digest", "words")
    made = begun.unionByName(rest).select("conv_id", "d", F.xxhash64("d", "role", "digest").alias("e1"), F.xxhash64("digest", "role", F.lit("#"), "d").alias("e2"), "words")
    return convs.select("conv_id", "length"), staged(made, "rebuilt-turns")


def _paths(turns: DataFrame) -> DataFrame:
    """turns with (a, b), the identity of their node: all e1 and all e2 up to them by exclusive or; ca, cb: before their block."""
    turns = turns.withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    totals = turns.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", F.bit_xor("t1").over(before).alias("ca"), F.bit_xor("t2").over(before).alias("cb")).filter("block > 0")
    turns = turns.join(small_side(staged(carried, "trie-carries")), ["conv_id", "block"], "left").fillna(0, ["ca", "cb"])
    w = Window.partitionBy("conv_id", "block").orderBy("d")
    own = lambda e, c: F.bit_xor(e).over(w).bitwiseXOR(F.col(c))
    return turns.withColumns({"a": own("e1", "ca"), "b": own("e2", "cb")})


def _lags(key: str, w, carry: Column | None, at: Column) -> list[Column]:
    """Ancestors 1 to BAND above, as far as the band's root; `carry` stands for the row before the block's first one."""
    out = []
    for i in range(1, BAND + 1):
        lag = F.lag(key, i).over(w)
        lag = F.when((at - i) % BLOCK == 0, carry).otherwise(lag) if carry is not None else lag
        out.append(F.when((at - 1) % BAND + 1 >= i, lag).alias(f"{key}{i}"))
    return out


def _ancestors() -> Column:
    """Of the grouped lag columns: the keys from the parent to the band's root."""
    return F.filter(F.array(*(F.struct(F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i in range(1, BAND + 1))), lambda x: x["a"].isNotNull()).alias("up")


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """a, b, q (depth), conv_id, n_convs, words, up of every node."""
    w = Window.partitionBy("conv_id", "block").orderBy("d")
    rows = paths.select("conv_id", "d", "a", "b", "words", *_lags("a", w, F.col("ca"), F.col("d")), *_lags("b", w, F.col("cb"), F.col("d")))
    lagged = [f"{k}{i}" for k in "ab" for i in range(1, BAND + 1)]
    nodes = rows.groupBy("a", "b").agg(F.min("d").alias("q"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), *(F.max(c).alias(c) for c in lagged))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    zero = lambda c, kind="long": F.lit(0).cast(kind).alias(c)
    none = F.array().cast("array<struct<a:long,b:long>>").alias("up")
    return nodes.select("a", "b", "q", "conv_id", "n_convs", "words", _ancestors()).unionByName(root.select(zero("a"), zero("b"), zero("q"), "conv_id", "n_convs", zero("words", "int"), none))


def _coarse(paths: DataFrame, unit: int) -> DataFrame:
    """a, b, q, up of the nodes whose depth is q * unit, with ancestors at such depths: band roots of the bands below."""
    q = F.col("d") / unit
    rows = paths.filter(F.col("d") % unit == 0).select("conv_id", F.floor(q).alias("q"), "a", "b")
    # A band's root is the last row of the band above, and stands before the first row of its own as well.
    band = F.floor(F.col("q") / BAND)
    rows = rows.withColumn("band", F.explode(F.when((F.col("q") % BAND == 0) & (F.col("q") > 0), F.array(band - 1, band)).otherwise(F.array(band))))
    w = Window.partitionBy("conv_id", "band").orderBy("q")
    rows = rows.select("conv_id", "q", "band", "a", "b", *_lags("a", w, None, F.col("q")), *_lags("b", w, None, F.col("q"))).filter((F.col("q") == 0) | (F.floor((F.col("q") - 1) / BAND) == F.col("band")))
    lagged = [f"{k}{i}" for k in "ab" for i in range(1, BAND + 1)]
    return rows.groupBy("a", "b").agg(F.min("q").alias("q"), *(F.max(c).alias(c) for c in lagged)).select("a", "b", "q", _ancestors())


def rollup(nodes: DataFrame, coarser: list[DataFrame], values: list[str]) -> DataFrame:
    """a, b and each value summed over the node's subtree; nodes (a, b, q, up, values), coarser: _coarse of each further level.

    Nodes explode to their ancestors within their band alone. The sums of band roots are then summed over the tree of
    band roots, in the same way and so in a number of rounds that grows with the logarithm of the depth, and the
    completed totals explode to the ancestors in the band above them.
    """
    add = [F.sum(v).alias(v) for v in values]
    inner, roots = F.col("q") % BAND != 0, F.col("q") % BAND == 0
    own = F.array(F.struct("a", "b"))
    spread = lambda df, to: df.select(F.explode(to).alias("k"), *values).select("k.a", "k.b", *values)
    parts = spread(nodes, F.when(inner, F.concat(own, "up")).otherwise(own)).groupBy("a", "b").agg(*add)
    if not coarser:
        return parts
    parts = staged(parts, "trie-bands")
    done = staged(rollup(staged(coarser[0].join(parts, ["a", "b"]), "trie-band-roots"), coarser[1:], values), "trie-band-totals")
    below = nodes.filter(roots & (F.col("q") > 0)).select("a", "b", "up").join(done, ["a", "b"])
    partly = parts.unionByName(spread(below, F.slice("up", 1, BAND - 1))).select("a", "b", *values, F.lit(False).alias("whole"))
    every = partly.unionByName(done.withColumn("whole", F.lit(True)))
    total = [F.coalesce(F.max(F.when(F.col("whole"), F.col(v))), F.sum(F.when(~F.col("whole"), F.col(v)))).alias(v) for v in values]
    return every.groupBy("a", "b").agg(*total)


def _hashed(batches):
    """SHA-256 of each node's pieces, which follow each other; one state is held, whatever the list's length."""
    import pyarrow as pa

    now, state = None, None
    for batch in batches:
        out = []
        for a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "piece")), strict=True):
            if (a, b) != now:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["a", "b", "ends_sha256"])


def _ends(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """a, b, ends_sha256 of nodes at which conversations end. A list is made in pieces, wherever they lie, and hashed piece by piece."""
    keys = turns.groupBy("conv_id").agg(F.bit_xor("e1").alias("a"), F.bit_xor("e2").alias("b"))
    ended = numbered(convs.select("conv_id").join(keys, "conv_id", "left").fillna(0, ["a", "b"]), ["a", "b"], ["conv_id"], "trie-ends")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ended.groupBy("a", "b", F.floor(F.col("pos") / PIECE).alias("part")).agg(ids.alias("piece"))
    return pieces.repartition("a", "b").sortWithinPartitions("a", "b", "part").select("a", "b", "piece").mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, stride: int = 20, heads: int = 4) -> DataFrame:
    """A row for each distinct prefix of the rebuilt conversations (`rebuilt`), with sums over its subtree.

    conv_id: its smallest member, depth, parent_conv_id, n_convs: its members, n_children, n_leaves and saved_tokens:
    over its subtree, ends_sha256: of the members that end there. Conversations and prefixes are told apart by 128-bit
    hashes.

    Turns stand by turn, null first, and rows of one turn by role and then by the SHA-256 of the text; repeated rows
    are turns of their own. Null role and text are empty; rows without conv_id belong to no conversation and take no
    part. Long texts are hashed whole, a conversation may be of any length, and other columns may have any name. An
    empty table gives an empty one.
    """
    convs, turns = rebuilt(conversations, stride, heads)
    deepest = convs.agg(F.max("length")).first()[0] or 0
    paths = _paths(turns)
    nodes = staged(_nodes(paths, convs), "trie-nodes")
    coarser, unit = [], BAND
    if deepest >= BAND:
        root = F.lit(0).cast("long")
        band_rows = paths.filter(F.col("d") % BAND == 0).select("conv_id", "d", "a", "b")
        band_rows = staged(band_rows.unionByName(convs.filter(F.col("length") >= BAND).select("conv_id", root.alias("d"), root.alias("a"), root.alias("b"))), "trie-band-paths")
        empty = convs.limit(1).select(root.alias("a"), root.alias("b"), root.alias("q"), F.array().cast("array<struct<a:long,b:long>>").alias("up"))
        while unit <= deepest:
            # The root is a band root even where no conversation reaches the next one.
            level = _coarse(band_rows, unit)
            coarser.append(staged(level.unionByName(empty.join(level.filter("q = 0"), ["a", "b"], "left_anti")), "trie-coarse"))
            unit *= BAND
    parent = F.get("up", 0)
    kids = staged(nodes.filter("q > 0").groupBy(parent.alias("p")).agg(F.count("*").alias("n_children")).select("p.a", "p.b", "n_children"), "trie-children")
    nodes = staged(nodes.join(kids, ["a", "b"], "left").fillna(0, ["n_children"]), "trie-nodes-children")
    weighed = nodes.select("a", "b", "q", "up", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = rollup(weighed, coarser, ["n_leaves", "saved_tokens"])
    many = max(MANY, (kids.agg(F.sum("n_children")).first()[0] or 0) // 1000)
    own = nodes.withColumns({"pa": parent["a"], "pb": parent["b"]}).drop("up", "words")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_kids"))
    out = split_join(own.filter("pa is not null"), parents, ["pa", "pb"], f"_kids > {many}").drop("_kids").unionByName(own.filter("pa is null").withColumn("parent_conv_id", F.lit(None).cast(dict(nodes.dtypes)["conv_id"])))
    out = out.join(sums, ["a", "b"]).join(_ends(convs, turns), ["a", "b"], "left")
    long = [F.col(c).cast("long").alias(n) for c, n in (("conv_id", "conv_id"), ("q", "depth"), ("parent_conv_id", "parent_conv_id"), ("n_convs", "n_convs"), ("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved_tokens", "saved_tokens"))]
    return out.select(*long, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


SQL = rf"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC32.format('conv_id::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND i <= h UNION ALL SELECT conv_id, i, role, text FROM t JOIN c USING (conv_id) WHERE i > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, sha256(length(role) || ':' || role || text) AS e, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r),
p AS (SELECT conv_id, d, sha256(string_agg(e, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k, w FROM o UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nd AS (SELECT k, d, min(conv_id) AS id, count(*) AS n, any_value(w) AS w FROM p GROUP BY k, d),
m AS (SELECT conv_id, p.d, id FROM p JOIN nd USING (k, d)),
up AS (SELECT nd.id, nd.d, m.id AS parent FROM nd LEFT JOIN m ON m.conv_id = nd.id AND m.d = nd.d - 1),
ch AS (SELECT parent AS id, d - 1 AS d, count(*) AS n_children FROM up WHERE d > 0 GROUP BY ALL),
v AS (SELECT nd.id, nd.d, n, coalesce(n_children, 0) AS n_children, (n - 1) * w AS saved FROM nd LEFT JOIN ch USING (id, d)),
s AS (SELECT m.id, m.d, sum((v.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum(v.saved)::BIGINT AS saved_tokens FROM v JOIN m ON m.conv_id = v.id AND m.d <= v.d GROUP BY ALL),
e AS (SELECT id, d, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM m JOIN (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id) USING (conv_id, d) GROUP BY ALL)
SELECT v.id AS conv_id, v.d AS depth, up.parent AS parent_conv_id, v.n AS n_convs, v.n_children, s.n_leaves, s.saved_tokens, coalesce(ends, sha256('')) AS ends_sha256 FROM v JOIN up USING (id, d) JOIN s USING (id, d) LEFT JOIN e USING (id, d)"""
